"""Pixel tables (image_id, x, y and one column per channel): tiles, bands, stencils, displacement, regions.

Stencils and blurs work inside array blocks with borders (`halo`); displaced pixels are looked up by an equi-join. Statistics per image are aggregates that are joined back, so that a large image is not
one window.
"""

from __future__ import annotations

import collections
import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mosaique.functions import geometry as G, scalars as S
from mosaique.operators import halo
from mosaique.operators.cover import points_in_regions
from mosaique.operators.selection import percentiles

ID = "image_id"
AT = [ID, "x", "y"]


#: Pixels in an Arrow batch that `read_rasters` hands on.
PIXEL_ROWS = 500_000
#: Pictures in a sheet of `write_sheets`.
SHEET = 2_048


def read_rasters(spark: SparkSession, path: str, height: int | None = None) -> DataFrame:
    """Stills under a path as pixels: image_id (path), x, y, r, g, b, a. Undecodable files have no pixels (see `bad_rasters`).

    With a `height` the files are sheets as `write_sheets` writes them, and image_id is the number of each picture in them.
    """
    images = spark.read.format("image").load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").filter("width > 0")
    kind = "string" if height is None else "long"

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                origin, width, _, channels = (batch.column(c)[k].as_py() for c in range(4))
                data = np.frombuffer(batch.column(4)[k].as_buffer(), np.uint8)
                if height is None:
                    names, rows = None, data.reshape(-1, channels)
                else:
                    strips = data.reshape(-1, height + 1, width * channels)
                    names, rows = strips[:, 0, :9].copy(), strips[:, 1:].reshape(-1, channels)
                for low in range(0, len(rows), PIXEL_ROWS):
                    part = rows[low : low + PIXEL_ROWS].astype(np.int32)
                    at = np.arange(low, low + len(part))
                    # Bytes come as blue, green, red, alpha; one channel is grey.
                    b, g, r = (part[:, min(c, channels - 1)] for c in range(3))
                    alpha = part[:, 3] if channels == 4 else np.full(len(part), 255, np.int32)
                    if names is None:
                        named = pa.repeat(origin, len(part))
                    else:
                        own = at // (width * height)
                        named = pa.array(np.ascontiguousarray(names[:, :8]).view("<i8").ravel()[own], mask=names[own, 8] == 0)
                        at = at % (width * height)
                    columns = [(at % width).astype(np.int32), (at // width).astype(np.int32), r, g, b, alpha]
                    yield pa.RecordBatch.from_arrays([named, *map(pa.array, columns)], [ID, "x", "y", "r", "g", "b", "a"])

    return images.mapInArrow(pixels, f"{ID} {kind}, x int, y int, r int, g int, b int, a int")


def write_sheets(pictures: DataFrame, path: str, width: int, height: int) -> None:
    """Grey pictures of one size (a whole number, which may be null, and an array of pixels, row by row) as bitmap files with many pictures in each.

    Rows without an array are left out, as files that don't decode are; pixels behind the size are ignored.
    A sheet has up to SHEET pictures, one below the other, each below a row of pixels whose first nine bytes hold its number
    and whether it has one. So there are as many files as tasks and full sheets, not as many as pictures.
    """
    stride = -(-3 * width // 4) * 4

    def sheet(number: pa.Array, luma: np.ndarray) -> bytes:
        n = len(number)
        rows = np.zeros((n, height + 1, stride), np.uint8)
        rows[:, 0, :8] = number.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(n, 8)
        rows[:, 0, 8] = number.is_valid().to_numpy(zero_copy_only=False)
        rows[:, 1:, : 3 * width] = np.repeat(luma.reshape(n, height, width), 3, axis=2)
        # A bitmap begins with its lowest row.
        body = rows.reshape(-1, stride)[::-1].tobytes()
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(body), 0, 54, 40, width, n * (height + 1), 1, 24, 0, len(body), 2835, 2835, 0, 0) + body

    def sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(all_: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            for low in range(0, table.num_rows, SHEET):
                part = table.slice(low, SHEET).combine_chunks()
                if part.num_rows < SHEET and not all_:
                    held.extend(part.to_batches())
                    break
                number, luma = (part.column(c).combine_chunks() for c in range(2))
                yield pa.RecordBatch.from_arrays([pa.array([sheet(number, luma.flatten().to_numpy(zero_copy_only=False).astype(np.uint8))], pa.binary())], ["content"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= SHEET:
                yield from cut(False)
        if held:
            yield from cut(True)

    number, luma = pictures.columns
    rows = pictures.select(F.col(number).cast("long"), F.slice(luma, 1, width * height)).filter(F.col(luma).isNotNull())
    rows.mapInArrow(sheets, "content binary").select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def bad_rasters(spark: SparkSession, path: str) -> DataFrame:
    """path and message of files that did not decode."""
    images = spark.read.format("image").load(path).select("image.origin", "image.width")
    return images.filter("width < 0").select(F.col("origin").alias("path"), F.concat(F.col("origin"), F.lit(": not decodable")).alias("message"))


def crop(pixels: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """The pixels of a box (right and bottom excluded), counted from its corner."""
    inside = (F.col("x") >= left) & (F.col("x") < right) & (F.col("y") >= top) & (F.col("y") < bottom)
    return pixels.filter(inside).withColumn("x", F.col("x") - left).withColumn("y", F.col("y") - top)


def crop_polygon(pixels: DataFrame, points: list[tuple[int, int]], channel: str, blank: int = 0) -> DataFrame:
    """The polygon's bounding box, blank outside the polygon."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])
    masked = pixels.withColumn(channel, F.when(G.in_polygon(F.col("x"), F.col("y"), ring), F.col(channel)).otherwise(blank))
    return crop(masked, max(0, min(xs)), max(0, min(ys)), max(xs) + 1, max(ys) + 1)


def flip(pixels: DataFrame, width: int, horizontal: bool = True) -> DataFrame:
    """Mirrored left to right, or top to bottom (then `width` is the height)."""
    c = "x" if horizontal else "y"
    return pixels.withColumn(c, width - 1 - F.col(c))


def rotate90(pixels: DataFrame, width: int, height: int, turns: int = 1) -> DataFrame:
    """Quarter turns against the clock."""
    turns %= 4
    new = {0: ("x", "y"), 1: ("y", f"{width - 1} - x"), 2: (f"{width - 1} - x", f"{height - 1} - y"), 3: (f"{height - 1} - y", "x")}[turns]
    return pixels.withColumns({"x": F.expr(new[0]), "y": F.expr(new[1])})


def proxy_size(width: Column, height: Column, limit: int) -> Column:
    """struct(scale, w, h) that fits a number of pixels."""
    scale = F.least(F.lit(1.0), F.sqrt(limit / (width.cast("long") * height)))
    return F.struct(scale.alias("scale"), F.greatest(F.lit(1), F.bround(width * scale).cast("int")).alias("w"), F.greatest(F.lit(1), F.bround(height * scale).cast("int")).alias("h"))


def with_group_mean(pixels: DataFrame, channel: str, keys: list[str], to: str = "mean") -> DataFrame:
    """Each pixel with the mean of its group: partial sums before the shuffle, then joined back."""
    means = pixels.groupBy(*keys).agg(F.avg(channel).alias(to))
    return pixels.join(means.hint("merge"), keys)


def tile_mean(pixels: DataFrame, channel: str, tile: int) -> DataFrame:
    """Each pixel takes the mean of its tile; tiles have a fixed size and may be cut at the edges."""
    tiled = pixels.withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile))
    return with_group_mean(tiled, channel, [ID, "tx", "ty"]).drop("tx", "ty")


def band_mean(pixels: DataFrame, channel: str, period: int, angle: float) -> DataFrame:
    """Each pixel with its band across an angle, and the band's mean."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    along = F.col("x") * F.lit(c) + F.col("y") * F.lit(s)
    least = pixels.groupBy(ID).agg(F.min(along).alias("_least"))
    banded = pixels.join(least.hint("merge"), ID).withColumn("band", F.floor((along - F.col("_least")) / period).cast("int")).drop("_least")
    return with_group_mean(banded, channel, [ID, "band"])


def percentile_stretch(pixels: DataFrame, channel: str, cutoff: float) -> DataFrame:
    """The middle of each image's values spread over 0..255; `cutoff` percent go at either end.

    The exact percentiles come from counted values, without a sort of the pixels.
    """
    ends = percentiles(pixels, [ID], channel, {"low": cutoff / 100, "high": 1 - cutoff / 100})
    joined = pixels.join(ends.hint("merge"), ID)
    spread = S.clip((F.col(channel) - F.col("low")) * 255.0 / (F.col("high") - F.col("low")))
    return joined.withColumn("stretched", F.when(F.col("high") > F.col("low"), F.floor(F.round(spread, 6) + 0.5).cast("int")).otherwise(F.col(channel)))


LAPLACE = [(0, 0, 4), (-1, 0, -1), (1, 0, -1), (0, -1, -1), (0, 1, -1)]
SOBEL_X = [(-1, -1, -1), (1, -1, 1), (-1, 0, -2), (1, 0, 2), (-1, 1, -1), (1, 1, 1)]
SOBEL_Y = [(-1, -1, -1), (0, -1, -2), (1, -1, -1), (-1, 1, 1), (0, 1, 2), (1, 1, 1)]


def stencil(pixels: DataFrame, channel: str, kernel: list[tuple[int, int, int]], to: str, clamp: bool = False) -> DataFrame:
    """image_id, x, y and the weighted sum over neighbours; see `stencils`."""
    return stencils(pixels, channel, {to: kernel}, clamp)


def stencils(pixels: DataFrame, channel: str, kernels: dict[str, list[tuple[int, int, int]]], clamp: bool = False) -> DataFrame:
    """image_id, x, y and one weighted sum over neighbours per kernel, in one pass over blocks with borders.

    Without `clamp`, places that lack a neighbour have no row; with it, edges repeat. Sums of integers are integers.
    """
    weights = {name: {(dx, dy): w for dx, dy, w in kernel} for name, kernel in kernels.items()}
    reach = max(max(abs(dx), abs(dy)) for found in weights.values() for dx, dy in found)
    found = halo.on_blocks(pixels, channel, reach, halo.weighted(weights, reach), list(weights), clamp)
    whole = pixels.schema[channel].dataType.typeName() in ("byte", "short", "integer", "long")
    return found.select(*AT, *[F.col(name).cast("long" if whole else "double").alias(name) for name in weights])


def sharpness(pixels: DataFrame, channel: str = "luma") -> DataFrame:
    """image_id and the population variance of the Laplacian over the interior."""
    return stencil(pixels, channel, LAPLACE, "lap").groupBy(ID).agg(F.var_pop("lap").alias("sharpness"))


def edge_score(pixels: DataFrame, channel: str = "luma") -> DataFrame:
    """image_id, x, y, magnitude and score: share of the image's 92nd percentile, times how abrupt the step is.

    Both gradients come from one pass, and the percentile from counted magnitudes, refined where they are many.
    """
    both = stencils(pixels, channel, {"gx": SOBEL_X, "gy": SOBEL_Y}, clamp=True).withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    scale = percentiles(both, [ID], "magnitude", {"p": 0.92})
    joined = both.join(scale.hint("merge"), ID).withColumn("p", F.when(F.col("p") <= 0, 1.0).otherwise(F.col("p")))
    relative, absolute = S.clip(F.col("magnitude") / F.col("p"), 0.0, 1.0), S.clip((F.col("magnitude") - 180.0) / 580.0, 0.0, 1.0)
    return joined.select(*AT, "magnitude", (relative * absolute).alias("score"))


def displace(pixels: DataFrame, channel: str, dx: Column, dy: Column, to: str) -> DataFrame:
    """Each pixel with the value at (x - dx, y - dy), held inside its own picture: a look-up join. A pixel whose source is missing keeps null."""
    size = pixels.groupBy(F.col(ID).alias("_id")).agg(F.max("x").alias("_mx"), F.max("y").alias("_my"))
    sized = pixels.join(size.hint("merge"), F.col(ID).eqNullSafe(F.col("_id"))).drop("_id")
    held = lambda at, most: F.greatest(F.lit(0), F.least(F.col(most), at)).cast("int")
    asked = sized.withColumn("_sx", held(F.col("x") - dx, "_mx")).withColumn("_sy", held(F.col("y") - dy, "_my"))
    source = pixels.select(F.col(ID).alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(channel).alias(to))
    met = F.col(ID).eqNullSafe(F.col("_id")) & (F.col("_sx") == F.col("_x")) & (F.col("_sy") == F.col("_y"))
    return asked.join(source.hint("merge"), met, "left").drop("_id", "_x", "_y", "_sx", "_sy", "_mx", "_my")


def directional_mean(pixels: DataFrame, channel: str, length: float, samples: int, angle: float) -> DataFrame:
    """image_id, x, y and the mean of evenly spaced samples along an angle, edges repeated, cut to an integer."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    offsets = [-length / 2 + length * k / (samples - 1) for k in range(samples)]
    count = collections.Counter((-round(c * o), -round(s * o)) for o in offsets)
    found = stencils(pixels, channel, {"mean": [(dx, dy, n) for (dx, dy), n in count.items()]}, clamp=True)
    return found.select(*AT, F.floor(F.col("mean") / samples).cast("int").alias("mean"))


def gaussian(pixels: DataFrame, channel: str, radius: float) -> DataFrame:
    """image_id, x, y and the channel blurred by a Gaussian of that standard deviation, edges repeated, cut to an integer.

    Both axes are summed inside blocks with borders: what is shuffled doesn't depend on the radius.
    """
    reach = math.ceil(3 * radius)
    weights = np.exp(-np.arange(-reach, reach + 1.0) ** 2 / (2 * radius * radius))
    out = halo.on_blocks(pixels, channel, reach, halo.separable(weights / weights.sum(), reach, channel), [channel], clamp=True)
    return out.select(*AT, F.floor(F.round(channel, 6)).cast("int").alias(channel))


def tile_ramp(tiled: DataFrame, channel: str, tile: int, width: int, height: int) -> DataFrame:
    """image_id, x, y and the channel of a picture of even tiles, drawn as straight ramps between their centres.

    The row of tiles is stretched to the whole width (and column to height), as when a small picture is enlarged.
    """
    across, down = -(-width // tile), -(-height // tile)
    cells = tiled.groupBy(F.col(ID).alias("_id"), F.floor(F.col("x") / tile).alias("_tx"), F.floor(F.col("y") / tile).alias("_ty")).agg(F.first(channel).alias("_value"))
    sx, sy = (F.col("x") + 0.5) * across / width - 0.5, (F.col("y") + 0.5) * down / height - 0.5
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    asked = tiled.select(*AT, sx.alias("_sx"), sy.alias("_sy"), corners.alias("k"))
    share = lambda s, k: F.when(F.col(k) == 0, 1 - (F.col(s) - F.floor(s))).otherwise(F.col(s) - F.floor(s))
    asked = asked.select(
        *AT, (share("_sx", "k.i") * share("_sy", "k.j")).alias("_w"),
        S.clip(F.floor("_sx") + F.col("k.i"), 0, across - 1).alias("_cx"), S.clip(F.floor("_sy") + F.col("k.j"), 0, down - 1).alias("_cy"),
    )
    met = asked.join(cells.hint("merge"), (F.col(ID) == F.col("_id")) & (F.col("_cx") == F.col("_tx")) & (F.col("_cy") == F.col("_ty")))
    return met.groupBy(*AT).agg(F.floor(F.round(F.sum(F.col("_value") * F.col("_w")), 6)).cast("int").alias(channel))


def target_hit(polygon: list[tuple[int, int]] | None, box: tuple[int, int, int, int] | None) -> Column:
    """Whether a pixel is targeted: a polygon first, else a rectangle, else everything; empty ones target nothing."""
    if polygon:
        ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in polygon])
        return G.in_polygon(F.col("x"), F.col("y"), ring)
    if box:
        left, top, right, bottom = (F.lit(v) for v in box)
        return G.in_rect(F.col("x"), F.col("y"), G.rect(left, top, right, bottom))
    return F.lit(True)


def apply_to_target(pixels: DataFrame, channel: str, change: Column, polygon: list[tuple[int, int]] | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The channel changed where targeted."""
    return pixels.withColumn(channel, F.when(target_hit(polygon, box), change).otherwise(F.col(channel)))


def apply_outside(pixels: DataFrame, channel: str, change: Column, protected: DataFrame) -> DataFrame:
    """The channel changed wherever no protected ellipse (image_id, box) is; ellipses are looked up by their coverings."""
    none = F.array().cast("array<struct<x:int,y:int>>")
    spots = protected.select(ID, F.lit(0).alias("region_id"), F.lit("ellipse").alias("kind"), "box", none.alias("points"))
    held = points_in_regions(pixels.select(*AT), spots, on=[ID]).select(*AT).distinct().withColumn("_held", F.lit(True))
    return pixels.join(held.hint("merge"), AT, "left").withColumn(channel, F.when(F.col("_held"), F.col(channel)).otherwise(change)).drop("_held")


def adjust(pixels: DataFrame, channel: str, brightness: int = 0, contrast: int = 0) -> DataFrame:
    """Brightness toward black, then contrast around the image's mean grey (rounded)."""
    out = pixels.withColumn(channel, S.brightness(F.col(channel), brightness)) if brightness else pixels
    if contrast:
        out = with_group_mean(out, channel, [ID], "_grey").withColumn(channel, S.toward(F.col(channel), F.floor(F.round("_grey", 6) + 0.5), contrast)).drop("_grey")
    return out.withColumn(channel, F.floor(channel).cast("int"))


def adjust_colors(pixels: DataFrame, brightness: int = 0, contrast: int = 0, saturation: int = 0) -> DataFrame:
    """r, g, b: brightness toward black, contrast around the image's mean grey (rounded), saturation toward each pixel's grey; cut to integers after each."""
    out = pixels
    whole = lambda c: F.floor(F.round(c, 6)).cast("int")
    grey = S.luma(F.col("r"), F.col("g"), F.col("b"))
    if brightness:
        out = out.withColumns({c: whole(S.brightness(F.col(c), brightness)) for c in "rgb"})
    if contrast:
        out = with_group_mean(out.withColumn("_luma", grey), "_luma", [ID], "_grey")
        mean = F.floor(F.round("_grey", 6) + 0.5)
        out = out.withColumns({c: whole(S.toward(F.col(c), mean, contrast)) for c in "rgb"}).drop("_luma", "_grey")
    if saturation:
        out = out.withColumn("_grey", grey)
        out = out.withColumns({c: whole(S.toward(F.col(c), F.col("_grey"), saturation)) for c in "rgb"}).drop("_grey")
    return out


def seeded_tile_shuffle(pixels: DataFrame, channel: str, tile: int, percent: int, seed: int) -> DataFrame:
    """A seeded share of each image's tiles shows the content of other tiles; the same call gives the same picture.

    Targets and sources are the tiles that two keyed digests put first; the k-th target takes the k-th source.
    """
    tiled = pixels.withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile))
    tiles = tiled.select(ID, "tx", "ty").distinct()
    digest = lambda salt: F.md5(F.concat_ws("/", F.lit(seed), F.lit(salt), ID, "tx", "ty").cast("binary"))
    order = lambda salt: F.row_number().over(Window.partitionBy(ID).orderBy(digest(salt), "tx", "ty"))
    count = F.greatest(F.lit(1), F.bround(F.count("*").over(Window.partitionBy(ID)) * percent / 100))
    ranked = tiles.withColumn("target", order(1)).withColumn("source", order(2)).withColumn("n", count)
    pairs = ranked.filter("target <= n").select(ID, F.col("target").alias("rank"), "tx", "ty").join(
        ranked.filter("source <= n").select(ID, F.col("source").alias("rank"), F.col("tx").alias("sx"), F.col("ty").alias("sy")).hint("merge"), [ID, "rank"])
    moved = tiled.join(pairs.drop("rank").hint("merge"), [ID, "tx", "ty"], "left")
    moved = moved.withColumn("_x", F.coalesce(F.col("sx") * tile + F.col("x") % tile, F.col("x")).cast("int")).withColumn("_y", F.coalesce(F.col("sy") * tile + F.col("y") % tile, F.col("y")).cast("int"))
    source = pixels.select(F.col(ID).alias("_id"), F.col("x").alias("_px"), F.col("y").alias("_py"), F.col(channel).alias("_value"))
    met = moved.join(source.hint("merge"), (F.col(ID) == F.col("_id")) & (F.col("_x") == F.col("_px")) & (F.col("_y") == F.col("_py")), "left")
    return met.select(*AT, F.coalesce("_value", channel).alias(channel))


def _tiling(tile: int) -> tuple[int, int]:
    """(overlap, core side) of tiles."""
    overlap = min(24, max(8, tile // 16))
    return overlap, max(32, tile - overlap * 2)


def _tile_boxes(cells: DataFrame, tile: int) -> DataFrame:
    """Boxes of tiles (left, top) of images (width, height): cores without overlap, and the larger boxes to read."""
    overlap, core = _tiling(tile)
    whole = (F.col("width") <= tile) & (F.col("height") <= tile)
    cells = cells.withColumn("right", F.when(whole, F.col("width")).otherwise(F.least("width", F.col("left") + core)))
    cells = cells.withColumn("bottom", F.when(whole, F.col("height")).otherwise(F.least("height", F.col("top") + core)))
    grow = F.when(whole, 0).otherwise(overlap)
    return cells.withColumns({
        "in_left": F.greatest(F.lit(0), F.col("left") - grow), "in_top": F.greatest(F.lit(0), F.col("top") - grow),
        "in_right": F.least("width", F.col("right") + grow), "in_bottom": F.least("height", F.col("bottom") + grow),
    })


def tile_grid(images: DataFrame, tile: int) -> DataFrame:
    """Overlapping tiles of images (width, height): core boxes without overlap, and the larger boxes to read."""
    _, core = _tiling(tile)
    whole = (F.col("width") <= tile) & (F.col("height") <= tile)
    starts = lambda length: F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(length) - 1, F.lit(core)))
    return _tile_boxes(images.withColumn("left", F.explode(starts("width"))).withColumn("top", F.explode(starts("height"))), tile)


def cut_tiles(pixels: DataFrame, images: DataFrame, tile: int) -> DataFrame:
    """The pixels of each tile's larger box, with coordinates inside it (tx, ty) and the tile's boxes.

    The one to four tiles of a pixel follow from its place and its image's size: a pixel never meets the image's other tiles.
    """
    overlap, core = _tiling(tile)
    sized = pixels.join(images.select(ID, "width", "height").hint("merge"), ID)
    whole = (F.col("width") <= tile) & (F.col("height") <= tile)

    def starts(at: str, length: str) -> Column:
        first, last = F.greatest(F.lit(0), F.floor((F.col(at) - overlap) / core)), F.floor((F.col(at) + overlap) / core)
        near = F.transform(F.sequence(first, last), lambda k: (k * core).cast("int"))
        return F.when(whole, F.array(F.lit(0))).otherwise(F.filter(near, lambda k: k < F.col(length)))

    cells = _tile_boxes(sized.withColumn("left", F.explode(starts("x", "width"))).withColumn("top", F.explode(starts("y", "height"))), tile)
    inside = (F.col("x") >= F.col("in_left")) & (F.col("x") < F.col("in_right")) & (F.col("y") >= F.col("in_top")) & (F.col("y") < F.col("in_bottom"))
    return cells.filter(inside).withColumn("tx", F.col("x") - F.col("in_left")).withColumn("ty", F.col("y") - F.col("in_top")).drop("x", "y")


def apply_on_tiles(cut: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A user's function (pandas frame of one tile -> frame) on every tile; Arrow carries the batches."""
    return cut.groupBy(ID, "left", "top").applyInPandas(fn, schema)


def stitch(tiles: DataFrame, scale: int, value: str) -> DataFrame:
    """Pixels of the whole from enlarged tiles (tx, ty within the enlarged larger box): only cores count, each pixel once."""
    x, y = F.col("tx") + F.col("in_left") * scale, F.col("ty") + F.col("in_top") * scale
    core = (x >= F.col("left") * scale) & (x < F.col("right") * scale) & (y >= F.col("top") * scale) & (y < F.col("bottom") * scale)
    return tiles.filter(core).select(ID, x.cast("int").alias("x"), y.cast("int").alias("y"), value)
