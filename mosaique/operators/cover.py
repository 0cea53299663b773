"""Points in regions by quadtree coverings: cells wholly inside a region are accepted, only cells on its border are tested.

1. A region is covered by quadtree cells, halved until a cell is wholly inside, wholly outside (dropped), or as small as the
   points want it: about CELL_POINTS of them in a cell of average density, and no more than LEVELS halvings of the region, so that
   its border has a few hundred cells at most.
2. A point is looked up once per cell size in use (a few dozen at most), by an equi-join.
3. A cell with more than 1/HOT of all points is salted: its points are dealt to as many shares as its weight asks for,
   and its few region cells are copied to all of them. There are at most HOT such cells a size; they are broadcast.
4. Where points share places, only the places go through this. What is found is joined to the points by their place; a place is dealt
   out by the rows that it makes (points times regions), since many points and many regions may both be there.

Cases: regions without area, or of fewer than three corners, and null regions hold nothing; points with a null coordinate are in no
region; a point in several regions, or of several equal rows, has a row for each; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mosaique.functions import geometry as G
from mosaique.session import materialize

CELL_POINTS, LEVELS, LEAST, HOT = 64, 5, 3, 256
#: A place that makes more than 1/HOT_PLACES of the result is dealt out.
HOT_PLACES = 2048
_OUT, _EDGE, _IN = 0, 1, 2


def _corners(x: np.ndarray, y: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([x, x + side, x, x + side]), np.stack([y, y, y + side, y + side])


def _against_box(x: np.ndarray, y: np.ndarray, side: float, box: tuple) -> np.ndarray:
    left, top, right, bottom = box
    meets = (x <= right) & (x + side >= left) & (y <= bottom) & (y + side >= top)
    inside = (x >= left) & (x + side <= right) & (y >= top) & (y + side <= bottom)
    return np.where(inside, _IN, np.where(meets, _EDGE, _OUT))


def _against_ellipse(x: np.ndarray, y: np.ndarray, side: float, box: tuple) -> np.ndarray:
    left, top, right, bottom = box
    w, h = right - left, bottom - top
    holds = lambda u, v: ((2 * u - left - right) * h) ** 2 + ((2 * v - top - bottom) * w) ** 2 - (w * h) ** 2
    slack = 1e-9 * (w * h) ** 2  # cells within rounding of the curve are tested
    # An ellipse is convex: a cell is inside with its corners, and outside with its place nearest to the centre.
    inside = (holds(*_corners(x, y, side)) <= -slack).all(axis=0)
    near = holds(np.clip((left + right) / 2, x, x + side), np.clip((top + bottom) / 2, y, y + side)) <= slack
    return np.where(inside, _IN, np.where(near, _EDGE, _OUT))


def _against_polygon(x: np.ndarray, y: np.ndarray, side: float, ring: np.ndarray) -> np.ndarray:
    a, b = ring, np.roll(ring, -1, axis=0)
    low, high = np.minimum(a, b), np.maximum(a, b)
    # An edge meets a cell if their boxes meet and the corners are not all on one side of it.
    apart = (low[:, 0, None] > x + side) | (high[:, 0, None] < x) | (low[:, 1, None] > y + side) | (high[:, 1, None] < y)
    cx, cy = _corners(x, y, side)
    turn = (b - a)[:, None, None, 0] * (cy - a[:, None, None, 1]) - (b - a)[:, None, None, 1] * (cx - a[:, None, None, 0])
    met = (~apart & (turn.min(axis=1) <= 0) & (turn.max(axis=1) >= 0)).any(axis=0)
    # No edge in the cell: all of it is like its centre (even-odd).
    mx, my = x + side / 2, y + side / 2
    rise = (a[:, 1, None] > my) != (b[:, 1, None] > my)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0, None] + (my - a[:, 1, None]) * (b - a)[:, 0, None] / (b - a)[:, 1, None]
    odd = (rise & (mx < at)).sum(axis=0) % 2 == 1
    return np.where(met, _EDGE, np.where(odd, _IN, _OUT))


def _cells(kind: str, box: tuple, ring: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(power of the side, cx, cy, inside) of the cells that cover a region."""
    if kind == "polygon":
        box = (*ring.min(axis=0), *ring.max(axis=0))
    size = max(box[2] - box[0], box[3] - box[1], 1)
    top = max(least, int(np.ceil(np.log2(size))))
    last = max(least, top - LEVELS)
    k, found = top, []
    x, y = (v.ravel() for v in np.meshgrid(*(np.arange(np.floor(box[i] / 2**k), np.floor(box[i + 2] / 2**k) + 1) for i in (0, 1))))
    while len(x):
        side = 2.0**k
        how = _against_polygon(x * side, y * side, side, ring) if kind == "polygon" else (_against_ellipse if kind == "ellipse" else _against_box)(x * side, y * side, side, box)
        done = (how == _IN) | ((how == _EDGE) & (k == last))
        found.append(np.stack([np.full(done.sum(), float(k)), x[done], y[done], how[done] == _IN]))
        more = (how == _EDGE) & (k > last)
        x, y = ((2 * v[more][:, None] + d).ravel() for v, d in ((x, np.array([0, 1, 0, 1])), (y, np.array([0, 0, 1, 1]))))
        k -= 1
    return tuple(np.concatenate(found, axis=1).astype(np.int64)) if found else (np.zeros(0, np.int64),) * 4


def covering(regions: DataFrame, least: int) -> DataFrame:
    """_rid, _side (power of two), _cx, _cy, _inside for the cells of regions (_rid, kind, box, points)."""

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, kind, box, points in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ring = np.array([[p["x"], p["y"]] for p in points or [] if p], float).reshape(-1, 2)
                box = tuple(box[c] for c in ("left", "top", "right", "bottom")) if box else None
                if len(ring) < 3 if kind == "polygon" else box is None or None in box or box[2] <= box[0] or box[3] <= box[1]:
                    continue
                k, cx, cy, inside = _cells(kind, box, ring, least)
                yield pa.RecordBatch.from_arrays([pa.array([rid] * len(k), pa.int64()), pa.array(k, pa.int32()), pa.array(cx), pa.array(cy), pa.array(inside == 1)], ["_rid", "_side", "_cx", "_cy", "_inside"])

    return regions.select("_rid", "kind", "box", "points").mapInArrow(cover, "_rid long, _side int, _cx long, _cy long, _inside boolean")


def points_in_regions(points: DataFrame, regions: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Columns of `points` (x, y) with region_id, for every region (kind, box, points) that holds the point.

    `on`: columns in which point and region must agree, such as the image that both belong to.
    """
    at = [*(on or []), "x", "y"]
    places = points.filter(" and ".join(f"`{c}` is not null" for c in at)).groupBy(*at).agg(F.count("*").alias("_n"))
    places = materialize(places, "places")
    if 2 * places.count() > points.count():
        return _tested(points, regions, on or [])
    # Points that share places: each place is tested once, and what is found is joined to its points.
    found = materialize(_tested(places, regions, on or []), "found")
    made = found.groupBy(*at).agg(F.any_value("_n").alias("_n"), F.count("*").alias("_m")).withColumn("_made", F.col("_n").cast("double") * F.col("_m"))
    made = materialize(made, "made")
    share = max(1.0, (made.agg(F.sum("_made")).first()[0] or 0.0) / HOT_PLACES)
    # At most HOT_PLACES rows. The side with more rows is dealt out, the other copied.
    hot = made.filter(F.col("_made") > share).select(*at, F.ceil(F.col("_made") / share).cast("int").alias("_shares"), (F.col("_n") >= F.col("_m")).alias("_deal"))
    hot = materialize(hot, "hot")

    def salted(df: DataFrame, columns: list[str], deal: Column) -> DataFrame:
        shares = F.coalesce("_shares", F.lit(1))
        one = F.array(F.pmod(F.xxhash64(*columns), shares).cast("int"))
        salts = F.when(F.coalesce(deal, F.lit(True)), one).otherwise(F.sequence(F.lit(0), shares - 1))
        return df.join(F.broadcast(hot), at, "left").withColumn("_salt", F.explode(salts)).drop("_shares", "_deal")

    rest = salted(found.select(*at, "region_id"), ["region_id"], ~F.col("_deal"))
    met = salted(points, points.columns, F.col("_deal")).join(rest.hint("merge"), [*at, "_salt"])
    return met.select(*points.columns, "region_id")


def _tested(points: DataFrame, regions: DataFrame, on: list[str]) -> DataFrame:
    """The same, with a test of each point by itself."""
    extent = points.agg(F.count("*"), *[f(c) for c in "xy" for f in (F.min, F.max)]).first()
    n, (lx, hx, ly, hy) = extent[0], (float(v or 0) for v in extent[1:])
    wanted = ((hx - lx + 1) * (hy - ly + 1) * CELL_POINTS / max(1, n)) ** 0.5
    least = max(LEAST, int(np.floor(np.log2(max(1.0, wanted)))))
    named = materialize(regions.withColumn("_rid", F.monotonically_increasing_id()), "regions")
    cells = materialize(covering(named, least), "cells")
    sides = sorted(r[0] for r in cells.select("_side").distinct().collect())
    shape = named.select("_rid", "region_id", *[F.col(c).alias(f"_on_{c}") for c in on], F.struct("kind", "box", "points").alias("_shape"))
    # Only border cells carry the shape.
    cells = cells.join(shape.hint("merge"), "_rid").withColumn("_shape", F.when(~F.col("_inside"), F.col("_shape")))
    down = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_side"))).cast("long")
    placed = points.withColumn("_side", F.explode(F.array(*map(F.lit, sides)).cast("array<int>")))
    placed = placed.withColumn("_cx", down("x")).withColumn("_cy", down("y"))
    cells = cells.withColumnsRenamed({f"_on_{c}": c for c in on})
    at = [*on, "_side", "_cx", "_cy"]
    share = max(1, n // HOT)
    hot = materialize(placed.groupBy(*at).agg(F.count("*").alias("_n")).filter(F.col("_n") > share).select(*at, F.ceil(F.col("_n") / share).cast("int").alias("_shares")), "hot")
    # At most HOT rows a size.
    placed = placed.join(F.broadcast(hot), at, "left").withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares")
    cells = cells.join(F.broadcast(hot), at, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)))
    met = placed.join(cells.select(*at, "_salt", "_inside", "_shape", "region_id").hint("merge"), [*at, "_salt"])
    return met.filter(F.col("_inside") | _hit()).select(*points.columns, "region_id")


def _hit() -> Column:
    x, y, kind, box = F.col("x"), F.col("y"), F.col("_shape.kind"), F.col("_shape.box")
    return F.when(kind == "polygon", G.in_polygon(x, y, F.col("_shape.points"))).when(kind == "ellipse", G.in_ellipse(x, y, box)).otherwise(G.in_rect(x, y, box))
