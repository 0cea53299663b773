"""Effect chains: parameter tables, specifications as rows, and operators composed in order."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mosaique.functions import scalars as S
from mosaique.operators import raster as R
from mosaique.session import materialize

KEYS = ("amount", "size", "softness", "detail", "angle", "edge", "phase")

#: Effect, parameter, minimum, maximum, default.
PARAMETERS = [
    ("Soft Blur", "amount", 0, 100, 100), ("Soft Blur", "size", 1, 80, 12), ("Soft Blur", "softness", 0, 100, 10), ("Soft Blur", "detail", 0, 100, 0),
    ("Privacy Blur", "amount", 0, 100, 100), ("Privacy Blur", "size", 2, 100, 24), ("Privacy Blur", "softness", 0, 100, 72), ("Privacy Blur", "detail", 0, 100, 12),
    ("Directional Blur", "amount", 0, 100, 100), ("Directional Blur", "size", 1, 120, 28), ("Directional Blur", "softness", 2, 21, 11), ("Directional Blur", "detail", 0, 100, 0), ("Directional Blur", "angle", -90, 90, 0),
    ("Pixelate", "amount", 0, 100, 100), ("Pixelate", "size", 2, 120, 20), ("Pixelate", "softness", 0, 100, 0), ("Pixelate", "detail", 2, 256, 256), ("Pixelate", "angle", 0, 100, 0),
    ("Mosaic", "amount", 0, 100, 100), ("Mosaic", "size", 3, 120, 24), ("Mosaic", "softness", 0, 100, 18), ("Mosaic", "detail", 0, 100, 45), ("Mosaic", "angle", 1, 8, 1),
    ("Frosted Glass", "amount", 0, 100, 100), ("Frosted Glass", "size", 1, 60, 12), ("Frosted Glass", "softness", 0, 100, 38), ("Frosted Glass", "detail", 0, 100, 28), ("Frosted Glass", "angle", 2, 40, 10),
    ("Faceted Glass", "amount", 0, 100, 100), ("Faceted Glass", "size", 8, 120, 30), ("Faceted Glass", "softness", 0, 100, 45), ("Faceted Glass", "detail", 0, 100, 28), ("Faceted Glass", "angle", -100, 100, 0),
    ("Encrypted Tiles", "amount", 0, 100, 100), ("Encrypted Tiles", "size", 4, 100, 24), ("Encrypted Tiles", "softness", 0, 100, 84), ("Encrypted Tiles", "detail", 0, 100, 55), ("Encrypted Tiles", "angle", 0, 80, 24),
    ("Prism Split", "amount", 0, 100, 100), ("Prism Split", "size", 1, 80, 14), ("Prism Split", "softness", 0, 100, 8), ("Prism Split", "detail", 0, 100, 28), ("Prism Split", "angle", -180, 180, 0),
    ("Wave Scramble", "amount", 0, 100, 100), ("Wave Scramble", "size", 8, 160, 44), ("Wave Scramble", "softness", 0, 100, 24), ("Wave Scramble", "detail", 1, 6, 2), ("Wave Scramble", "angle", -90, 90, 0),
    ("Black Redaction", "amount", 0, 100, 100), ("Black Redaction", "size", 2, 80, 20), ("Black Redaction", "softness", 0, 100, 0), ("Black Redaction", "detail", 0, 100, 0), ("Black Redaction", "angle", -90, 90, 0),
    ("White Redaction", "amount", 0, 100, 100), ("White Redaction", "size", 2, 80, 20), ("White Redaction", "softness", 0, 100, 0), ("White Redaction", "detail", 0, 100, 0), ("White Redaction", "angle", -90, 90, 0),
    ("Noise Redaction", "amount", 0, 100, 92), ("Noise Redaction", "size", 1, 24, 3), ("Noise Redaction", "softness", 0, 100, 5), ("Noise Redaction", "detail", 0, 100, 45), ("Noise Redaction", "angle", 0, 100, 72),
    ("Marker Scribble", "amount", 0, 100, 96), ("Marker Scribble", "size", 3, 100, 20), ("Marker Scribble", "softness", 0, 100, 8), ("Marker Scribble", "detail", 10, 100, 72), ("Marker Scribble", "angle", -180, 180, 0),
    ("Redaction Tape", "amount", 0, 100, 100), ("Redaction Tape", "size", 6, 100, 22), ("Redaction Tape", "softness", 0, 100, 8), ("Redaction Tape", "detail", 0, 100, 58), ("Redaction Tape", "angle", -180, 180, 0),
    ("Halftone Dots", "amount", 0, 100, 100), ("Halftone Dots", "size", 3, 60, 12), ("Halftone Dots", "softness", 0, 100, 15), ("Halftone Dots", "detail", 0, 100, 72), ("Halftone Dots", "angle", -90, 90, 15),
    ("Barcode Redaction", "amount", 0, 100, 100), ("Barcode Redaction", "size", 2, 60, 8), ("Barcode Redaction", "softness", 0, 100, 0), ("Barcode Redaction", "detail", 0, 100, 78), ("Barcode Redaction", "angle", -90, 90, 0),
    ("Ordered Dither", "amount", 0, 100, 100), ("Ordered Dither", "size", 1, 12, 3), ("Ordered Dither", "softness", 2, 8, 2), ("Ordered Dither", "detail", 0, 100, 68), ("Ordered Dither", "angle", -90, 90, 0),
    ("Glitch Blocks", "amount", 0, 100, 100), ("Glitch Blocks", "size", 3, 80, 14), ("Glitch Blocks", "softness", 1, 120, 36), ("Glitch Blocks", "detail", 1, 100, 68), ("Glitch Blocks", "angle", -180, 180, 0),
    ("CRT Distortion", "amount", 0, 100, 100), ("CRT Distortion", "size", 2, 30, 7), ("CRT Distortion", "softness", 0, 100, 22), ("CRT Distortion", "detail", 0, 100, 28), ("CRT Distortion", "angle", 0, 60, 8),
    ("Silhouette", "amount", 0, 100, 100), ("Silhouette", "size", 0, 60, 8), ("Silhouette", "softness", 0, 100, 50), ("Silhouette", "detail", 0, 100, 78), ("Silhouette", "angle", 0, 100, 50),
    ("Comic Cutout", "amount", 0, 100, 100), ("Comic Cutout", "size", 2, 16, 5), ("Comic Cutout", "softness", 1, 7, 2), ("Comic Cutout", "detail", 0, 100, 72), ("Comic Cutout", "angle", -100, 100, 32),
    ("Thermal Map", "amount", 0, 100, 100), ("Thermal Map", "size", 0, 30, 3), ("Thermal Map", "softness", 0, 100, 72), ("Thermal Map", "detail", 0, 100, 0), ("Thermal Map", "angle", 0, 100, 58),
    ("Photocopy", "amount", 0, 100, 100), ("Photocopy", "size", 1, 16, 2), ("Photocopy", "softness", 0, 100, 42), ("Photocopy", "detail", 0, 100, 50), ("Photocopy", "angle", 0, 100, 8),
    ("ASCII Art", "amount", 0, 100, 100), ("ASCII Art", "size", 5, 28, 10), ("ASCII Art", "softness", 0, 100, 58), ("ASCII Art", "detail", 0, 100, 62), ("ASCII Art", "angle", 0, 100, 72), ("ASCII Art", "edge", 0, 100, 76), ("ASCII Art", "phase", 0, 100, 0),
    ("Blueprint", "amount", 0, 100, 100), ("Blueprint", "size", 8, 64, 20), ("Blueprint", "softness", 0, 100, 14), ("Blueprint", "detail", 0, 100, 72), ("Blueprint", "angle", 0, 100, 28),
    ("Neon Edges", "amount", 0, 100, 100), ("Neon Edges", "size", 0, 40, 8), ("Neon Edges", "softness", 0, 100, 74), ("Neon Edges", "detail", 0, 100, 64), ("Neon Edges", "angle", -180, 180, 0),
    ("Topographic Lines", "amount", 0, 100, 100), ("Topographic Lines", "size", 6, 40, 16), ("Topographic Lines", "softness", 0, 100, 12), ("Topographic Lines", "detail", 0, 100, 68), ("Topographic Lines", "angle", 1, 8, 2),
]
#: Older names of effects.
ALIASES = [
    ("Blur", "Soft Blur"), ("Deep Blur", "Privacy Blur"), ("Black", "Black Redaction"), ("White", "White Redaction"), ("Noise", "Noise Redaction"),
    ("Halftone", "Halftone Dots"), ("Glitch", "Glitch Blocks"), ("Glass Tiles", "Encrypted Tiles"),
]
#: Named chains of effects, as rows (chain, position, effect, and one value for each of KEYS, 0 where the effect has none).
CHAIN_PRESETS = [
    ("Maximum privacy", 0, "Privacy Blur", 100, 34, 92, 15, 0, 0, 0), ("Maximum privacy", 1, "Noise Redaction", 100, 4, 2, 35, 90, 0, 0), ("Maximum privacy", 2, "Marker Scribble", 100, 24, 5, 82, -8, 0, 0),
    ("Face anonymizer", 0, "Privacy Blur", 100, 28, 84, 8, 0, 0, 0), ("Face anonymizer", 1, "Pixelate", 82, 26, 12, 12, 15, 0, 0),
    ("Deep pixel mosaic", 0, "Pixelate", 100, 34, 0, 8, 20, 0, 0), ("Deep pixel mosaic", 1, "Mosaic", 72, 24, 32, 58, 2, 0, 0),
    ("Frosted privacy", 0, "Privacy Blur", 72, 20, 70, 0, 0, 0, 0), ("Frosted privacy", 1, "Frosted Glass", 100, 10, 52, 36, 9, 0, 0),
    ("Faceted privacy", 0, "Privacy Blur", 55, 16, 55, 0, 0, 0, 0), ("Faceted privacy", 1, "Faceted Glass", 100, 34, 60, 36, 18, 0, 0),
    ("Encrypted glass", 0, "Encrypted Tiles", 100, 22, 94, 68, 32, 0, 0), ("Encrypted glass", 1, "Prism Split", 42, 8, 12, 35, 12, 0, 0),
    ("Document redaction", 0, "Black Redaction", 100, 20, 10, 8, 0, 0, 0), ("Document redaction", 1, "Redaction Tape", 58, 24, 4, 42, 0, 0, 0),
    ("Whiteout", 0, "White Redaction", 100, 20, 4, 3, 0, 0, 0),
    ("Printed censor", 0, "Halftone Dots", 100, 11, 10, 82, 15, 0, 0), ("Printed censor", 1, "Marker Scribble", 70, 14, 8, 52, -5, 0, 0),
    ("Barcode concealment", 0, "Privacy Blur", 65, 16, 68, 0, 0, 0, 0), ("Barcode concealment", 1, "Barcode Redaction", 100, 7, 2, 84, 0, 0, 0),
    ("Digital scramble", 0, "Encrypted Tiles", 88, 18, 78, 48, 18, 0, 0), ("Digital scramble", 1, "Glitch Blocks", 76, 12, 42, 72, 0, 0, 0), ("Digital scramble", 2, "CRT Distortion", 52, 6, 18, 22, 7, 0, 0),
    ("Prism interference", 0, "Wave Scramble", 72, 48, 20, 3, 12, 0, 0), ("Prism interference", 1, "Prism Split", 82, 16, 8, 45, -12, 0, 0),
    ("Anonymous silhouette", 0, "Privacy Blur", 62, 18, 70, 0, 0, 0, 0), ("Anonymous silhouette", 1, "Silhouette", 100, 8, 48, 88, 45, 0, 0),
    ("Photocopy mask", 0, "Photocopy", 100, 3, 54, 82, 28, 0, 0), ("Photocopy mask", 1, "Marker Scribble", 42, 10, 2, 35, 0, 0, 0),
    ("Thermal interference", 0, "Thermal Map", 100, 3, 84, 18, 68, 0, 0), ("Thermal interference", 1, "Glitch Blocks", 48, 10, 24, 38, 0, 0, 0),
    ("ASCII mask", 0, "Privacy Blur", 36, 14, 62, 0, 0, 0, 0), ("ASCII mask", 1, "ASCII Art", 100, 9, 66, 76, 72, 84, 0),
    ("Blueprint concealment", 0, "Blueprint", 100, 22, 16, 76, 34, 0, 0), ("Blueprint concealment", 1, "Halftone Dots", 22, 9, 0, 58, 15, 0, 0),
    ("Neon wireframe", 0, "Neon Edges", 100, 9, 82, 72, -22, 0, 0), ("Neon wireframe", 1, "Prism Split", 26, 7, 4, 18, -10, 0, 0),
    ("Topographic concealment", 0, "Topographic Lines", 100, 14, 14, 74, 2, 0, 0), ("Topographic concealment", 1, "Privacy Blur", 28, 10, 40, 0, 0, 0, 0),
]
#: Where an older specification keeps the size, by effect.
LEGACY_SIZE = {"Soft Blur": "blur", "Privacy Blur": "blur", "Pixelate": "pixel", "Mosaic": "mosaic"}


def parameter_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARAMETERS, "effect string, key string, low int, high int, default int")


def chain_table(spark: SparkSession) -> DataFrame:
    """The named chains: chain, position, name and KEYS, for broadcast joins."""
    return spark.createDataFrame(CHAIN_PRESETS, "chain string, position int, name string, " + ", ".join(f"{k} int" for k in KEYS))


def normalize_effect_specs(specs: DataFrame, spark: SparkSession) -> DataFrame:
    """Specifications (name, values: map of string to int) with the canonical name and all of KEYS.

    An unknown effect has the defaults of Soft Blur; missing keys come from the table; "strength" stands for a
    missing amount, and "pattern", "blur", "pixel" or "mosaic" for a missing size, by effect.
    """
    defaults = parameter_table(spark).groupBy("effect").agg(F.map_from_entries(F.collect_list(F.struct("key", "default"))).alias("_defaults"))
    names = spark.createDataFrame(ALIASES, "_alias string, _name string")
    rows = specs.join(F.broadcast(names), F.col("name") == F.col("_alias"), "left").withColumn("name", F.coalesce("_name", "name")).drop("_alias", "_name")
    rows = rows.join(F.broadcast(defaults), F.col("name") == F.col("effect"), "left")
    soft = {k: d for e, k, _, _, d in PARAMETERS if e == "Soft Blur"}
    fallback = F.create_map(*[F.lit(x) for pair in soft.items() for x in pair])
    base = F.coalesce("_defaults", fallback)
    given = lambda k: F.try_element_at("values", F.lit(k))
    legacy = given("pattern")
    for effect, key in LEGACY_SIZE.items():
        legacy = F.when(F.col("name") == effect, F.coalesce(given(key), given("pattern"))).otherwise(legacy)
    out = {}
    for key in KEYS:
        value = given(key)
        value = F.coalesce(value, given("strength")) if key == "amount" else F.coalesce(value, legacy) if key == "size" else value
        out[key] = F.coalesce(value, F.try_element_at(base, F.lit(key)), F.lit(0))
    return rows.select(*[c for c in specs.columns if c not in ("name", "values")], "name", *[v.alias(k) for k, v in out.items()])


def check_spec_ranges(specs: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows of `specs` whose parameters leave the table: with key, value, low, high. `unknown_effects` has those without limits."""
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in KEYS]))
    long = specs.select(*[c for c in specs.columns if c not in KEYS], entries.alias("e")).select("*", "e.key", "e.value").drop("e")
    limits = F.broadcast(parameter_table(spark).select(F.col("effect").alias("name"), "key", "low", "high"))
    return long.join(limits, ["name", "key"]).filter(~F.col("value").between(F.col("low"), F.col("high")))


def unknown_effects(specs: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows of `specs` whose effect has no row in the table, so that no range can be checked."""
    return specs.join(F.broadcast(parameter_table(spark).select(F.col("effect").alias("name")).distinct()), "name", "left_anti").select(*specs.columns)


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The steps in order; none is the identity, and a step that gives nothing is an error."""

    def chain(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
            if df is None:
                raise ValueError(f"{getattr(step, '__name__', step)} gave no table")
        return df

    return chain


def _mixed(pixels: DataFrame, channel: str, new: Column, amount: float) -> DataFrame:
    return pixels.withColumn(channel, F.floor(S.mix(F.col(channel), new, amount)).cast("int"))


def _refuse(spec: dict, **parts: str) -> None:
    """An error if the specification asks for a part of the effect that isn't built (keyed by parameter)."""
    for key, what in parts.items():
        if spec.get(key, 0):
            raise NotImplementedError(f"{spec['name']}: {what} ({key} {spec[key]}) is not built")


def _grid(pixels: DataFrame, tile: int, alpha: int, wide: int = 1) -> DataFrame:
    """Black lines `wide` pixels across, centred on the tiles' borders, over `luma` at an alpha of 255."""
    low, high = (wide - 1) // 2, wide // 2

    def on_line(at: str) -> Column:
        # The border at k * tile covers k * tile - low .. k * tile + high; the image's own edge has no border.
        border = F.floor((F.col(at) + low) / tile) * tile
        return (border > 0) & (F.col(at) <= border + high)

    return pixels.withColumn("luma", F.when(on_line("x") | on_line("y"), F.bround(F.col("luma") * (255 - alpha) / 255.0).cast("int")).otherwise(F.col("luma")))


def _onto(pixels: DataFrame, changed: DataFrame, amount: float) -> DataFrame:
    """`luma` of the pixels mixed with that of the changed picture."""
    both = pixels.select(*R.AT, "luma").join(changed.select(*R.AT, F.col("luma").alias("_changed")).hint("merge"), R.AT)
    return _mixed(both, "luma", F.col("_changed"), amount).drop("_changed")


def _noise(deviation: float, *seed: int | str) -> Column:
    """Normal noise of a pixel's place, the same in every picture; the generator is ours by design."""
    even = lambda k: (F.pmod(F.xxhash64(F.lit("/".join(map(str, seed))), F.lit(k), "x", "y"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return F.sqrt(-2 * F.log(even(0))) * F.cos(2 * math.pi * even(1)) * deviation


def _grained(changed: DataFrame, spec: dict, deviation: float, share: float) -> DataFrame:
    """A share of grey grain over `luma`."""
    if not spec.get("detail", 0):
        return changed
    return _mixed(changed, "luma", F.floor(S.clip(127.5 + _noise(deviation, *(spec.get(k, 0) for k in ("name", *KEYS))))), 100 * share)


def _pixelate(spec: dict, width: int, height: int) -> Callable[[DataFrame], DataFrame]:
    tile, soft, grid = max(2, spec["size"]), min(0.8, spec.get("softness", 0) / 125), spec.get("angle", 0)

    def step(pixels: DataFrame) -> DataFrame:
        tiled = R.tile_mean(pixels, "luma", tile)
        new = F.col("mean") if spec["detail"] >= 256 else S.quantize_levels(F.col("mean"), max(2, spec["detail"]))
        if not soft and not grid:
            return _mixed(tiled, "luma", new, spec["amount"]).drop("mean")
        changed = tiled.select(*R.AT, F.floor(new).cast("int").alias("luma"))
        if soft:
            changed = _onto(changed, R.tile_ramp(changed, "luma", tile, width, height), 100 * soft)
        return _onto(pixels, _grid(changed, tile, min(150, round(grid * 1.5))) if grid else changed, spec["amount"])

    return step


def _mosaic(spec: dict, width: int, height: int) -> Callable[[DataFrame], DataFrame]:
    """Tiles of a blurred picture under a grid."""
    tile, grid = max(3, spec["size"]), spec.get("detail", 0)

    def step(pixels: DataFrame) -> DataFrame:
        source = pixels
        if spec.get("softness"):
            source = R.gaussian(pixels, "luma", max(0.2, spec["softness"] / 12))
        tiled = R.tile_mean(source, "luma", tile)
        if not grid and source is pixels:
            return _mixed(tiled, "luma", F.col("mean"), spec["amount"]).drop("mean")
        changed = tiled.select(*R.AT, F.floor("mean").cast("int").alias("luma"))
        if grid:
            changed = _grid(changed, tile, min(190, round(grid * 1.9)), max(1, spec.get("angle", 1)))
        return _onto(pixels, changed, spec["amount"])

    return step


def _directional(spec: dict, width: int, height: int) -> Callable[[DataFrame], DataFrame]:
    grain = spec.get("detail", 0)

    def step(pixels: DataFrame) -> DataFrame:
        blurred = R.directional_mean(pixels, "luma", spec["size"], max(2, spec["softness"]), spec["angle"])
        return _onto(pixels, _grained(blurred.withColumnRenamed("mean", "luma"), spec, 2 + grain / 7, min(0.18, grain / 550)), spec["amount"])

    return step


def _blur(spec: dict, width: int, height: int) -> Callable[[DataFrame], DataFrame]:
    """Tiles as large as the detail to destroy, with ramps between them, then a Gaussian of the whole radius."""
    destruction, grain = spec.get("softness", 0) // (3 if spec["name"] == "Soft Blur" else 1), spec.get("detail", 0)
    factor = max(1, round(1 + destruction / 10))

    def step(pixels: DataFrame) -> DataFrame:
        source = pixels
        if factor > 1:
            source = R.tile_mean(pixels, "luma", factor).select(*R.AT, F.floor("mean").cast("int").alias("luma"))
            source = R.tile_ramp(source, "luma", factor, width, height)
        blurred = R.gaussian(source, "luma", max(0.25, float(spec["size"])))
        return _onto(pixels, _grained(blurred, spec, 4 + grain / 5, min(0.28, grain / 400)), spec["amount"])

    return step


def _solid(color: int) -> Callable[[dict, int, int], Callable[[DataFrame], DataFrame]]:
    """A redaction in one colour, with a wave of light and dark across an angle and grain."""

    def build(spec: dict, width: int, height: int) -> Callable[[DataFrame], DataFrame]:
        texture, grain = spec.get("softness", 0), spec.get("detail", 0)

        def step(pixels: DataFrame) -> DataFrame:
            turn = math.radians(spec.get("angle", 0))
            along = F.col("x") * F.lit(math.cos(turn)) + F.col("y") * F.lit(math.sin(turn))
            base = F.lit(float(color))
            if texture:
                base = base + F.sin(along * (2 * math.pi / max(2.0, spec.get("size", 20)))) * (texture / 7)
            if grain:
                base = base + _noise(max(0.5, grain / 7), *(spec.get(k, 0) for k in ("name", *KEYS)))
            return _mixed(pixels, "luma", F.floor(S.clip(base)), spec["amount"])

        return step

    return build


def _wave(spec: dict, width: int, height: int) -> Callable[[DataFrame], DataFrame]:
    """Rows across the direction shifted along it by a sum of sines."""
    turn = math.radians(spec["angle"])
    c, s = math.cos(turn), math.sin(turn)
    waves, length = max(1, min(6, spec["detail"])), max(4, spec["size"])

    def step(pixels: DataFrame) -> DataFrame:
        across = F.col("y") * F.lit(c) - F.col("x") * F.lit(s)
        total = F.lit(0.0)
        for k in range(1, waves + 1):
            total = total + F.sin(across * (2 * math.pi * k / length)) / k
        total = total * (max(0, spec["softness"]) / max(1.0, sum(1 / k for k in range(1, waves + 1))))
        dx, dy = F.col("x") - F.rint(F.col("x") - total * c), F.col("y") - F.rint(F.col("y") - total * s)
        return _mixed(R.displace(pixels, "luma", dx, dy, "_moved"), "luma", F.col("_moved"), spec["amount"]).drop("_moved")

    return step


def _tiles(spec: dict, width: int, height: int) -> Callable[[DataFrame], DataFrame]:
    """A seeded share of the tiles shows other tiles."""
    _refuse(spec, detail="rotation of tiles", angle="a shift of colours")
    tile, percent = max(4, spec["size"]), max(0, min(100, spec["softness"]))
    if percent and (width % tile or height % tile):
        raise NotImplementedError(f"{spec['name']}: tiles of {tile} that don't divide {width} x {height} are not built")

    def step(pixels: DataFrame) -> DataFrame:
        if not percent:
            return pixels
        return _onto(pixels, R.seeded_tile_shuffle(pixels, "luma", tile, percent, width * 73856093 ^ height * 19349663 ^ tile), spec["amount"])

    return step


def _barcode(spec: dict, width: int, height: int) -> Callable[[DataFrame], DataFrame]:
    """Bars across an angle, as wide in black as their band is dark."""
    turn = math.radians(spec["angle"])
    period = max(4, spec["size"] * 2)

    def step(pixels: DataFrame) -> DataFrame:
        along = F.col("x") * F.lit(math.cos(turn)) + F.col("y") * F.lit(math.sin(turn))
        banded = R.band_mean(pixels, "luma", period, spec["angle"])
        least = pixels.groupBy(R.ID).agg(F.min(along).alias("_least"))
        dark = S.clip((0.5 - F.col("mean") / 255.0) * (0.7 + spec["detail"] / 45) + 0.5, 0.0, 1.0)
        local = (along - F.col("_least")) / period - F.col("band")
        bars = banded.join(least.hint("merge"), R.ID).select(*R.AT, F.when(local < 0.12 + dark * 0.78, 10).otherwise(247).alias("luma"))
        if spec["softness"]:
            bars = R.gaussian(bars, "luma", spec["softness"] / 30)
        return _onto(pixels, bars, spec["amount"])

    return step


def _silhouette(spec: dict, width: int, height: int) -> Callable[[DataFrame], DataFrame]:
    """Two tones on either side of a share of the stretched range."""
    dark = max(0, min(100, spec["angle"]))
    edge = max(0, min(255, round(255 * spec["softness"] / 100)))

    def step(pixels: DataFrame) -> DataFrame:
        grey = R.gaussian(pixels, "luma", spec["size"] / 8) if spec["size"] else pixels
        spread = R.percentile_stretch(grey, "luma", max(0, round((100 - spec["detail"]) / 12)))
        return _onto(pixels, spread.select(*R.AT, S.two_tone(F.col("stretched"), edge, dark, 255 - dark).alias("luma")), spec["amount"])

    return step


def _grey(pixels: DataFrame) -> DataFrame:
    return pixels.select(*R.AT, S.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"))


def _mixed_colors(pixels: DataFrame, changed: DataFrame, amount: float) -> DataFrame:
    """r, g, b of the pixels mixed with those of the changed picture."""
    new = changed.select(*R.AT, *[F.col(c).alias(f"_{c}") for c in "rgb"])
    both = pixels.select(*R.AT, "r", "g", "b").join(new.hint("merge"), R.AT)
    return both.select(*R.AT, *[F.floor(S.mix(F.col(c), F.col(f"_{c}"), amount)).cast("int").alias(c) for c in "rgb"])


EDGES = [(dx, dy, 8 if dx == dy == 0 else -1) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def _thermal(spec: dict, width: int, height: int) -> Callable[[DataFrame], DataFrame]:
    """Grey as heat: three overlapping ramps, moved by a phase, darker along edges."""
    gain, phase, edges = 0.55 + spec["softness"] / 55, spec["detail"] / 100, spec["angle"]

    def step(pixels: DataFrame) -> DataFrame:
        grey = _grey(pixels)
        smooth = R.gaussian(grey, "luma", spec["size"] / 4) if spec["size"] else grey
        heat = S.clip((F.col("luma") / 255.0 - 0.5) * gain + 0.5, 0.0, 1.0)
        heat = F.pmod(F.round(heat + phase, 9), F.lit(1.0))
        table = smooth.select(*R.AT, heat.alias("_t"))
        shade = F.lit(1.0)
        if edges:
            # The outermost pixels have no full neighbourhood and keep their grey as their edge.
            found = R.stencil(grey, "luma", EDGES, "_edge")
            table = table.join(grey.join(found.hint("merge"), R.AT, "left").select(*R.AT, S.clip(F.coalesce("_edge", "luma")).alias("_edge")).hint("merge"), R.AT)
            shade = S.clip(1 - F.col("_edge") / 255.0 * (edges / 180), 0.3, 1.0)
        ramp = lambda at: S.clip(1.5 - F.abs(4 * F.col("_t") - at), 0.0, 1.0)
        colors = [F.floor(F.round(ramp(at) * shade * 255, 6)).cast("int").alias(c) for c, at in zip("rgb", (3, 2, 1), strict=True)]
        return _mixed_colors(pixels, table.select(*R.AT, *colors), spec["amount"])

    return step


def _prism(spec: dict, width: int, height: int) -> Callable[[DataFrame], DataFrame]:
    """Red and blue drawn apart along an angle, blurred, with more colour."""
    turn, far = math.radians(spec["angle"]), max(1, spec["size"])
    dx, dy = round(math.cos(turn) * far), round(math.sin(turn) * far)

    def step(pixels: DataFrame) -> DataFrame:
        out = pixels.select(*R.AT, "g")
        for c, way in (("r", 1), ("b", -1)):
            moved = R.displace(pixels.select(*R.AT, c), c, F.lit(way * dx), F.lit(way * dy), "_moved")
            out = out.join(moved.select(*R.AT, F.col("_moved").alias(c)).hint("merge"), R.AT)
        if spec["softness"]:
            parts = [R.gaussian(out.select(*R.AT, c), c, max(0.2, spec["softness"] / 18)) for c in "rgb"]
            out = parts[0].join(parts[1].hint("merge"), R.AT).join(parts[2].hint("merge"), R.AT)
        return _mixed_colors(pixels, R.adjust_colors(out, saturation=spec["detail"]), spec["amount"])

    return step


#: Effect -> builder of its step. An effect that isn't here is refused, never swapped for another.
STEPS = {
    "Pixelate": _pixelate, "Mosaic": _mosaic, "Directional Blur": _directional, "Soft Blur": _blur, "Privacy Blur": _blur,
    "Black Redaction": _solid(0), "White Redaction": _solid(255), "Wave Scramble": _wave, "Encrypted Tiles": _tiles, "Barcode Redaction": _barcode, "Silhouette": _silhouette,
}
#: Effects that need colours; and those that look at grey and give every channel the same picture.
COLOR_STEPS = {"Thermal Map": _thermal, "Prism Split": _prism}
FROM_GREY = {"Barcode Redaction", "Silhouette"}


def _step_of(spec: dict, width: int, height: int) -> Callable[[DataFrame], DataFrame]:
    if spec["name"] not in STEPS:
        raise NotImplementedError(f"{spec['name']}: the effect is not built")
    return STEPS[spec["name"]](spec, width, height)


def run_chain(pixels: DataFrame, specs: list[dict], width: int, height: int, box: tuple[int, int, int, int] | None = None, polygon: list[tuple[int, int]] | None = None) -> DataFrame:
    """Normalised specifications applied in order to `luma`, kept only where targeted; every frame gets the same chain.

    An effect, or a part of one, that isn't built raises NotImplementedError.
    """
    changed = compose(*[_step_of(s, width, height) for s in specs])(pixels.select(*R.AT, "luma"))
    if not specs:
        return changed
    both = pixels.select(*R.AT, "luma").join(changed.select(*R.AT, F.col("luma").alias("_new")).hint("merge"), R.AT)
    return R.apply_to_target(both, "luma", F.col("_new"), polygon, box).drop("_new")


def run_chain_colors(pixels: DataFrame, specs: list[dict], width: int, height: int, box: tuple[int, int, int, int] | None = None, polygon: list[tuple[int, int]] | None = None) -> DataFrame:
    """The same on r, g and b: effects of one channel go over each; every step is written, so that plans don't multiply."""
    steps = [COLOR_STEPS[s["name"]](s, width, height) if s["name"] in COLOR_STEPS else _on_channels(s, width, height) for s in specs]
    changed = original = pixels.select(*R.AT, "r", "g", "b")
    for k, step in enumerate(steps):
        changed = step(materialize(changed, "colors") if k else changed)
    if not specs:
        return changed
    new = changed.select(*R.AT, *[F.col(c).alias(f"_{c}") for c in "rgb"])
    both = original.join(new.hint("merge"), R.AT)
    hit = R.target_hit(polygon, box)
    return both.select(*R.AT, *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"])


def _on_channels(spec: dict, width: int, height: int) -> Callable[[DataFrame], DataFrame]:
    def step(pixels: DataFrame) -> DataFrame:
        if spec["name"] in FROM_GREY:
            changed = _step_of(spec | {"amount": 100}, width, height)(_grey(pixels))
            return _mixed_colors(pixels, changed.select(*R.AT, *[F.col("luma").alias(c) for c in "rgb"]), spec["amount"])
        build = _step_of(spec, width, height)
        parts = [build(pixels.select(*R.AT, F.col(c).alias("luma"))).select(*R.AT, F.col("luma").alias(c)) for c in "rgb"]
        return parts[0].join(parts[1].hint("merge"), R.AT).join(parts[2].hint("merge"), R.AT)

    return step


def preset_specs(name: str) -> list[dict]:
    """The specifications of a named chain, for `run_chain`."""
    found = [dict(zip(("name", *KEYS), row[2:], strict=True)) for row in sorted(CHAIN_PRESETS) if row[0] == name]
    if not found:
        raise KeyError(name)
    return found


def apply_on_clips(frames: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A user's function on the frames of each clip, in frame order."""

    def ordered(pdf):
        return fn(pdf.sort_values("frame_idx"))

    return frames.groupBy("clip_id").applyInPandas(ordered, schema)
