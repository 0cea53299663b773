"""Scalar functions: Column -> Column, built from Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Score weights of the mean hash, the difference hash and the histogram, in percent.
WEIGHT_A, WEIGHT_D, WEIGHT_H = 38, 42, 20


def pack_bits(bits: Column) -> Column:
    """An integer from an array of booleans, first element highest. 64 elements use the sign bit."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda n, b: F.shiftleft(n, 1).bitwiseOR(b.cast("long")))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two integers."""
    return F.bit_count(a.bitwiseXOR(b))


def hist_l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two histograms."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def visual_score(ha: Column, hd: Column, l1: Column, a_bits: int = 64, d_bits: int = 64, l1_scale: float = 6.0) -> Column:
    """Similarity of two rasters, 0 to 100 with two decimals."""
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - l1 / l1_scale))
    raw = (0.38 * (1 - ha / a_bits) + 0.42 * (1 - hd / d_bits) + 0.20 * near) * 100
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2)


def within_hash_bound(ha: Column, hd: Column, threshold: int, a_bits: int = 64, d_bits: int = 64) -> Column:
    """Could the pair reach the threshold with equal histograms? Integers only, so exact."""
    return WEIGHT_A * d_bits * ha + WEIGHT_D * a_bits * hd <= a_bits * d_bits * (100 - threshold)


def format_bytes(n: Column) -> Column:
    """1024 steps from B to TB: bytes whole, the rest with two decimals."""
    return _bytes(n, "%.2f")


def human_file_size(n: Column) -> Column:
    """As `format_bytes` with one decimal; negative sizes count as zero."""
    return _bytes(F.greatest(n, F.lit(0)), "%.1f")


def _bytes(n: Column, form: str) -> Column:
    value, places = n.cast("double"), int(form[2])
    short = lambda v: F.bround(v, places)  # noqa: E731  (ties go to the even digit)
    out = F.when(value < 1024, F.format_string("%d B", n.cast("long")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(value < 1024.0 ** (power + 1), F.format_string(f"{form} {unit}", short(value / 1024.0**power)))
    return out.otherwise(F.format_string(f"{form} TB", short(value / 1024.0**4)))


def format_ms(ms: Column) -> Column:
    """m:ss.ss, or h:mm:ss.ss from an hour on; negative counts as zero."""
    safe = F.greatest(ms, F.lit(0)).cast("long")
    minutes = F.floor(safe / 60000)
    seconds = (safe - minutes * 60000) / 1000
    short = F.format_string("%d:%05.2f", minutes, seconds)
    return F.when(minutes >= 60, F.format_string("%d:%02d:%05.2f", F.floor(minutes / 60), minutes % 60, seconds)).otherwise(short)


#: Fixed value: the form of a version text.
VERSION = r"(?i)^\s*v?(\d+)\.(\d+)\.(\d+)(?:[\s._-]*rc[\s._-]*(\d+))?\s*$"


def version_key(text: Column) -> Column:
    """struct(major, minor, patch, stable, rc) that sorts as versions do; null for anything else."""
    part = lambda k: F.try_to_number(F.regexp_extract(text, VERSION, k), F.lit("999999999")).cast("int")
    candidate = F.regexp_extract(text, VERSION, 4)
    key = F.struct(
        part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"),
        F.when(candidate == "", 1).otherwise(0).alias("stable"), F.when(candidate == "", 0).otherwise(part(4)).alias("rc"),
    )
    return F.when(text.rlike(VERSION), key)


def digest_ok(content: Column, digest: Column) -> Column:
    """An empty digest is fine; otherwise it must be sha256:<hex> of the content, in any case."""
    given = F.coalesce(digest, F.lit(""))
    algorithm, expected = F.lower(F.substring_index(given, ":", 1)), F.lower(F.substring_index(given, ":", -1))
    valid = given.contains(":") & (algorithm == "sha256") & (expected != "")
    return F.when(given == "", True).otherwise(valid & (F.sha2(content, 256) == expected))


def mix_seed(width: Column, height: Column, *values: Column | int) -> Column:
    """A 32-bit seed from a size and some integers."""
    seed = (width.cast("long") * 73856093).bitwiseXOR(height.cast("long") * 19349663)
    for value in values:
        value = value if isinstance(value, Column) else F.lit(value)
        seed = seed.bitwiseXOR(value.cast("long") * 83492791)
    return seed.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def megapixels(width: Column, height: Column) -> Column:
    return width.cast("long") * height / 1e6


def path_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def path_parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normal_path(path: Column) -> Column:
    """The path without `.`, `..` and repeated slashes; what stands before a scheme's first slash stays, and nothing lies above a root.

    A relative path keeps the `..` that lead out of it; an empty one is `.`.
    """
    scheme = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)", 1)
    rest = F.substr(path, F.length(scheme) + 1)
    rooted = rest.startswith("/") | (scheme != "")

    def fold(held: Column, part: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        up = F.when(last.isNull() & rooted, held).when(last.isNull() | (last == ".."), F.array_append(held, part)).otherwise(F.slice(held, 1, F.size(held) - 1))
        return F.when(part.isin("", "."), held).when(part == "..", up).otherwise(F.array_append(held, part))

    parts = F.array_join(F.aggregate(F.split(rest, "/"), F.array().cast("array<string>"), fold), "/")
    return F.when(rooted, F.concat(scheme, F.lit("/"), parts)).otherwise(F.when(parts == "", ".").otherwise(parts))


def path_suffix(path: Column) -> Column:
    """With the dot; empty without one, or if the name only starts with it."""
    return F.regexp_extract(path_name(path), r"^.+(\.[^.]+)$", 1)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(path_name(path), r"(?<=.)\.[^.]+$", "")


def parse_hex_color(text: Column) -> Column:
    """struct(r, g, b) of #RRGGBB; null for anything else."""
    channel = lambda at: F.conv(F.substring(text, at, 2), 16, 10).cast("int")
    return F.when(text.rlike("^#[0-9A-Fa-f]{6}$"), F.struct(channel(2).alias("r"), channel(4).alias("g"), channel(6).alias("b")))


def clip(value: Column, low: float | int = 0, high: float | int = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def quantize_levels(value: Column, levels: int) -> Column:
    """The nearest of `levels` equal steps over 0..255, rounded half to even, cut to an integer."""
    step = 255.0 / (levels - 1)
    return F.floor(clip(F.bround(value / step) * step, 0, 255)).cast("int")


def posterize(value: Column, bits: int) -> Column:
    """Only the highest bits stay."""
    return value.cast("int").bitwiseAND(F.lit(255 & ~((1 << (8 - bits)) - 1)))


def two_tone(value: Column, threshold: int, dark: int, light: int) -> Column:
    return F.when(value >= threshold, light).otherwise(dark)


#: Stops of the false colour palette (position, red, green, blue).
THERMAL_STOPS = [(0.0, 0, 0, 20), (0.2, 0, 40, 210), (0.42, 20, 220, 255), (0.65, 240, 255, 30), (0.82, 255, 80, 0), (1.0, 255, 255, 255)]


def palette_map(value: Column, channel: int, stops: list[tuple] = THERMAL_STOPS) -> Column:
    """Piecewise linear colour of a value in 0..1; channel 0, 1, 2 is red, green, blue."""
    out = F.when(value <= stops[0][0], F.lit(float(stops[0][channel + 1])))
    for low, high in zip(stops, stops[1:], strict=False):
        slope = (high[channel + 1] - low[channel + 1]) / (high[0] - low[0])
        out = out.when(value <= high[0], low[channel + 1] + (value - low[0]) * slope)
    return F.floor(out.otherwise(float(stops[-1][channel + 1]))).cast("int")


def mix(source: Column, processed: Column, percent: Column | int) -> Column:
    """Linear blend; the share is held within 0..100."""
    share = clip(percent if isinstance(percent, Column) else F.lit(percent), 0, 100) / 100.0
    return source + (processed - source) * share


def flatten(value: Column, alpha: Column, background: int = 255) -> Column:
    """A channel over a background."""
    return F.bround((value * alpha + background * (255 - alpha)) / 255.0).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey of a colour (fixed weights 299, 587, 114 of 1000), rounded half up."""
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000).cast("int")


def invert(value: Column) -> Column:
    return 255 - value


def solid_fill(value: Column, color: int, opacity: int) -> Column:
    """A constant over the value at an opacity in percent."""
    return F.bround(mix(value, F.lit(color), opacity)).cast("int")


def brightness(value: Column, percent: int) -> Column:
    return clip(value * max(0.0, 1 + percent / 100))


def toward(value: Column, other: Column, percent: int) -> Column:
    """Contrast (other: the image's mean grey) or saturation (other: the pixel's grey)."""
    return clip(other + (value - other) * max(0.0, 1 + percent / 100))
