"""Clips as frames with durations in milliseconds: bounds, look-ups, slices, re-timing, extension, resampling.

All operators take and give rows of clip_id, frame_idx and duration_ms (and keep what else they can); windows
run within a clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mosaique.operators.scan import scan
from mosaique.session import materialize

#: Limits of import plans.
SOFT_FRAMES, SOFT_MS, HARD_FRAMES = 900, 60_000, 9_000
SOFT_PIXELS, HARD_PIXELS = 160_000_000, 1_000_000_000
KEY = "clip_id"


def clean_duration(d: Column) -> Column:
    """At least 10 ms; null and zero are 100."""
    return F.greatest(F.lit(10), F.coalesce(F.nullif(d, F.lit(0)), F.lit(100))).cast("long")


def clean_durations(frames: DataFrame) -> DataFrame:
    return frames.withColumn("duration_ms", clean_duration(F.col("duration_ms")))


def _order() -> Window:
    return Window.partitionBy(KEY).orderBy("frame_idx")


def frame_bounds(frames: DataFrame) -> DataFrame:
    """start_ms and end_ms of every frame, from cleaned durations."""
    bounded = scan(clean_durations(frames), [KEY], ["frame_idx"], sums={"end_ms": F.col("duration_ms")})
    return bounded.withColumn("start_ms", F.col("end_ms") - F.col("duration_ms"))


def clip_summary(frames: DataFrame) -> DataFrame:
    """clip_id, n_frames, total_ms; a single frame doesn't move and has 0."""
    counted = clean_durations(frames).groupBy(KEY).agg(F.count("*").alias("n_frames"), F.sum("duration_ms").alias("total_ms"))
    return counted.withColumn("total_ms", F.when(F.col("n_frames") > 1, F.col("total_ms")).otherwise(0))


def frame_at(frames: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (clip_id, position) with frame_idx: the last frame that starts at or before it, held within the clip.

    An as-of join as one sort: starts and positions in one stream, the last start seen wins, also over range partitions.
    """
    starts = frame_bounds(frames).select(KEY, F.col("start_ms").alias("_t"), F.lit(0).alias("_kind"), F.col("frame_idx").cast("long").alias("_frame"), F.lit(None).cast("long").alias("position"))
    asked = positions.select(KEY, F.greatest(F.col("position").cast("long"), F.lit(0)).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_frame"), F.col("position").cast("long"))
    both = scan(starts.unionByName(asked), [KEY], ["_t", "_kind", "_frame"], lasts={"frame_idx": F.col("_frame")})
    return both.filter("_kind = 1 and frame_idx is not null").select(KEY, "position", "frame_idx")


def frame_at_loop(frames: DataFrame, elapsed: DataFrame) -> DataFrame:
    """elapsed (clip_id, first, last, elapsed) with frame_idx: the frame on show when frames first..last repeat."""
    bounds = materialize(frame_bounds(frames).select(KEY, "frame_idx", "start_ms", "end_ms"), "bounds")
    ends = bounds.groupBy(KEY).agg(F.min("frame_idx").alias("_low"), F.max("frame_idx").alias("_high"))
    held = elapsed.join(ends.hint("merge"), KEY).withColumns({"_first": F.greatest("first", "_low"), "_last": F.least("last", "_high")}).filter("_first <= _last")
    # Only the two frames at the ends of a range are looked up.
    at = lambda name, bound, to: bounds.select(F.col(KEY).alias(f"{name}_clip"), F.col("frame_idx").alias(f"{name}_frame"), F.col(bound).alias(to)).hint("merge")
    per = held.join(at("_a", "start_ms", "_from"), (F.col(KEY) == F.col("_a_clip")) & (F.col("_first") == F.col("_a_frame")))
    per = per.join(at("_b", "end_ms", "_to"), (F.col(KEY) == F.col("_b_clip")) & (F.col("_last") == F.col("_b_frame")))
    per = per.select(KEY, "first", "last", "elapsed", (F.col("_from") + F.pmod(F.col("elapsed"), F.col("_to") - F.col("_from"))).alias("_t")).distinct()
    at = frame_at(frames, per.select(KEY, F.col("_t").alias("position")).distinct()).withColumnRenamed("position", "_t")
    return per.join(at.hint("merge"), [KEY, "_t"]).select(KEY, "first", "last", "elapsed", "frame_idx")


def stride_reduce(frames: DataFrame, stride: int) -> DataFrame:
    """Every stride-th frame, lasting as long as its block; the total stays."""
    block = F.floor(F.col("frame_idx") / stride)
    kept = clean_durations(frames).groupBy(KEY, block.alias("_block")).agg(F.min("frame_idx").alias("source_idx"), F.sum("duration_ms").alias("duration_ms"))
    return kept.select(KEY, F.col("_block").cast("long").alias("frame_idx"), "source_idx", "duration_ms")


def slice_clip(frames: DataFrame, start: Column, length: Column) -> DataFrame:
    """The frames in a stretch of each clip, with exact total; a single frame becomes two on the 10 ms grid."""
    whole = Window.partitionBy(KEY)
    rows = frame_bounds(frames).withColumn("_total", F.sum("duration_ms").over(whole))
    begin = F.greatest(F.lit(0), F.least(start.cast("long"), F.greatest(F.lit(0), F.col("_total") - 20)))
    rows = rows.withColumn("_begin", begin)
    rows = rows.withColumn("_length", F.greatest(F.lit(20), F.least(length.cast("long"), F.col("_total") - F.col("_begin"))))
    overlap = F.least(F.col("_begin") + F.col("_length"), F.col("end_ms")) - F.greatest(F.col("_begin"), F.col("start_ms"))
    hit = rows.withColumn("_overlap", overlap).filter("_overlap > 0").withColumn("_kept", F.greatest(F.lit(10), F.col("_overlap")))
    last = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("frame_idx"))) == 1
    hit = hit.withColumn("_sum", F.sum("_kept").over(whole)).withColumn("_n", F.count("*").over(whole)).withColumn("_last", last)
    hit = hit.withColumn("_kept", F.col("_kept") + F.when(F.col("_last"), F.col("_length") - F.col("_sum")).otherwise(0))
    first = F.greatest(F.lit(10), F.floor(F.col("_length") / 20) * 10)
    first = F.when(F.col("_length") - first < 10, first - 10).otherwise(first)
    parts = F.when(F.col("_n") == 1, F.array(first, F.col("_length") - first)).otherwise(F.array("_kept"))
    out = hit.select(KEY, F.col("frame_idx").alias("source_idx"), F.posexplode(parts).alias("_part", "duration_ms"))
    order = Window.partitionBy(KEY).orderBy("source_idx", "_part")
    return out.select(KEY, (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), "source_idx", F.col("duration_ms").cast("long").alias("duration_ms"))


def retime(frames: DataFrame, target_ms: Column) -> DataFrame:
    """Durations in 10 ms ticks that add up to the target: one tick each, the rest by largest remainder.

    Clips whose target has fewer ticks than frames have no result (see `retime_rejects`).
    """
    whole = Window.partitionBy(KEY)
    rows = _ticks(frames, target_ms).filter("_ticks >= _n").withColumn("_rest", F.col("_ticks") - F.col("_n"))
    rows = rows.withColumn("_share", F.expr("(_rest * duration_ms) div _total")).withColumn("_remainder", F.expr("(_rest * duration_ms) % _total"))
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("_remainder"), "frame_idx"))
    extra = F.when(rank <= F.col("_rest") - F.sum("_share").over(whole), 1).otherwise(0)
    return rows.select(KEY, "frame_idx", ((1 + F.col("_share") + extra) * 10).alias("duration_ms"))


def _ticks(frames: DataFrame, target_ms: Column) -> DataFrame:
    whole = Window.partitionBy(KEY)
    rows = clean_durations(frames).withColumn("_total", F.sum("duration_ms").over(whole)).withColumn("_n", F.count("*").over(whole))
    return rows.withColumn("_ticks", F.greatest(F.lit(2), F.bround(target_ms / 10).cast("long")))


def retime_rejects(frames: DataFrame, target_ms: Column) -> DataFrame:
    """clip_id, n_frames, least_ms of clips whose target is too short."""
    return _ticks(frames, target_ms).filter("_ticks < _n").groupBy(KEY).agg(F.max("_n").alias("n_frames"), (F.max("_n") * 10).alias("least_ms"))


def even_durations(clips: DataFrame) -> DataFrame:
    """frame_idx and duration_ms for clips (clip_id, total_ms, n_frames): equal 10 ms ticks, the first frames take what is over."""
    rows = clips.withColumn("_ticks", F.greatest(F.greatest(F.lit(1), F.col("n_frames")), F.bround(F.greatest(F.lit(10), F.col("total_ms")) / 10).cast("long")))
    rows = rows.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.col("n_frames")).cast("long") - 1)))
    n = F.greatest(F.lit(1), F.col("n_frames"))
    more = F.when(F.col("frame_idx") < F.col("_ticks") % n, 1).otherwise(0)
    return rows.select(KEY, "frame_idx", ((F.floor(F.col("_ticks") / n) + more) * 10).alias("duration_ms"))


def _extension(frames: DataFrame, target_ms: Column, first: int, last: int | None) -> DataFrame:
    """Frames with the cycle they belong to and how the extension divides; only clips that move and get longer."""
    whole = Window.partitionBy(KEY)
    rows = clean_durations(frames).withColumn("_total", F.sum("duration_ms").over(whole)).withColumn("_n", F.count("*").over(whole))
    rows = rows.withColumn("_target", target_ms.cast("long")).filter("_n > 1 and _target > _total")
    low = F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.lit(first)))
    high = F.greatest(low, F.least(F.col("_n") - 1, F.lit(last) if last is not None else F.col("_n") - 1))
    rows = rows.withColumn("_in", F.col("frame_idx").between(low, high))
    cycle = F.when(F.col("_in"), F.col("duration_ms")).otherwise(0)
    rows = rows.withColumn("_cycle_ms", F.sum(cycle).over(whole)).withColumn("_cycle_n", F.count_if("_in").over(whole))
    rows = rows.withColumn("_full", F.expr("(_target - _total) div _cycle_ms")).withColumn("_over", F.expr("(_target - _total) % _cycle_ms"))
    rows = rows.withColumn("_left", F.col("_over") - F.coalesce(F.sum(cycle).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn("_partial", F.col("_in") & (F.col("_left") >= 10))


def extend_repeat(frames: DataFrame, target_ms: Column, first: int = 0, last: int | None = None) -> DataFrame:
    """Clips made longer by repeating frames first..last: whole cycles, then a part of one; under 10 ms go to the last frame."""
    rows = _extension(frames, target_ms, first, last)
    own = rows.select(KEY, F.lit(0).cast("long").alias("_round"), F.col("frame_idx").alias("source_idx"), "duration_ms")
    cycles = rows.filter("_in and _full > 0").select(KEY, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_full"))).alias("_round"), F.col("frame_idx").alias("source_idx"), "duration_ms")
    part = rows.filter("_partial").select(KEY, (F.col("_full") + 1).alias("_round"), F.col("frame_idx").alias("source_idx"), F.least("duration_ms", "_left").alias("duration_ms"))
    every = own.unionByName(cycles).unionByName(part)
    targets = rows.groupBy(KEY).agg(F.max("_target").alias("_target"))
    every = every.join(targets.hint("merge"), KEY)
    at = F.row_number().over(Window.partitionBy(KEY).orderBy("_round", "source_idx"))
    every = every.withColumn("frame_idx", (at - 1).cast("long")).withColumn("_sum", F.sum("duration_ms").over(Window.partitionBy(KEY))).withColumn("_n", F.count("*").over(Window.partitionBy(KEY)))
    short = F.when(F.col("frame_idx") == F.col("_n") - 1, F.col("_target") - F.col("_sum")).otherwise(0)
    return every.select(KEY, "frame_idx", "source_idx", (F.col("duration_ms") + short).alias("duration_ms"))


def extend_hold(frames: DataFrame, target_ms: Column) -> DataFrame:
    """Clips made longer by holding the last frame."""
    whole = Window.partitionBy(KEY)
    rows = clean_durations(frames).withColumn("_total", F.sum("duration_ms").over(whole)).withColumn("_n", F.count("*").over(whole)).withColumn("_target", target_ms.cast("long"))
    rows = rows.filter("_n > 1 and _target > _total")
    extra = F.when(F.col("frame_idx") == F.max("frame_idx").over(whole), F.col("_target") - F.col("_total")).otherwise(0)
    return rows.select(KEY, "frame_idx", (F.col("duration_ms") + extra).alias("duration_ms"))


def extension_limit(frames: DataFrame, target_ms: Column, pixels: Column, max_frames: int = HARD_FRAMES, budget: int = 1_000_000, first: int = 0, last: int | None = None) -> DataFrame:
    """clip_id, projected (frames after `extend_repeat`), frame_limit, allowed."""
    rows = _extension(frames, target_ms, first, last).withColumn("_pixels", pixels.cast("long"))
    per = rows.groupBy(KEY).agg(F.max("_n").alias("_n"), F.max("_full").alias("_full"), F.max("_cycle_n").alias("_cycle_n"), F.count_if("_partial").alias("_part"), F.max("_pixels").alias("_pixels"))
    per = per.withColumn("projected", F.col("_n") + F.col("_full") * F.col("_cycle_n") + F.col("_part"))
    fits = F.greatest(F.col("_n"), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("_pixels"))))
    per = per.withColumn("frame_limit", F.greatest(F.col("_n"), F.least(F.lit(max_frames).cast("long"), fits)))
    return per.select(KEY, "projected", "frame_limit", (F.col("projected") <= F.col("frame_limit")).alias("allowed"))


def resample_fps(frames: DataFrame, fps: int = 0) -> DataFrame:
    """Frames repeated for a constant rate: given, or from the shortest frame (16 to 100 ms)."""
    rows = clean_durations(frames).withColumn("_step", F.greatest(F.lit(16), F.least(F.lit(100), F.min("duration_ms").over(Window.partitionBy(KEY)))))
    rate = F.lit(fps) if fps else F.least(F.lit(60), F.greatest(F.lit(1), F.bround(1000 / F.col("_step"))))
    repeats = F.greatest(F.lit(1), F.bround(F.col("duration_ms") * rate / 1000)).cast("int")
    rows = rows.select(KEY, F.col("frame_idx").alias("source_idx"), rate.cast("int").alias("fps"), F.explode(F.sequence(F.lit(1), repeats)).alias("_k"))
    order = Window.partitionBy(KEY).orderBy("source_idx", "_k")
    return rows.select(KEY, (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), "source_idx", "fps")


def filmstrip(frames: DataFrame, n: int) -> DataFrame:
    """clip_id, slot, position, frame_idx of n (2 to 24) even samples over each clip."""
    n = max(2, min(24, n))
    totals = clean_durations(frames).groupBy(KEY).agg(F.greatest(F.lit(20), F.sum("duration_ms")).alias("_total"))
    slots = totals.select(KEY, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"), "_total")
    slots = slots.select(KEY, "slot", F.bround(F.greatest(F.lit(0), F.col("_total") - 50) * F.col("slot") / (n - 1)).cast("long").alias("position"))
    at = frame_at(frames, slots.select(KEY, "position").distinct())
    return slots.join(at.hint("merge"), [KEY, "position"]).select(KEY, "slot", "position", "frame_idx")


def plan_import_reduction(clips: DataFrame) -> DataFrame:
    """stride, scale, reduced and rejected for clips (n_frames, total_ms, width, height)."""
    n, ms = F.greatest(F.lit(1), F.col("n_frames")), F.greatest(F.lit(1), F.col("total_ms"))
    stride = F.greatest(F.lit(1), F.ceil(n / SOFT_FRAMES), F.ceil(ms / SOFT_MS))
    rows = clips.withColumn("_n", n).withColumn("_stride", stride)
    over = F.ceil(F.col("_n") / F.col("_stride")) > HARD_FRAMES
    rows = rows.withColumn("stride", F.when(over, F.greatest(F.col("_stride"), F.ceil(F.col("_n") / HARD_FRAMES))).otherwise(F.col("_stride")).cast("long"))
    pixels = F.greatest(F.lit(1), F.col("width")).cast("long") * F.greatest(F.lit(1), F.col("height")) * F.greatest(F.lit(1), F.ceil(F.col("_n") / F.col("stride")))
    rows = rows.withColumn("_pixels", pixels)
    soft = F.when(F.col("_pixels") > SOFT_PIXELS, F.least(F.lit(1.0), F.sqrt(SOFT_PIXELS / F.col("_pixels")))).otherwise(1.0)
    rows = rows.withColumn("_scale", F.least(soft, F.sqrt(HARD_PIXELS / F.col("_pixels"))))
    rows = rows.withColumn("rejected", F.col("_scale") < 0.2).withColumn("scale", F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.col("_scale"))))
    rows = rows.withColumn("reduced", (F.col("stride") > 1) | (F.col("scale") < 0.999))
    return rows.drop("_n", "_stride", "_pixels", "_scale")


def plan_edit_reduction(clips: DataFrame, budget: int) -> DataFrame:
    """stride and scale that keep clips (n_frames, total_ms, width, height) within a budget of pixels.

    Frames go first, down to ten a second, then size; under half size more frames go; the last resort is
    the smallest stride that fits at a quarter.
    """
    n, area = F.col("n_frames").cast("long"), F.col("width").cast("long") * F.col("height")
    rows = clips.withColumn("_all", F.greatest(F.lit(1), n * area)).withColumn("_area", area)
    rate = n * 1000 / F.greatest(F.lit(1), F.col("total_ms"))
    stride = F.least(F.greatest(F.lit(1), F.ceil(F.col("_all") / budget)), F.greatest(F.lit(1), F.floor(rate / 10.0)))
    half = F.ceil(n / 2)

    def kept(s: Column) -> Column:
        return F.greatest(F.lit(2), F.ceil(n / s))

    def fit(s: Column) -> Column:
        return F.least(F.lit(1.0), F.sqrt(budget / F.greatest(F.lit(1), F.col("_area") * kept(s))))

    rows = rows.withColumn("_s", stride).withColumn("_scale", fit(F.col("_s")))
    at_half = F.greatest(F.lit(2), F.floor(budget / F.greatest(F.lit(1), F.floor(F.col("_area") * 0.25))))
    small = (F.col("_scale") < 0.5) & (n > 2)
    rows = rows.withColumn("_s", F.when(small, F.least(F.greatest(F.col("_s"), F.ceil(n / at_half)), F.greatest(F.lit(1), half))).otherwise(F.col("_s")))
    rows = rows.withColumn("_scale", F.greatest(F.lit(0.25), F.when(small, fit(F.col("_s"))).otherwise(F.col("_scale"))))
    # The most frames that fit, checked where the division may have been rounded; the smallest stride that keeps so few follows.
    one = lambda frames: F.col("_area") * frames * F.col("_scale") * F.col("_scale")
    most = F.floor(budget / one(F.lit(1)))
    most = F.when(one(most + 1) <= budget, most + 1).when(one(most) > budget, most - 1).otherwise(most)
    rows = rows.withColumn("_most", F.when(F.col("_area") > 0, most).otherwise(n))
    longest = F.greatest(F.col("_s"), half)
    wanted = F.when(F.col("_most") >= 2, F.greatest(F.col("_s"), F.ceil(n / F.col("_most"))))
    rows = rows.withColumn("_s", F.when(wanted <= longest, wanted).otherwise(longest))
    fine = F.col("_all") <= budget
    scale = F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.col("_scale"), F.sqrt(budget / F.greatest(F.lit(1), F.col("_area") * kept(F.col("_s"))))))
    rows = rows.withColumn("stride", F.when(fine, 1).otherwise(F.greatest(F.lit(1), F.col("_s"))).cast("long")).withColumn("scale", F.when(fine, 1.0).otherwise(scale))
    return rows.drop("_all", "_area", "_s", "_scale", "_most")
