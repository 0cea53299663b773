"""Clips: bounds, look-ups, slices, re-timing, extension, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mosaique.operators import timeline as T
from mosaique.registry import query
from mosaique.sources import views

FR = views.FRAMES_SQL
_CLEAN = """
c as (select clip_id, frame_idx, greatest(10, coalesce(nullif(duration_ms, 0), 100)) as d from v_frames)"""
_BOUNDS = """
b as (select *, e - d as s, sum(d) over (partition by clip_id) as total, count(*) over (partition by clip_id) as n
  from (select *, cast(sum(d) over (partition by clip_id order by frame_idx) as bigint) as e from c))"""


@query("""select clip_id, frame_idx, cast(greatest(10, coalesce(nullif(case when frame_idx % 7 = 0 then 0 when frame_idx % 11 = 0 then null else duration_ms end, 0), 100)) as bigint) as duration_ms from v_frames""", FR)
def clean_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = views.frames(spark, sf_dir).withColumn("duration_ms", F.expr("case when frame_idx % 7 = 0 then 0 when frame_idx % 11 = 0 then null else duration_ms end"))
    return T.clean_durations(dirty).select("clip_id", "frame_idx", "duration_ms")


@query("select clip_id, frame_idx, s as start_ms, e as end_ms from b", FR, _CLEAN, _BOUNDS)
def frame_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.frame_bounds(views.frames(spark, sf_dir)).select("clip_id", "frame_idx", "start_ms", "end_ms")


@query("select clip_id, count(*) as n_frames, cast(case when count(*) > 1 then sum(d) else 0 end as bigint) as total_ms from c group by clip_id", FR, _CLEAN)
def clip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clip_summary(views.frames(spark, sf_dir))


_ASKED = "asked as (select distinct clip_id, cast(total * k // 7 + case when k = 8 then 100 when k = 0 then -50 else 0 end as bigint) as position from b, range(0, 9) r(k) where frame_idx = 0)"


@query("select a.clip_id, position, max(frame_idx) as frame_idx from asked a join b on a.clip_id = b.clip_id and s <= greatest(0, position) group by a.clip_id, position", FR, _CLEAN, _BOUNDS, _ASKED)
def frame_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.frames(spark, sf_dir)
    totals = T.clean_durations(frames).groupBy("clip_id").agg(F.sum("duration_ms").alias("total"))
    asked = totals.select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"), "total").selectExpr("clip_id", "(total * k) div 7 + case when k = 8 then 100 when k = 0 then -50 else 0 end as position").distinct()
    return T.frame_at(frames, asked)


@query("""select clip_id, first, last, elapsed, (select max(frame_idx) from b x where x.clip_id = q.clip_id and x.s <= q.lo + q.elapsed % (q.hi - q.lo)) as frame_idx from
  (select clip_id, cast(least(1, max(n) - 1) as int) as first, cast(greatest(least(1, max(n) - 1), max(n) - 2) as int) as last, min(s) filter (where frame_idx = least(1, n - 1)) as lo,
     max(e) filter (where frame_idx = greatest(least(1, n - 1), n - 2)) as hi, cast(case when max(n) > 1 then max(total) else 0 end * 3 + 12345 as bigint) as elapsed from b group by clip_id) q""", FR, _CLEAN, _BOUNDS)
def frame_at_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.frames(spark, sf_dir)
    first, n = F.least(F.lit(1), F.col("n_frames") - 1), F.col("n_frames")
    asked = T.clip_summary(frames).select("clip_id", first.cast("int").alias("first"), F.greatest(first, n - 2).cast("int").alias("last"), (F.col("total_ms") * 3 + 12345).alias("elapsed"))
    return T.frame_at_loop(frames, asked)


@query("select clip_id, frame_idx // 3 as frame_idx, min(frame_idx) as source_idx, cast(sum(d) as bigint) as duration_ms from c group by clip_id, frame_idx // 3", FR, _CLEAN)
def stride_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stride_reduce(views.frames(spark, sf_dir), 3)


@query("""select clip_id, row_number() over (partition by clip_id order by frame_idx, part) - 1 as frame_idx, frame_idx as source_idx, cast(d2 as bigint) as duration_ms from (
  select clip_id, frame_idx, part, case when m = 1 then case when part = 0 then f1 else len - f1 end else kept + case when frame_idx = mx then len - sm else 0 end end as d2 from (
  select *, case when len - f0 < 10 then f0 - 10 else f0 end as f1 from (
  select *, greatest(10, len // 20 * 10) as f0, count(*) over (partition by clip_id) as m, sum(kept) over (partition by clip_id) as sm, max(frame_idx) over (partition by clip_id) as mx from (
  select *, greatest(10, least(beg + len, e) - greatest(beg, s)) as kept from (
  select *, greatest(20, least(cast(2000 + clip_id % 5 * 90000000 as bigint), total - beg)) as len from (
  select *, greatest(0, least(cast(clip_id % 50 * 40000000 as bigint), greatest(0, total - 20))) as beg from b)) where least(beg + len, e) - greatest(beg, s) > 0))), (values (0), (1)) p(part)
  where part = 0 or m = 1)""", FR, _CLEAN, _BOUNDS)
def slice_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.slice_clip(views.frames(spark, sf_dir), F.col("clip_id") % 50 * 40000000, 2000 + F.col("clip_id") % 5 * 90000000)


_RETIME = "ticks as (select *, greatest(2, cast(round_even((n * (5 + clip_id % 3 * 10) + 7) / 10.0::double, 0) as bigint)) as tk from b)"


@query("""select clip_id, frame_idx, cast((1 + share + case when rk <= rest - ss then 1 else 0 end) * 10 as bigint) as duration_ms from (
  select *, sum(share) over (partition by clip_id) as ss, row_number() over (partition by clip_id order by rem desc, frame_idx) as rk from (
  select *, rest * d // total as share, rest * d % total as rem from (select *, tk - n as rest from ticks where tk >= n)))""", FR, _CLEAN, _BOUNDS, _RETIME)
def retime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.retime(views.frames(spark, sf_dir), F.col("_n") * (5 + F.col("clip_id") % 3 * 10) + 7)


@query("select clip_id, max(n) as n_frames, max(n) * 10 as least_ms from ticks where tk < n group by clip_id", FR, _CLEAN, _BOUNDS, _RETIME)
def retime_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.retime_rejects(views.frames(spark, sf_dir), F.col("_n") * (5 + F.col("clip_id") % 3 * 10) + 7)


@query("""select clip_id, i as frame_idx, cast((tk // n + case when i < tk % n then 1 else 0 end) * 10 as bigint) as duration_ms from
  (select clip_id, n, greatest(n, cast(round_even(greatest(10, clip_id % 40 * 37) / 10.0::double, 0) as bigint)) as tk from b where frame_idx = 0) q, range(0, 10000) r(i) where i < n""", FR, _CLEAN, _BOUNDS)
def even_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = T.clip_summary(views.frames(spark, sf_dir)).select("clip_id", "n_frames", (F.col("clip_id") % 40 * 37).alias("total_ms"))
    return T.even_durations(clips)


_EXT = """
x as (select *, cast(total * 5 // 2 + 3 as bigint) as target, frame_idx between least(n - 1, 1) and greatest(least(n - 1, 1), least(n - 1, 6)) as inn from b where n > 1),
y as (select *, cast(sum(case when inn then d else 0 end) over (partition by clip_id) as bigint) as cyc, count(*) filter (where inn) over (partition by clip_id) as cn,
  coalesce(cast(sum(case when inn then d else 0 end) over (partition by clip_id order by frame_idx rows between unbounded preceding and 1 preceding) as bigint), 0) as before from x),
z as (select *, (target - total) // cyc as ful, (target - total) % cyc - before as lft from y)"""


@query("""select clip_id, frame_idx, source_idx, cast(d + case when frame_idx = m - 1 then target - sm else 0 end as bigint) as duration_ms from (
  select *, row_number() over (partition by clip_id order by rnd, source_idx) - 1 as frame_idx, count(*) over (partition by clip_id) as m, sum(d) over (partition by clip_id) as sm from (
  select clip_id, 0 as rnd, frame_idx as source_idx, d, target from z
  union all select clip_id, unnest(range(1, cast(ful + 1 as bigint))), frame_idx, d, target from z where inn
  union all select clip_id, ful + 1, frame_idx, least(d, lft), target from z where inn and lft >= 10))""", FR, _CLEAN, _BOUNDS, _EXT)
def extend_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.extend_repeat(views.frames(spark, sf_dir), F.expr("_total * 5 div 2 + 3"), 1, 6)


@query("select clip_id, frame_idx, cast(d + case when frame_idx = n - 1 then total * 5 // 2 + 3 - total else 0 end as bigint) as duration_ms from b where n > 1", FR, _CLEAN, _BOUNDS)
def extend_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.extend_hold(views.frames(spark, sf_dir), F.expr("_total * 5 div 2 + 3"))


@query("""select clip_id, projected, lim as frame_limit, projected <= lim as allowed from (select clip_id, max(n) + max(ful) * max(cn) + count(*) filter (where inn and lft >= 10) as projected,
  greatest(max(n), least(9000, greatest(max(n), 1000000 // greatest(1, 4096 * (1 + clip_id % 9))))) as lim from z group by clip_id)""", FR, _CLEAN, _BOUNDS, _EXT)
def extension_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.extension_limit(views.frames(spark, sf_dir), F.expr("_total * 5 div 2 + 3"), 4096 * (1 + F.col("clip_id") % 9), first=1, last=6)


_SHORT = "short as (select clip_id, frame_idx, 10 + duration_ms % 400 as d from v_frames)"


@query("""select clip_id, row_number() over (partition by clip_id order by source_idx, k) - 1 as frame_idx, source_idx, fps from (
  select clip_id, frame_idx as source_idx, cast(fps as int) as fps, unnest(range(1, greatest(1, cast(round_even(d * fps / 1000::double, 0) as int)) + 1)) as k from (
  select *, least(60, greatest(1, round_even(1000 / greatest(16, least(100, min(d) over (partition by clip_id)))::double, 0))) as fps from short))""", FR, _SHORT)
def resample_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.resample_fps(views.frames(spark, sf_dir).withColumn("duration_ms", 10 + F.col("duration_ms") % 400))


@query("""select clip_id, slot, position, (select max(frame_idx) from b where b.clip_id = q.clip_id and s <= position) as frame_idx from (
  select clip_id, k as slot, cast(round_even(greatest(0, greatest(20, total) - 50) * k / 7::double, 0) as bigint) as position from b, range(0, 8) r(k) where frame_idx = 0) q""", FR, _CLEAN, _BOUNDS)
def filmstrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.filmstrip(views.frames(spark, sf_dir), 8)


_CLIPS = "cl as (select clip_id, n * 40 as n_frames, cast(total // 1000 as bigint) as total_ms, 160 + clip_id % 30 * 64 as width, 90 + clip_id % 17 * 64 as height from b where frame_idx = 0)"


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = T.clean_durations(views.frames(spark, sf_dir)).groupBy("clip_id").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total"))
    return totals.selectExpr("clip_id", "n * 40 as n_frames", "total div 1000 as total_ms", "160 + clip_id % 30 * 64 as width", "90 + clip_id % 17 * 64 as height")


@query("""select clip_id, cast(stride as bigint) as stride, greatest(0.2, least(1, sc)) as scale, sc < 0.2 as rejected, stride > 1 or greatest(0.2, least(1, sc)) < 0.999 as reduced from (
  select *, least(case when px > 160000000 then sqrt(160000000 / px::double) else 1 end, sqrt(1000000000 / px::double)) as sc from (
  select *, width * height * greatest(1, ceil(n_frames / stride)) as px from (
  select *, case when ceil(n_frames / s0) > 9000 then greatest(s0, ceil(n_frames / 9000.0::double)) else s0 end as stride from (
  select *, greatest(1, ceil(n_frames / 900.0::double), ceil(greatest(1, total_ms) / 60000.0::double)) as s0 from cl))))""", FR, _CLEAN, _BOUNDS, _CLIPS)
def plan_import_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.plan_import_reduction(_clips(spark, sf_dir)).select("clip_id", "stride", "scale", "rejected", "reduced")


@query("""select clip_id, cast(case when al <= 30000000 then 1 else greatest(1, s2) end as bigint) as stride,
  case when al <= 30000000 then 1.0::double else greatest(0.25, least(1, sc1, sqrt(30000000 / greatest(1, area * greatest(2, ceil(n_frames / s2)))::double))) end as scale from (
  select *, coalesce(list_filter(range(cast(s1 as bigint), cast(greatest(s1, ceil(n_frames / 2::double)) as bigint) + 1), lambda s: area * greatest(2, ceil(n_frames / s::double)) * sc1 * sc1 <= 30000000)[1],
    greatest(s1, ceil(n_frames / 2::double)))::double as s2 from (
  select *, greatest(0.25, case when small then least(1, sqrt(30000000 / greatest(1, area * greatest(2, ceil(n_frames / s1)))::double)) else sc end) as sc1 from (
  select *, case when small then least(greatest(s0, ceil(n_frames / greatest(2, 30000000 // greatest(1, cast(floor(area * 0.25::double) as bigint)))::double)), greatest(1, ceil(n_frames / 2::double))) else s0 end as s1 from (
  select *, sc < 0.5 and n_frames > 2 as small from (
  select *, least(1, sqrt(30000000 / greatest(1, area * greatest(2, ceil(n_frames / s0)))::double)) as sc from (
  select *, least(greatest(1, ceil(al / 30000000::double)), greatest(1, floor(n_frames * 1000 / greatest(1, total_ms)::double / 10.0::double))) as s0 from (
  select *, width * height as area, greatest(1, n_frames * width * height) as al from cl)))))))""", FR, _CLEAN, _BOUNDS, _CLIPS)
def plan_edit_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.plan_edit_reduction(_clips(spark, sf_dir), 30_000_000).select("clip_id", "stride", "scale")
