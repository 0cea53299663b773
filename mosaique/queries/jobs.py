"""Job events, errors, releases, JSON records and streams. Events stand for job events: event_type is the signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mosaique.functions import scalars as S
from mosaique.operators import jobs as J
from mosaique.registry import query
from mosaique.session import shared_path
from mosaique.sources import views
from mosaique.streaming import log_table, stateful, streams

RL = views.RELEASES_SQL
_HOUR = 3_600_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _files(sf_dir: str) -> str:
    """The table as a glob: a stream takes a folder or a glob, and the table may be a single file."""
    return f"{sf_dir}/events.parque[t]"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, with a time stamp that carries a watermark."""
    return spark.readStream.schema(_events(spark, sf_dir).schema).parquet(_files(sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))


_JOBS = "jobs as (select event_id as job_id, ts as started_at, case event_id % 5 when 0 then 'Failed' when 1 then 'Running' else 'Completed' end as status, case when event_id % 5 = 1 and event_id % 3 <> 0 then null else ts end as finished_at from events)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("event_id as job_id", "ts as started_at", "case event_id % 5 when 0 then 'Failed' when 1 then 'Running' else 'Completed' end as status", "case when event_id % 5 = 1 and event_id % 3 <> 0 then null else ts end as finished_at")


@query("select job_id, status from jobs order by started_at desc, job_id desc limit 200", _JOBS)
def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_history(_jobs(spark, sf_dir)).select("job_id", "status")


@query("select job_id from jobs where status = 'Running' and finished_at is null", _JOBS)
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.active_jobs(_jobs(spark, sf_dir)).select("job_id")


@query("select job_id from jobs where status = 'Failed' order by job_id limit 100", _JOBS)
def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.first_errors(_jobs(spark, sf_dir).filter("status = 'Failed'").withColumn("position", F.col("job_id")), 100).select("job_id")


@query("select user_id, event_type as path, ts, rank from (select *, row_number() over (partition by user_id order by ts desc, event_type) as rank from (select user_id, event_type, max(ts) as ts from events group by all)) where rank <= 3")
def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recent_items(_events(spark, sf_dir).withColumnRenamed("event_type", "path"), 3, ["user_id"])


_BURSTS = f"""
e as (select *, lag(ts) over w as prev from events window w as (partition by user_id order by ts, event_id)),
s as (select *, prev is null or epoch_us(ts) - epoch_us(prev) >= {12 * _HOUR} as shown from e),
b as (select *, sum(shown::int) over (partition by user_id order by ts, event_id) as burst from s)"""


@query("select event_id, shown, count(*) over (partition by user_id, burst) - 1 as suppressed from b", _BURSTS)
def suppress_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.suppress_repeats(_events(spark, sf_dir), ["user_id"], "12 hours").select("event_id", "shown", "suppressed")


@query(f"select user_id, min(ts) as first, count(*) - 1 as suppressed from b group by user_id, burst having epoch_us(max(ts)) + {12 * _HOUR - 1} <= (select epoch_us(max(ts)) - {24 * _HOUR} from events)", _BURSTS)
def suppress_repeats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts that the watermark (a day behind) has closed."""
    out = streams.suppress_repeats(_stream(spark, sf_dir), ["user_id"], 12 * _HOUR, "ts", "24 hours")
    return streams.run_to_table(spark, out).withColumn("first", F.col("first").cast("timestamp_ntz"))


@query(f"""select user_id, min(ts) as first, max(ts) as last_seen, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as g from
  (select *, case when prev is null or epoch_us(ts) - epoch_us(prev) > {36 * _HOUR} then 1 else 0 end as new from e)) group by user_id, g
  having epoch_us(max(ts)) + {36 * _HOUR} <= (select epoch_us(max(ts)) - {24 * _HOUR} from events)""", "e as (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events)")
def expire_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run_to_table(spark, stateful.expire(_stream(spark, sf_dir), "user_id", "ts", 36 * _HOUR, "24 hours"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last_seen")})


@query("select event_id from events where user_id not in (select user_id from events where event_id % 50 = 0)")
def media_arrivals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of users that are not known yet."""
    known = _events(spark, sf_dir).filter("event_id % 50 = 0")
    schema = _events(spark, sf_dir).schema
    return streams.run_to_table(spark, streams.arrivals(spark, _files(sf_dir), schema, known, "user_id").select("event_id"))


@query("select user_id as job_id, event_type as status, cast(floor(value) as int) as percent, n_events from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn, count(*) over (partition by user_id) as n_events from events) where rn = 1")
def job_rollup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.floor("value").cast("int").alias("percent"), "ts", "event_id")
    return streams.run_to_table(spark, streams.job_rollup(rows, "job_id", "ts", "event_id"), "complete")


_THROTTLE = f"""
o as (select *, row_number() over (partition by user_id order by ts, event_id) as rn, epoch_us(ts) as us, event_type = 'purchase' as fin from events),
walk as (select user_id, event_id, rn, us as last, true as shows from o where rn = 1
  union all select o.user_id, o.event_id, o.rn, case when o.fin or o.us - walk.last >= {24 * _HOUR} then o.us else walk.last end, o.fin or o.us - walk.last >= {24 * _HOUR} from walk join o on o.user_id = walk.user_id and o.rn = walk.rn + 1)"""


@query("select user_id, event_id from walk where shows", _THROTTLE, recursive=True)
def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.throttle(_events(spark, sf_dir), ["user_id"], 24 * _HOUR, F.col("event_type") == "purchase")


@query("select user_id, event_id from walk where shows", _THROTTLE, recursive=True)
def throttle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.throttle(spark, _stream(spark, sf_dir), "user_id", "ts", "event_id", F.col("event_type") == "purchase", 24 * _HOUR, shared_path(spark, "throttle"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events where user_id % 7 <> 0) where rn = 1")
def latest_revision_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (users) at their latest revision (event), without those that no longer exist."""
    sink = log_table.LatestRevisions(spark, "user_id", "event_id")
    sink.follow(_stream(spark, sf_dir).select("user_id", "event_id", "event_type"))
    sink.remove_orphans(_events(spark, sf_dir).filter("user_id % 7 <> 0"))
    return sink.table().select("user_id", "event_id", "event_type")


_VERSION = r"'^\s*v?(\d+)\.(\d+)\.(\d+)(?:[\s._-]*rc[\s._-]*(\d+))?\s*$'"
_KEYED = f"""
k as (select *, regexp_matches(tag, {_VERSION}, 'i') as ok, try_cast(regexp_extract(tag, {_VERSION}, 1, 'i') as int) as major, try_cast(regexp_extract(tag, {_VERSION}, 2, 'i') as int) as minor,
  try_cast(regexp_extract(tag, {_VERSION}, 3, 'i') as int) as patch, regexp_extract(tag, {_VERSION}, 4, 'i') as rc from v_releases)"""


@query("select release_id, tag, case when ok then major end as major, case when ok then minor end as minor, case when ok then patch end as patch, case when ok then (rc = '')::int end as stable, case when ok then coalesce(try_cast(rc as int), 0) end as rc from k", RL, _KEYED)
def version_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.releases(spark, sf_dir).select("release_id", "tag", S.version_key(F.col("tag")).alias("k")).select("release_id", "tag", "k.major", "k.minor", "k.patch", "k.stable", "k.rc")


@query("select release_id, tag from k where ok and not draft and (major, minor, patch, (rc = '')::int, coalesce(try_cast(rc as int), 0)) > (1, 4, 2, 0, 7) order by major desc, minor desc, patch desc, (rc = '')::int desc, coalesce(try_cast(rc as int), 0) desc, release_id limit 1", RL, _KEYED)
def newest_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.newest_release(views.releases(spark, sf_dir), "1.4.2 rc7").select("release_id", "tag")


@query("select release_id, list_sort(list_transform(list_filter(assets, lambda a: lower(a) like '%.exe' and lower(a) like '%setup%'), lambda a: {'x': lower(a) not like '%x64%', 'y': lower(a) like '%arm64%', 'n': a}))[1].n as asset from v_releases", RL)
def pick_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.releases(spark, sf_dir).select("release_id", J.pick_asset(F.col("assets"), "studio").alias("asset"))


@query("select release_id, tag, draft, prerelease, unnest(case when len(assets) = 0 then [null] else assets end) as asset_name from v_releases", RL)
def read_release_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases written as nested JSON documents and read back, one row per asset."""
    rows = views.releases(spark, sf_dir)
    text = F.to_json(F.struct(F.col("tag").alias("tag_name"), "draft", "prerelease", "assets"))
    return J.read_release_feed(rows.select("release_id", text.alias("doc")), "doc").drop("asset_size")


@query("""select event_id, case event_id % 4 when 0 then 'bad' when 1 then 'bad' else 'good' end as kind, case when event_id % 4 >= 2 then user_id end as user_id from events""")
def read_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects are records; arrays and broken text are put aside."""
    raw = _events(spark, sf_dir).select("event_id", F.expr("case event_id % 4 when 0 then '[1, 2]' when 1 then concat('{\"user\": ', user_id) else to_json(named_struct('user', user_id)) end").alias("doc"))
    good, bad = J.read_json_records(raw, "doc", "user long")
    return good.select("event_id", F.lit("good").alias("kind"), F.col("record.user").alias("user_id")).unionByName(bad.select("event_id", F.lit("bad").alias("kind"), F.lit(None).cast("long").alias("user_id")))


@query("""select clip_id, frame_idx, case when h > 0 then printf('%d:%02d:%05.2f', h, m, sec) else printf('%d:%05.2f', m, sec) end as text from
  (select *, t // 3600000 as h, t % 3600000 // 60000 as m, (t % 60000) / 1000.0::double as sec from (select clip_id, frame_idx, duration_ms // 10 * 10 % 9000000 as t from v_frames))""", views.FRAMES_SQL)
def format_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("duration_ms div 10 * 10 % 9000000")
    return views.frames(spark, sf_dir).select("clip_id", "frame_idx", S.format_ms(t).alias("text"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then true when 1 then true when 2 then true else false end as ok from orders")
def digest_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty digest, the right one in either case, and a wrong one."""
    content = F.col("o_comment") if "o_comment" in spark.read.parquet(f"{sf_dir}/orders.parquet").columns else F.col("o_orderkey").cast("string")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.coalesce(content, F.lit("")).cast("binary").alias("content"))
    digest = F.expr("case o_orderkey % 4 when 0 then '' when 1 then concat('sha256:', sha2(content, 256)) when 2 then concat('SHA256:', upper(sha2(content, 256))) else 'sha256:00' end")
    return rows.select("o_orderkey", S.digest_ok(F.col("content"), digest).alias("ok"))
