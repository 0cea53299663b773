"""The media catalogue as a batch: sizes, checks, names, queues, geometry of watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mosaique.functions import geometry as G, scalars as S
from mosaique.operators import batch as B
from mosaique.registry import query
from mosaique.session import materialize, shared_path
from mosaique.sources import views

C = views.CATALOG_SQL
_ANIMATED = "(ext in ('mp4', 'webm') or (ext = 'gif' and n_frames > 1))"


@query("select image_id, path from v_catalog where ext in ('png','jpg','jpeg','webp','bmp','tif','tiff','gif','mp4','webm','jfif')", C)
def scan_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.scan_catalog(views.catalog(spark, sf_dir)).select("image_id", "path")


@query("select path, min(image_id % 3) as root_pos from v_catalog group by path", C)
def expand_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three listings of the same files, written in different ways."""
    rows = views.catalog(spark, sf_dir).select((F.col("image_id") % 3).alias("root_pos"), F.expr("case image_id % 4 when 0 then replace(path, '/lib/', '/lib/./') when 1 then replace(path, '/lib/', '//lib//') when 2 then replace(path, '/lib/', '/lib/new/old/../../') else concat('/..', path) end as path"))
    return B.expand_roots(rows)


@query("select image_id, case when image_id % 8 + 1 in (5,6,7,8) then height else width end as width, case when image_id % 8 + 1 in (5,6,7,8) then width else height end as height from v_catalog", C)
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.catalog_columns(views.catalog(spark, sf_dir).withColumn("orientation", F.col("image_id") % 8 + 1)).select("image_id", "width", "height")


@query("select image_id, greatest(1, cast(round_even(width * 1.5, 0) as bigint)) as out_width, greatest(1, cast(round_even(height * 1.5, 0) as bigint)) as out_height from v_catalog", C)
def output_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_output_size(B.with_settings(views.catalog(spark, sf_dir), {"scale_factor": 1.5})).select("image_id", "out_width", "out_height")


@query("select image_id from v_catalog where not (width >= 1000 and height >= 700)", C)
def filter_already_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.with_settings(views.catalog(spark, sf_dir), {"mode": "Target size", "target_width": 1000, "target_height": 700, "skip_if_larger": True})
    return B.filter_already_large(B.with_output_size(rows)).select("image_id")


@query("""select image_id, array_to_string(list_filter([
  case when image_id % 7 - 1 <= 0 then 'scale factor not positive' end, case when image_id % 60 not between 1 and 50 then 'workers not in 1..50' end,
  case when not (image_id % 90 = 0 or image_id % 90 between 64 and 4096) then 'tile not 0 or 64..4096' end,
  case when cast(round_even(width * (image_id % 7 - 1)::double * 4, 0) as bigint) * cast(round_even(height * (image_id % 7 - 1)::double * 4, 0) as bigint) > 300000000 then 'output over 300 megapixels' end],
  lambda r: r is not null), '|') as reasons from v_catalog""", C)
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.with_settings(views.catalog(spark, sf_dir)).withColumns({
        "s_scale_factor": (F.col("image_id") % 7 - 1).cast("double") * 4, "s_max_workers": F.col("image_id") % 60, "s_tile_size": F.col("image_id") % 90})
    return B.validate_rows(rows).select("image_id", F.concat_ws("|", "reasons").alias("reasons"))


_WORK = f"""
sized as (select *, greatest(1, cast(round_even(width * 2.0, 0) as bigint)) as ow, greatest(1, cast(round_even(height * 2.0, 0) as bigint)) as oh,
  case when {_ANIMATED} or has_alpha then 4 else 3 end as ch from v_catalog),
work as (select *, case when {_ANIMATED} then greatest(134217728, cast(floor((ow * oh * ch * n_frames + greatest(width * height * ch, ow * oh * ch) * 3) * 1.2::double) as bigint))
  else greatest(8388608, width * height * ch + cast(floor(ow * oh * ch * (1.55::double + 0.85 + 0.0 + 0.35)) as bigint)) end as working_set from sized)"""


def _worked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_working_set(B.with_output_size(B.with_settings(views.catalog(spark, sf_dir), {"finishing": True})))


@query("select image_id, working_set from work", C, _WORK)
def working_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worked(spark, sf_dir).select("image_id", "working_set")


_SAMPLE = """
queue as (select *, row_number() over (order by image_id) - 1 as position, count(*) over () as total from work),
picks as (select 0 as pick, * from queue where position < 32 union all select 1, * from queue where position >= total - 32
  union all select 2, * from (select * from queue where ext in ('gif', 'mp4', 'webm') order by position limit 32)
  union all select 3, * from queue where position % greatest(1, total // 32) = 0 and position < greatest(1, total // 32) * 32),
sample as (select *, row_number() over (order by pick, position) - 1 as sample_pos from (select *, row_number() over (partition by position order by pick) as rn from picks) where rn = 1)"""


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _worked(spark, sf_dir).withColumn("position", F.col("image_id") - 1)
    least = rows.agg(F.min("image_id")).first()[0]
    return B.probe_sample(rows.withColumn("position", F.col("image_id") - F.lit(least)))


@query("select position, sample_pos from sample", C, _WORK, _SAMPLE)
def probe_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir).select("position", "sample_pos")


@query(f"select max(working_set) as estimated, bool_or({_ANIMATED}) as contains_animation from sample", C, _WORK, _SAMPLE)
def footprint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.footprint_summary(_sampled(spark, sf_dir))


@query(f"select image_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') || '_upscaled' || case when {_ANIMATED} then '.gif' else '.jpg' end as out_name from v_catalog", C)
def output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_output_name(B.with_settings(views.catalog(spark, sf_dir), {"output_format": "JPEG"})).select("image_id", "out_name")


_ANCHOR_NAMES = ["Top-Left", "Top-Center", "Top-Right", "Center-Left", "Center", "Center-Right", "Bottom-Left", "Bottom-Center", "Bottom-Right", "Custom", "Elsewhere"]


@query("""select image_id,
  cast(greatest(0, least(fx, case when anchor = 'Custom' then round_even(fx * (image_id % 101)::double / 100, 0) when anchor like '%Left' then 10 when anchor like '%-Center' or anchor = 'Center' then floor(fx / 2.0::double) else fx - 10 end)) as int) as x,
  cast(greatest(0, least(fy, case when anchor = 'Custom' then round_even(fy * (image_id % 51)::double / 100, 0) when anchor like 'Top%' then 20 when anchor like 'Center%' then floor(fy / 2.0::double) else fy - 20 end)) as int) as y
from (select *, (['""" + "','".join(_ANCHOR_NAMES) + """'])[image_id % 11 + 1] as anchor, width - 100 as fx, height - 600 as fy from v_catalog)""", C)
def anchor_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.catalog(spark, sf_dir).withColumn("anchor", F.element_at(F.array(*[F.lit(n) for n in _ANCHOR_NAMES]), (F.col("image_id") % 11 + 1).cast("int")))
    at = G.anchor_position(F.col("width"), F.col("height"), F.lit(100), F.lit(600), F.col("anchor"), (F.col("image_id") % 101).cast("double"), (F.col("image_id") % 51).cast("double"), 10, 20)
    return rows.select("image_id", at.alias("at")).select("image_id", "at.x", "at.y")


@query("""select image_id, greatest(1, cast(round_even(width * 0.13::double, 0) as bigint)) as w,
  greatest(1, cast(round_even(90 * greatest(1, cast(round_even(width * 0.13::double, 0) as bigint)) / 240.0::double, 0) as bigint)) as h from v_catalog""", C)
def logo_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = B.logo_size(F.col("width"), F.lit(240), F.lit(90), 0.13)
    return views.catalog(spark, sf_dir).select("image_id", size.alias("s")).select("image_id", "s.w", "s.h")


@query(f"select image_id, case when {_ANIMATED} then 'animated' when image_id % 2 = 0 then 'error' else 'still' end as route from v_catalog", C)
def route_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.with_settings(views.catalog(spark, sf_dir)).withColumn("s_output_format", F.when(F.col("image_id") % 2 == 0, "MP4").otherwise("PNG"))
    return B.route_media(rows).select("image_id", "route")


@query(f"""select image_id % 20 as run, count(*) filter (where o = 'ok') as outputs, count(*) filter (where o = 'error') as errors, count(*) filter (where o = 'cancelled') as cancelled, count(*) as total,
  case when count(*) filter (where o = 'fatal') > 0 then 'Failed' when count(*) filter (where o = 'cancelled') > 0 then 'Cancelled' when count(*) filter (where o = 'error') = 0 then 'Completed' else 'Completed with errors' end as status,
  cast(floor(100 * count(*) filter (where o in ('ok', 'error')) / count(*)::double) as int) as percent
  from (select image_id, case when image_id % 20 = 3 and image_id % 7 = 0 then 'cancelled' when image_id % 20 = 5 or (image_id % 20 = 6 and {_ANIMATED}) then 'error' when image_id % 20 = 7 and image_id % 11 = 0 then 'fatal' when image_id % 9 = 8 then 'pending' else 'ok' end as o, ext, n_frames from v_catalog) group by 1""", C)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.col("image_id") % 20
    outcome = F.when((run == 3) & (F.col("image_id") % 7 == 0), "cancelled").when((run == 5) | ((run == 6) & B.is_animated()), "error").when((run == 7) & (F.col("image_id") % 11 == 0), "fatal").when(F.col("image_id") % 9 == 8, "pending").otherwise("ok")
    return B.run_summary(views.catalog(spark, sf_dir).select(run.alias("run"), outcome.alias("outcome")), ["run"])


@query("select distinct path from v_catalog where (ext = 'txt' or n_frames > 20 or width * height > 2000000) and path in (select path from v_catalog where size_bytes > 0 and not has_alpha)", C)
def retry_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failed (no picture, too many frames or pixels) and still lies there (files without transparency)."""
    rows = views.catalog(spark, sf_dir)
    return B.retry_set(rows.filter("ext = 'txt' or n_frames > 20 or width * height > 2000000"), rows.filter("size_bytes > 0 and not has_alpha"))


@query("""select path, position from (select path, row_number() over (order by min(image_id)) - 1 as position from v_catalog where n_frames > 1 group by path)
  union all select path, (select count(distinct path) from v_catalog where n_frames > 1) + row_number() over (order by min(image_id), path) - 1
  from v_catalog where path not in (select path from v_catalog where n_frames > 1) group by path""", C)
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animations are queued first, then the whole catalogue is added."""
    rows = materialize(views.catalog(spark, sf_dir).select("path", F.col("image_id").alias("position"), "n_frames"), "catalog")
    queue = materialize(B.append_new(rows.limit(0), rows.filter("n_frames > 1")), "queue")
    return B.append_new(queue, rows)


@query("""select image_id from v_catalog where regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') not in
  (select regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') from v_catalog where ext in ('mp4', 'gif') and n_frames > 25)""", C)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metadata against the long animations."""
    rows = views.catalog(spark, sf_dir)
    return B.orphans(rows, rows.filter("ext in ('mp4', 'gif') and n_frames > 25")).select("image_id")


_NAME = "regexp_extract(path, '([^/]*)$', 1)"


@query(f"""
select image_id, case when slot = 1 then stem || suffix else stem || ' (' || slot || ')' || suffix end as final_name from (
select image_id, stem, suffix, list_filter(range(1, 4 + cast(rank as bigint)), lambda s: not (s = 1 and taken1 or s = 3 and taken3))[rank] as slot from (
select image_id, regexp_replace({_NAME}, '\\.[^.]+$', '') as stem, regexp_extract({_NAME}, '(\\.[^.]+)$', 1) as suffix,
  row_number() over (partition by {_NAME} order by image_id) as rank,
  exists (select 1 from part p where p.p_partkey % 10 = 0 and p.p_name = v.p_name2) as taken1, exists (select 1 from part p where p.p_partkey % 15 = 0 and p.p_name = v.p_name2) as taken3
  from (select c.*, p_name as p_name2 from v_catalog c join part on p_partkey = image_id) v))""", C)
def collision_free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing files hold the plain name of every tenth stem and number 3 of every fifteenth, with every suffix."""
    rows = views.catalog(spark, sf_dir)
    plan = rows.select(F.lit("/out").alias("folder"), S.path_name(F.col("path")).alias("name"), F.col("image_id").alias("position"))
    stem, suffixes = S.path_stem(F.col("path")), F.explode(F.array(*[F.lit(s) for s in ("png", "jpg", "gif", "webp", "tiff", "txt", "mp4", "jpeg")]))
    plain = rows.filter("image_id % 10 = 0").select(stem.alias("stem"), suffixes.alias("s")).selectExpr("'/out' as folder", "concat(stem, '.', s) as name")
    third = rows.filter("image_id % 15 = 0").select(stem.alias("stem"), suffixes.alias("s")).selectExpr("'/out' as folder", "concat(stem, ' (3).', s) as name")
    return B.collision_free_names(plan, plain.unionByName(third)).select(F.col("position").alias("image_id"), "final_name")


@query("""select image_id, regexp_extract(path, '([^/]*)$', 1) as name, regexp_extract(path, '^(.*)/[^/]*$', 1) as parent, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') as stem,
  '.' || ext as suffix, width * height / 1e6 as megapixels,
  case when b < 1024 then b || ' B' when b < 1048576 then printf('%.2f KB', b / 1024.0::double) when b < 1073741824 then printf('%.2f MB', b / 1048576.0::double) when b < 1099511627776 then printf('%.2f GB', b / 1073741824.0::double) else printf('%.2f TB', b / 1099511627776.0::double) end as size_text,
  case when b < 1024 then b || ' B' when b < 1048576 then printf('%.1f KB', b / 1024.0::double) when b < 1073741824 then printf('%.1f MB', b / 1048576.0::double) when b < 1099511627776 then printf('%.1f GB', b / 1073741824.0::double) else printf('%.1f TB', b / 1099511627776.0::double) end as size_short
  from (select *, size_bytes * cast(power(10, image_id % 9) as bigint) // 1000 as b from v_catalog)""", C)
def path_and_size_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, b = F.col("path"), F.col("b")
    rows = views.catalog(spark, sf_dir).withColumn("b", F.expr("size_bytes * cast(power(10, image_id % 9) as bigint) div 1000"))
    return rows.select("image_id", S.path_name(path).alias("name"), S.path_parent(path).alias("parent"), S.path_stem(path).alias("stem"), S.path_suffix(path).alias("suffix"),
                       S.megapixels(F.col("width"), F.col("height")).alias("megapixels"), S.format_bytes(b).alias("size_text"), S.human_file_size(b).alias("size_short"))


@query("""select image_id, case when hex ~ '^#[0-9A-Fa-f]{6}$' then ('0x' || substr(hex, 2, 2))::int end as r, case when hex ~ '^#[0-9A-Fa-f]{6}$' then ('0x' || substr(hex, 4, 2))::int end as g,
  case when hex ~ '^#[0-9A-Fa-f]{6}$' then ('0x' || substr(hex, 6, 2))::int end as b from (select image_id, '#' || printf('%0' || (5 + image_id % 2) || 'X', image_id * 7919 % 1000000) as hex from v_catalog)""", C)
def parse_hex_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.catalog(spark, sf_dir).select("image_id", F.expr("concat('#', lpad(hex(image_id * 7919 % 1000000), greatest(5 + image_id % 2, length(hex(image_id * 7919 % 1000000))), '0'))").alias("hex"))
    return rows.select("image_id", S.parse_hex_color(F.col("hex")).alias("c")).select("image_id", "c.r", "c.g", "c.b")


@query("select image_id, xor(xor(xor(width::bigint * 73856093, height::bigint * 19349663), image_id * 83492791), 29::bigint * 83492791) & 4294967295 as seed from v_catalog", C)
def mix_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.catalog(spark, sf_dir).select("image_id", S.mix_seed(F.col("width"), F.col("height"), F.col("image_id"), 29).alias("seed"))


@query("select image_id, array_to_string(list_sort(list_filter(['dpi', case when image_id % 2 = 0 and image_id % 3 <> 0 then 'icc_profile' end], lambda k: k is not null)), ',') as kept from v_catalog", C)
def metadata_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.expr("case when image_id % 2 = 0 then map('icc_profile', 'p', 'dpi', '72', 'gps', 'x') else map('dpi', '72', 'camera', 'y') end")
    kept = B.metadata_whitelist(meta, F.when(F.col("image_id") % 3 == 0, "GIF").otherwise("PNG"))
    return views.catalog(spark, sf_dir).select("image_id", F.concat_ws(",", F.array_sort(F.map_keys(kept))).alias("kept"))


@query("select event_id from events where ts < (select max(ts) from events) - interval 7 days")
def expire_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return B.expire_transfers(events, "ts", F.lit(now)).select("event_id")


@query("""select image_id, case image_id % 6 when 0 then 0.15 when 1 then 0.45 when 2 then 0.05 when 3 then 0.75 end::double as sharpen, case image_id % 6 when 0 then 1.02 when 1 then 1.08 when 2 then 0.98 when 3 then 1.12 end::double as contrast,
  case image_id % 4 when 0 then 0 when 1 then 16 when 2 then 32 end as feather, case image_id % 4 when 0 then 0 when 1 then 8 when 2 then 16 end as padding from v_catalog""", C)
def preset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.catalog(spark, sf_dir).select("image_id", F.expr("element_at(array('Clean Photo', 'Crisp Illustration', 'Soft Portrait', 'Maximum Detail', 'Other', 'None'), cast(image_id % 6 as int) + 1)").alias("quality_preset"),
        F.expr("element_at(array('Hard edge', 'Soft transition', 'Seamless blend', 'Other'), cast(image_id % 4 as int) + 1)").alias("edge_preset"))
    found = B.preset_lookup(B.preset_lookup(rows, B.quality_presets(spark), "quality_preset"), B.edge_presets(spark), "edge_preset")
    return found.select("image_id", "sharpen", "contrast", "feather", "padding")


@query("select image_id, case when ext = 'txt' or image_id % 50 = 0 then path || ': ' || case when ext = 'txt' then 'unsupported' else 'unreadable' end end as message from v_catalog where ext = 'txt' or image_id % 50 = 0", C)
def split_bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.catalog(spark, sf_dir).withColumn("width", F.when(F.col("image_id") % 50 == 0, -1).otherwise(F.col("width")))
    message = F.when(F.col("ext") == "txt", "unsupported").otherwise("unreadable")
    _, errors = B.split_bad_records(rows.withColumn("path", F.concat_ws("|", "path", "image_id")), (F.col("ext") == "txt") | (F.col("width") < 0), message)
    return errors.select(F.split("path", r"\|")[1].cast("long").alias("image_id"), F.regexp_replace("message", r"\|\d+", "").alias("message"))


@query("select ext, count(*) as n, cast(sum(size_bytes) as bigint) as total_bytes from v_catalog group by ext", C)
def write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishes the catalogue by the committer (all of it or nothing), partitioned by type, and sums what is read back."""
    path = shared_path(spark, "published")
    views.catalog(spark, sf_dir).write.mode("errorifexists").partitionBy("ext").parquet(path)
    return spark.read.parquet(path).groupBy("ext").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("total_bytes"))
