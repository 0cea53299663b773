"""Fingerprints, similar pairs and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mosaique.functions import scalars as S
from mosaique.operators import graph, similarity as sim
from mosaique.registry import query
from mosaique.session import materialize, shared_path
from mosaique.sources import views
from mosaique.streaming import log_table

_COLUMNS = (
    "concat('/lib/', image_id % 13, '/', image_id, '.png') as path", "cast(64 + (image_id % 5) * 40 as int) as width", "cast(48 + (image_id % 3) * 16 as int) as height",
    "(image_id * 7919) % 100003 as size_bytes", "cast(1700000000D + image_id * 60 as double) as mtime",
)
#: Ids of planted copies start here.
COPY, CHANGED = 10**12, 2 * 10**12


def fingerprint_table(spark: SparkSession, sf_dir: str, planted: bool = False) -> DataFrame:
    """Fingerprints of all vectors; `planted` adds an exact and a changed copy of every tenth."""
    rasters = views.raster_arrays(spark, sf_dir)
    if planted:
        tenth = rasters.filter("image_id % 10 = 0")
        changed = tenth.select((F.col("image_id") + CHANGED).alias("image_id"), F.transform("luma", lambda v, k: F.when(k == 0, F.least(F.lit(255), v + 40)).otherwise(v)).alias("luma"))
        rasters = rasters.unionByName(tenth.withColumn("image_id", F.col("image_id") + COPY)).unionByName(changed)
    return sim.fingerprints(rasters.selectExpr("image_id", *_COLUMNS, "luma"))


_RASTERS = """
v_base as (select vec_id as image_id, list_transform(embedding, lambda v: cast(greatest(0, least(255, floor((cast(v as double) + 0.5) * 255))) as int)) as luma from embeddings),
v_planted as (select * from v_base union all select image_id + 1000000000000, luma from v_base where image_id % 10 = 0
  union all select image_id + 2000000000000, list_concat([least(255, luma[1] + 40)], luma[2:]) from v_base where image_id % 10 = 0)"""


def _fp_sql(name: str, source: str) -> str:
    return f"""
{name} as (select image_id, '/lib/' || (image_id % 13) || '/' || image_id || '.png' as path, cast(64 + (image_id % 5) * 40 as int) as width,
  cast(48 + (image_id % 3) * 16 as int) as height, (image_id * 7919) % 100003 as size_bytes, cast(1700000000 + image_id * 60 as double) as mtime,
  cast(case when ua >= 9223372036854775808 then ua - 18446744073709551616 else ua end as bigint) as a_hash, cast(ud as bigint) as d_hash, color_hist, sharpness
  from (select image_id,
    list_sum(list_transform(range(0, 64), lambda k: case when luma[k + 1] * 64 >= list_sum(luma) then cast(1 as hugeint) << cast(63 - k as int) else 0 end)) as ua,
    list_sum(list_transform(range(0, 56), lambda j: case when luma[(j // 7) * 8 + j % 7 + 2] > luma[(j // 7) * 8 + j % 7 + 1] then cast(1 as hugeint) << cast(55 - j as int) else 0 end)) as ud,
    list_transform(range(0, 8), lambda b: len(list_filter(luma, lambda v: v // 32 = b)) / 64.0::double) as color_hist,
    list_var_pop(list_transform(range(0, 36), lambda k: (4 * luma[(k // 6 + 1) * 8 + k % 6 + 2] - luma[(k // 6 + 1) * 8 + k % 6 + 1] - luma[(k // 6 + 1) * 8 + k % 6 + 3]
       - luma[(k // 6) * 8 + k % 6 + 2] - luma[(k // 6 + 2) * 8 + k % 6 + 2])::double)) as sharpness
    from {source}))"""


_FP, _FPD = _fp_sql("fp", "v_base"), _fp_sql("fp", "v_planted")
_SCORE = """round_even(greatest(0, least(100, (0.38::double * (1 - {ha} / 64.0::double) + 0.42::double * (1 - {hd} / 56.0::double)
  + 0.20::double * greatest(0, least(1, 1 - {l1} / 2.0::double))) * 100)), 2)"""


def _score(a: str, b: str) -> str:
    return _SCORE.format(ha=f"bit_count(xor({a}.a_hash, {b}.a_hash))", hd=f"bit_count(xor({a}.d_hash, {b}.d_hash))",
                         l1=f"list_sum(list_transform(range(1, 9), lambda i: abs({a}.color_hist[i] - {b}.color_hist[i])))")


def _pairs(threshold: int) -> str:
    return f"""
pairs as (select * from (select a.image_id as src, b.image_id as dst, {_score("a", "b")} as score from fp a join fp b on a.image_id < b.image_id
  and 2128 * bit_count(xor(a.a_hash, b.a_hash)) + 2688 * bit_count(xor(a.d_hash, b.d_hash)) <= 3584 * {100 - threshold}) where score >= {threshold})"""


@query("select image_id, a_hash, d_hash, color_hist, sharpness from fp", _RASTERS, _FP)
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_table(spark, sf_dir).select("image_id", "a_hash", "d_hash", "color_hist", "sharpness")


@query("select image_id, a_hash, d_hash, color_hist, sharpness from fp", _RASTERS, _FP)
def incremental_fingerprints_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of rasters through a stored cache: what has the path, size and time of a known file isn't computed again."""
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parque[t]")
    files = arriving.selectExpr("concat('/lib/', vec_id, '.png') as path", "64 as size_bytes", "label as mtime", "vec_id", "embedding")

    def compute(rows: DataFrame) -> DataFrame:
        rasters = rows.selectExpr("path", "size_bytes", "mtime", "vec_id as image_id", f"{views.LUMA_ARRAY} as luma")
        return sim.fingerprints(rasters).select("path", "size_bytes", "mtime", "image_id", "a_hash", "d_hash", "color_hist", "sharpness")

    cache = log_table.FingerprintCache(spark, compute)
    cache.follow(files)
    return cache.table().select("image_id", "a_hash", "d_hash", "color_hist", "sharpness")


@query("select * from pairs", _RASTERS, _FP, _pairs(72))
def similar_pairs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.similar_pairs_exact(materialize(fingerprint_table(spark, sf_dir), "fp"), 72)


@query("select * from pairs", _RASTERS, _FPD, _pairs(95))
def candidate_pairs_banded_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.candidate_pairs_banded(materialize(fingerprint_table(spark, sf_dir, planted=True), "fp"), 95)


@query("select * from pairs", _RASTERS, _FPD, _pairs(88))
def candidate_pairs_banded_88(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.candidate_pairs_banded(materialize(fingerprint_table(spark, sf_dir, planted=True), "fp"), 88)


@query("select * from pairs", _RASTERS, _FPD, _pairs(72))
def similar_pairs_metric_72(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.similar_pairs_metric(materialize(fingerprint_table(spark, sf_dir, planted=True), "fp"), 72)


@query("select * from pairs", _RASTERS, _FPD, _pairs(80))
def candidate_pairs_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold at which bands select nothing."""
    return sim.candidate_pairs_banded(materialize(fingerprint_table(spark, sf_dir, planted=True), "fp"), 80)


@query("select * from pairs", _RASTERS, _FPD, _pairs(100))
def candidate_pairs_banded_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.candidate_pairs_banded(materialize(fingerprint_table(spark, sf_dir, planted=True), "fp"), 100)


@query(f"""select a.image_id as src, b.image_id as dst, bit_count(xor(a.a_hash, b.a_hash)) as ha, bit_count(xor(a.d_hash, b.d_hash)) as hd,
  {_score("a", "b")} as score,
  2128 * bit_count(xor(a.a_hash, b.a_hash)) + 2688 * bit_count(xor(a.d_hash, b.d_hash)) <= 3584 * 28 as within_bound
  from fp a join fp b on b.image_id = a.image_id + 1""", _RASTERS, _FP)
def visual_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster against the next: distances, score and bound."""
    a = fingerprint_table(spark, sf_dir).select(F.col("image_id").alias("src"), F.col("a_hash").alias("a1"), F.col("d_hash").alias("d1"), F.col("color_hist").alias("h1"))
    b = fingerprint_table(spark, sf_dir).select((F.col("image_id") - 1).alias("src"), F.col("image_id").alias("dst"), F.col("a_hash").alias("a2"), F.col("d_hash").alias("d2"), F.col("color_hist").alias("h2"))
    ha, hd = S.hamming(F.col("a1"), F.col("a2")), S.hamming(F.col("d1"), F.col("d2"))
    joined = a.join(b.hint("merge"), "src").withColumn("ha", ha).withColumn("hd", hd)
    score = S.visual_score(F.col("ha"), F.col("hd"), S.hist_l1(F.col("h1"), F.col("h2")), 64, 56, 2.0)
    return joined.select("src", "dst", "ha", "hd", score.alias("score"), S.within_hash_bound(F.col("ha"), F.col("hd"), 72, 64, 56).alias("within_bound"))


_COMPONENTS = """
links as (select src, dst from pairs union all select dst, src from pairs),
reach as (select src as v, src as r from links union select l.src, r.r from links l join reach r on l.dst = r.v),
comp as (select v as image_id, min(r) as group_key from reach group by v)"""


@query("select image_id as vertex, group_key as component from comp", _RASTERS, _FPD, _pairs(88), _COMPONENTS, recursive=True)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(sim.candidate_pairs_banded(materialize(fingerprint_table(spark, sf_dir, planted=True), "fp")))


_GROUPS = f"""
member as (select fp.*, group_key from fp join comp using (image_id)),
anchor as (select * from (select *, row_number() over (partition by group_key order by width * height desc, size_bytes desc, sharpness desc, path, image_id) as rn from member) where rn = 1),
scored as (select m.*, a.image_id as anchor_id, a.path as anchor_path, case when m.image_id = a.image_id then 100.0::double else {_score("m", "a")} end as score_to_anchor
  from member m join anchor a on m.group_key = a.group_key),
summary as (select group_key, count(*) as n_members, cast(sum(size_bytes) as bigint) as total_bytes, min(score_to_anchor) as min_score, min(anchor_path) as anchor_path from scored group by group_key),
numbered as (select *, row_number() over (order by n_members desc, total_bytes desc, lower(anchor_path), group_key) as group_no from summary),
ordered as (select s.*, n.group_no, n.n_members, row_number() over (partition by s.group_key order by score_to_anchor desc, width * height desc, lower(path), image_id) as member_no
  from scored s join numbered n using (group_key))"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.similar_groups(fingerprint_table(spark, sf_dir, planted=True))


@query("""select group_no, member_no, image_id, path, anchor_id, score_to_anchor, n_members,
  row_number() over (partition by group_key order by width * height desc, size_bytes desc, sharpness desc, member_no) > 1 as checked from ordered""",
       _RASTERS, _FPD, _pairs(88), _COMPONENTS, _GROUPS, recursive=True)
def similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: from rasters to numbered groups with anchors, scores and what to keep."""
    return _reviewed(spark, sf_dir).select("group_no", "member_no", "image_id", "path", "anchor_id", "score_to_anchor", "n_members", "checked")


@query("select group_no, n_members, total_bytes, min_score, anchor_path from numbered", _RASTERS, _FPD, _pairs(88), _COMPONENTS, _GROUPS, recursive=True)
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = materialize(fingerprint_table(spark, sf_dir, planted=True), "fp")
    table = materialize(sim.members(fp, sim.candidate_pairs_banded(fp)), "members")
    scored = sim.score_to_anchor(table, sim.pick_anchor(table))
    return sim.number_groups(sim.group_summary(scored)).select("group_no", "n_members", "total_bytes", "min_score", "anchor_path")


@query(" union all ".join(f"""select '{rule}' as rule, image_id from (select image_id, row_number() over (partition by group_key order by {order}, member_no) as rn from ordered) where rn = 1"""
       for rule, order in {"resolution": "width * height desc, size_bytes desc, sharpness desc", "sharpest": "sharpness desc, width * height desc", "newest": "mtime desc", "oldest": "mtime",
                           "largest": "size_bytes desc", "smallest": "size_bytes", "shortest": "length(path)"}.items()), _RASTERS, _FPD, _pairs(88), _COMPONENTS, _GROUPS, recursive=True)
def keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the seven rules keeps."""
    return sim.best_by_rules(sim.ordered_groups(fingerprint_table(spark, sf_dir, planted=True)))


@query("""select count(*) filter (where rn > 1) as n_checked, count(*) as n_members from
  (select row_number() over (partition by group_key order by width * height desc, size_bytes desc, sharpness desc, member_no) as rn from ordered)""",
       _RASTERS, _FPD, _pairs(88), _COMPONENTS, _GROUPS, recursive=True)
def checked_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.checked_summary(_reviewed(spark, sf_dir))


@query("""select group_key, image_id, first_value(image_id) over w as anchor_id, score_to_anchor, cast(dense_rank() over (order by group_no) as bigint) as group_no from
  (select *, count(*) over (partition by group_key) as n from ordered where image_id % 3 <> 0) where n > 1
  window w as (partition by group_key order by width * height desc, size_bytes desc, sharpness desc, path, image_id)""",
       _RASTERS, _FPD, _pairs(88), _COMPONENTS, _GROUPS, recursive=True)
def drop_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = materialize(_reviewed(spark, sf_dir), "reviewed")
    return sim.drop_removed(table, table.filter("image_id % 3 = 0")).select("group_key", "image_id", "anchor_id", "score_to_anchor", "group_no")


@query("""select group_no as "group", row_number() over (partition by group_key order by width * height desc, size_bytes desc, sharpness desc, member_no) > 1 as checked,
  score_to_anchor, path, anchor_path, width, height, printf('%.3f', width * height / 1e6) as megapixels, size_bytes, mtime, printf('%.2f', sharpness) as sharpness from ordered""",
       _RASTERS, _FPD, _pairs(88), _COMPONENTS, _GROUPS, recursive=True)
def manifest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the review file and reads it back."""
    path = shared_path(spark, "manifest")
    sim.write_manifest_csv(_reviewed(spark, sf_dir), path)
    schema = "`group` int, checked boolean, score_to_anchor double, path string, anchor_path string, width int, height int, megapixels string, size_bytes long, mtime double, sharpness string"
    return spark.read.schema(schema).option("header", True).csv(path)


@query("""select a_hash, d_hash, min(image_id) as image_id, count(*) as n_copies from fp group by a_hash, d_hash, color_hist""", _RASTERS, _FPD)
def exact_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = materialize(fingerprint_table(spark, sf_dir, planted=True), "fp")
    kept, copies = sim.exact_fingerprint_dedup(fp, ["a_hash", "d_hash", "color_hist"])
    counts = copies.groupBy(F.col("src").alias("image_id")).agg(F.count("*").alias("n"))
    return kept.join(counts.hint("merge"), "image_id", "left").select("a_hash", "d_hash", "image_id", (F.coalesce("n", F.lit(0)) + 1).alias("n_copies"))
