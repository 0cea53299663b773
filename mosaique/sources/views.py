"""Media tables derived from the star-schema tables: rasters, clips, a file catalogue, regions, releases.

Each is one projection over a Parquet scan, so filters and column pruning reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LUMA_ARRAY = "transform(embedding, v -> cast(greatest(0, least(255, floor((cast(v as double) + 0.5D) * 255))) as int))"


def raster_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, luma (array of 64): each vector as an 8 x 8 raster, row by row."""
    return _table(spark, sf_dir, "embeddings").selectExpr("vec_id as image_id", f"{LUMA_ARRAY} as luma")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, luma: one row per pixel."""
    flat = raster_arrays(spark, sf_dir).selectExpr("image_id", "posexplode(luma) as (pos, luma)")
    return flat.selectExpr("image_id", "cast(pos % 8 as int) as x", "cast(pos div 8 as int) as y", "luma")


def colored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, r, g, b: three vectors side by side as a 24 x 8 picture (the last one may be narrower)."""
    return raster(spark, sf_dir).selectExpr("image_id div 3 as image_id", "cast(image_id % 3 * 8 + x as int) as x", "y", "luma as r", "cast((luma * 3 + x * 5 + y) % 256 as int) as g", "255 - luma as b")


def joined_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, luma: 64 vectors as one 64 x 64 picture (the last one may have a gap)."""
    return raster(spark, sf_dir).selectExpr("image_id div 64 as image_id", "cast(image_id % 8 * 8 + x as int) as x", "cast(image_id % 64 div 8 * 8 + y as int) as y", "luma")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame_idx, duration_ms, event_type, value: each user's events as the frames of a clip."""
    events = _table(spark, sf_dir, "events").selectExpr(
        "user_id as clip_id", "event_id", "event_type", "value", "ts", "unix_micros(cast(ts as timestamp)) as us"
    )
    ranked = events.selectExpr(
        "clip_id", "row_number() over (partition by clip_id order by ts, event_id) - 1 as frame_idx", "us",
        "lead(us) over (partition by clip_id order by ts, event_id) as nxt", "event_type", "value",
    )
    return ranked.selectExpr("clip_id", "frame_idx", "coalesce((nxt - us) div 1000, 100L) as duration_ms", "event_type", "value")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, path, ext, width, height, size_bytes, mtime, n_frames, has_alpha: parts as media files."""
    part = _table(spark, sf_dir, "part").selectExpr(
        "*", "element_at(array('png','jpg','gif','webp','tiff','txt','mp4','jpeg'), cast(p_partkey % 8 as int) + 1) as ext"
    )
    return part.selectExpr(
        "p_partkey as image_id", "concat('/lib/', replace(p_brand, '#', ''), '/', replace(p_name, ' ', '_'), '.', ext) as path", "ext",
        "64 + p_size * 40 as width", "cast(48 + (p_partkey % 97) * 16 as int) as height", "cast(floor(p_retailprice * 100) as bigint) as size_bytes",
        "1700000000D + p_partkey * 60 as mtime", "cast(case when ext in ('gif', 'mp4') then 2 + p_partkey % 50 else 1 end as int) as n_frames",
        "p_partkey % 3 = 0 as has_alpha",
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, kind, box, points: suppliers as rectangles, ellipses and polygons on the 8 x 8 raster, some without area."""
    return _table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as region_id", "element_at(array('rect', 'ellipse', 'polygon'), cast(s_suppkey % 3 as int) + 1) as kind",
        "cast(s_suppkey % 5 as int) as l", "cast(s_suppkey % 4 as int) as t", "cast(s_suppkey % 5 + s_suppkey % 6 as int) as r", "cast(s_suppkey % 4 + s_suppkey % 7 as int) as b",
    ).selectExpr(
        "region_id", "kind", "named_struct('left', l, 'top', t, 'right', r, 'bottom', b) as box",
        "case when region_id % 11 = 0 then array(named_struct('x', l, 'y', t), named_struct('x', r, 'y', b)) else "
        "array(named_struct('x', l, 'y', t), named_struct('x', r, 'y', t), named_struct('x', cast((l + r) div 2 as int), 'y', b)) end as points",
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """release_id, tag, draft, prerelease, assets: orders as releases with installers."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as release_id",
        "concat(case when o_orderkey % 2 = 0 then 'v' else '' end, o_orderkey % 3, '.', o_custkey % 10, '.', o_orderkey % 7, "
        "case o_orderkey % 4 when 0 then concat('-RC', o_custkey % 50) when 1 then concat(' rc ', o_custkey % 9) else '' end, case when o_orderkey % 13 = 0 then '-beta' else '' end) as tag",
        "o_orderkey % 17 = 0 as draft", "o_orderkey % 4 in (0, 1) as prerelease",
        "filter(array(named_struct('name', concat('Studio-Setup-', o_orderkey % 9, '-x64.exe'), 'size', o_orderkey % 1000), "
        "named_struct('name', concat('Studio-Setup-', o_custkey % 9, '-arm64.exe'), 'size', o_orderkey % 500), "
        "named_struct('name', concat('Studio-', o_custkey % 9, '.zip'), 'size', o_orderkey % 100)), (a, i) -> (o_orderkey div 2 + i) % 3 <> 0) as assets",
    )


RASTER_SQL = """
v_raster as (select vec_id as image_id, cast((pos - 1) % 8 as int) as x, cast((pos - 1) // 8 as int) as y,
  cast(greatest(0, least(255, floor((cast(embedding[pos] as double) + 0.5) * 255))) as int) as luma
  from embeddings, range(1, 65) r(pos))"""

COLORED_SQL = """
v_colored as (select image_id // 3 as image_id, cast(image_id % 3 * 8 + x as int) as x, y, luma as r, cast((luma * 3 + x * 5 + y) % 256 as int) as g, 255 - luma as b from v_raster)"""

JOINED_SQL = """
v_joined as (select image_id // 64 as image_id, cast(image_id % 8 * 8 + x as int) as x, cast(image_id % 64 // 8 * 8 + y as int) as y, luma from v_raster)"""

FRAMES_SQL = """
v_frames as (select clip_id, frame_idx, coalesce((nxt - us) // 1000, 100) as duration_ms, event_type, value
  from (select user_id clip_id, row_number() over w - 1 frame_idx, epoch_us(ts) us, lead(epoch_us(ts)) over w nxt, event_type, value
        from events window w as (partition by user_id order by ts, event_id)))"""

CATALOG_SQL = """
v_catalog as (select p_partkey as image_id, '/lib/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || '.' || ext as path, ext,
  64 + p_size * 40 as width, cast(48 + (p_partkey % 97) * 16 as int) as height, cast(floor(p_retailprice * 100) as bigint) as size_bytes,
  1700000000::double + p_partkey * 60 as mtime, cast(case when ext in ('gif', 'mp4') then 2 + p_partkey % 50 else 1 end as int) as n_frames,
  p_partkey % 3 = 0 as has_alpha
  from (select *, (['png','jpg','gif','webp','tiff','txt','mp4','jpeg'])[p_partkey % 8 + 1] ext from part))"""

REGIONS_SQL = """
v_regions as (select s_suppkey as region_id, (['rect', 'ellipse', 'polygon'])[s_suppkey % 3 + 1] as kind,
  cast(s_suppkey % 5 as int) as l, cast(s_suppkey % 4 as int) as t, cast(s_suppkey % 5 + s_suppkey % 6 as int) as r, cast(s_suppkey % 4 + s_suppkey % 7 as int) as b
  from supplier)"""

RELEASES_SQL = """
v_releases as (select o_orderkey as release_id,
  (case when o_orderkey % 2 = 0 then 'v' else '' end) || (o_orderkey % 3) || '.' || (o_custkey % 10) || '.' || (o_orderkey % 7) ||
  (case o_orderkey % 4 when 0 then '-RC' || (o_custkey % 50) when 1 then ' rc ' || (o_custkey % 9) else '' end) ||
  (case when o_orderkey % 13 = 0 then '-beta' else '' end) as tag,
  o_orderkey % 17 = 0 as draft, o_orderkey % 4 in (0, 1) as prerelease,
  list_transform(list_filter([{'i': 0, 'name': 'Studio-Setup-' || (o_orderkey % 9) || '-x64.exe'}, {'i': 1, 'name': 'Studio-Setup-' || (o_custkey % 9) || '-arm64.exe'},
    {'i': 2, 'name': 'Studio-' || (o_custkey % 9) || '.zip'}], lambda a: (o_orderkey // 2 + a.i) % 3 <> 0), lambda a: a.name) as assets
  from orders)"""
