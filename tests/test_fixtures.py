"""Exact small cases: timelines, geometry, names, versions, pairs, components, plans."""

import zlib
import struct

import pytest
from pyspark.sql import functions as F

from mosaique.functions import geometry as G, scalars as S
from mosaique.operators import batch, graph, jobs, raster, similarity, timeline
from mosaique.plans import chain
from mosaique.queries.similar import fingerprint_table
from mosaique.session import materialize


def clip(spark, durations):
    return spark.createDataFrame([(1, k, d) for k, d in enumerate(durations)], "clip_id long, frame_idx long, duration_ms long")


def durations(df):
    return [r.duration_ms for r in df.orderBy("frame_idx").collect()]


def test_extend_repeat(spark):
    frames = clip(spark, [100, 200, 300])
    assert durations(timeline.extend_repeat(frames, F.lit(1050), 1, 2)) == [100, 200, 300, 200, 250]
    assert durations(timeline.extend_repeat(frames, F.lit(605))) == [100, 200, 305]
    assert timeline.extend_repeat(frames, F.lit(600)).count() == 0


def test_extend_hold_and_limit(spark):
    frames = clip(spark, [100, 200, 300])
    assert durations(timeline.extend_hold(frames, F.lit(1600))) == [100, 200, 1300]
    row = timeline.extension_limit(frames, F.lit(1200), F.lit(1), max_frames=4).first()
    assert (row.projected, row.frame_limit, row.allowed) == (6, 4, False)


def test_slice_and_retime(spark):
    cut = timeline.slice_clip(clip(spark, [100, 200, 300, 400]), F.lit(150), F.lit(500))
    assert durations(cut) == [150, 300, 50]
    timed = durations(timeline.retime(materialize(cut.select("clip_id", "frame_idx", "duration_ms"), "t"), F.lit(1250)))
    assert len(timed) == 3 and sum(timed) == 1250 and all(d >= 10 and d % 10 == 0 for d in timed)


def test_slice_of_one_frame_is_split(spark):
    assert durations(timeline.slice_clip(clip(spark, [100, 1000, 100]), F.lit(200), F.lit(55))) == [20, 35]


def test_null_and_zero_durations(spark):
    assert durations(timeline.clean_durations(clip(spark, [0, None, 3, 50]))) == [100, 100, 10, 50]


def test_stride_keeps_total(spark):
    frames = clip(spark, [1000] * 100)
    reduced = durations(timeline.stride_reduce(frames, 3))
    assert len(reduced) == 34 and sum(reduced) == 100_000


def test_import_plan(spark):
    row = timeline.plan_import_reduction(spark.createDataFrame([(1, 216_000, 7_200_000, 1920, 1080)], "clip_id int, n_frames long, total_ms long, width int, height int")).first()
    assert row.reduced and -(-216_000 // row.stride) <= 900 and 0.2 <= row.scale <= 1


def test_empty_clips(spark):
    frames = clip(spark, [100]).limit(0)
    for df in (timeline.frame_bounds(frames), timeline.slice_clip(frames, F.lit(0), F.lit(10)), timeline.retime(frames, F.lit(100)), timeline.extend_repeat(frames, F.lit(100)), timeline.resample_fps(frames)):
        assert df.count() == 0


@pytest.mark.parametrize(("low", "high"), [("0.9.0 RC32", "v0.9.0-RC33"), ("0.9.0 RC999", "0.9.0"), ("0.9.9", "1.0.0 RC1")])
def test_version_order(spark, low, high):
    row = spark.createDataFrame([(low, high, "1.2")], "a string, b string, c string").select((S.version_key(F.col("a")) < S.version_key(F.col("b"))).alias("less"), S.version_key(F.col("c")).alias("none")).first()
    assert row.less and row.none is None


def test_collision_free_names_with_numbers_in_names(spark):
    plan = spark.createDataFrame([("f", "a.png", 0), ("f", "a (2).png", 1), ("f", "a.png", 2), ("f", "a.png", 3), ("g", "a.png", 4)], "folder string, name string, position int")
    existing = spark.createDataFrame([("f", "a.png")], "folder string, name string")
    names = {r.position: (r.folder, r.final_name) for r in batch.collision_free_names(plan, existing).collect()}
    assert len(set(names.values())) == 5 and ("f", "a.png") not in names.values()
    assert names[1] == ("f", "a (2).png") and names[4] == ("g", "a.png")


def test_geometry(spark):
    box = G.rect(F.lit(20), F.lit(10), F.lit(80), F.lit(70))
    row = spark.range(1).select(G.scale_rect(box, 0.5, 0.5).alias("half"), G.scale_rect_preview(G.rect(F.lit(5), F.lit(5), F.lit(5), F.lit(9)), 2.0, 2.0).alias("empty")).first()
    assert tuple(row.half) == (10, 5, 40, 35) and tuple(row.empty) == (10, 10, 10, 10)


def test_targets(spark):
    pixels = spark.range(400).select(F.lit(1).alias("image_id"), (F.col("id") % 20).cast("int").alias("x"), F.floor(F.col("id") / 20).cast("int").alias("y"), F.lit(7).alias("v"))
    hit = {(r.x, r.y) for r in raster.apply_to_target(pixels, "v", F.lit(9), box=(5, 5, 10, 10)).filter("v = 9").collect()}
    assert (0, 0) not in hit and (7, 7) in hit and (10, 10) in hit and len(hit) == 36
    assert raster.apply_to_target(pixels, "v", F.lit(9), box=(10, 10, 10, 20)).filter("v = 9").count() == 0
    assert raster.apply_to_target(pixels, "v", F.lit(9), polygon=[(1, 1), (5, 5)]).filter("v = 9").count() == 0


def test_identical_rasters_score_100(spark):
    rows = spark.createDataFrame([(1, [9] * 64), (2, [9] * 64)], "image_id long, luma array<int>")
    pairs = similarity.similar_pairs_exact(similarity.fingerprints(rows), 100).collect()
    assert [(r.src, r.dst, r.score) for r in pairs] == [(1, 2, 100.0)]


@pytest.mark.parametrize("threshold", [88, 92, 95, 100])
def test_banded_equals_exact(spark, sf_dir, threshold):
    fp = materialize(fingerprint_table(spark, sf_dir, planted=True), "fp")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(similarity.candidate_pairs_banded(fp, threshold)) == rows(similarity.similar_pairs_exact(fp, threshold))


def test_plans_have_no_cartesian_product_and_no_python(spark, sf_dir):
    fp = fingerprint_table(spark, sf_dir)
    for df in (similarity.similar_pairs_exact(fp, 88), similarity.candidate_pairs_banded(fp, 95), timeline.frame_bounds(clip(spark, [1]))):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


@pytest.mark.parametrize("bound", [0, 100_000])
def test_components(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "TASK_EDGES", bound)
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    found = {r.vertex: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(found[k] == 1 for k in range(1, 61)) and all(found[k] == 100 for k in range(100, 130))
    assert found[200] == 200 and found[301] == 300 and len(found) == 60 + 30 + 1 + 2


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_history_is_bounded(spark):
    rows = spark.createDataFrame([(k, k) for k in range(250)], "job_id int, started_at int")
    newest = jobs.job_history(rows).collect()
    assert len(newest) == 200 and newest[0].job_id == 249


def test_empty_chain_is_identity_and_missing_step_is_an_error(spark):
    df = spark.range(3)
    assert chain.compose()(df) is df
    with pytest.raises(Exception):
        chain.compose(lambda d: None)(df)


def test_shuffle_of_tiles_repeats(spark):
    pixels = spark.range(64).select(F.lit(1).alias("image_id"), (F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"), F.col("id").cast("int").alias("luma"))
    once = sorted(map(tuple, raster.seeded_tile_shuffle(pixels, "luma", 2, 50, 1).collect()))
    assert once == sorted(map(tuple, raster.seeded_tile_shuffle(pixels, "luma", 2, 50, 1).collect()))
    assert {r[3] for r in once} <= set(range(64)) and once != sorted(map(tuple, pixels.collect()))


def png(width, height, rgb):
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(c for x in range(width) for c in rgb(x, y)) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_read_rasters(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2, lambda x, y: (x * 10, y * 20, 200 + x)))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    rows = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in raster.read_rasters(spark, str(tmp_path)).collect()}
    assert rows == {(x, y): (x * 10, y * 20, 200 + x, 255) for x in range(3) for y in range(2)}
    assert raster.bad_rasters(spark, str(tmp_path)).count() == 1


def test_sheets(spark, tmp_path, monkeypatch):
    """Many pictures share a file; numbers may be null, negative, sparse or repeated, and a row without a picture has no pixels."""
    monkeypatch.setattr(raster, "SHEET", 8)
    numbers = [None, -5, 1 << 62, 7, 7, *range(100, 125)]
    rows = [(n, [(k * 31 + p) % 256 for p in range(6)]) for k, n in enumerate(numbers)]
    table = spark.createDataFrame([*rows, (9, None)], "number long, luma array<int>").coalesce(1)
    raster.write_sheets(table, str(tmp_path / "sheets"), 3, 2)
    assert len(list((tmp_path / "sheets").glob("part-*"))) == 4
    found = [tuple(r) for r in raster.read_rasters(spark, str(tmp_path / "sheets"), height=2).collect()]
    want = [(n, p % 3, p // 3, v, v, v, 255) for n, luma in rows for p, v in enumerate(luma)]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_read_rasters_query_writes_few_files(spark, sf_dir, tmp_path, monkeypatch):
    from mosaique.queries import pixels

    monkeypatch.setattr(pixels, "shared_path", lambda spark, name: str(tmp_path / name))
    n = pixels.read_rasters(spark, sf_dir).select("image_id").distinct().count()
    assert n > 100 and len([p for p in (tmp_path / "bitmaps").rglob("part-*") if p.is_file()]) <= n / 10


def test_scan_media(spark, tmp_path):
    from mosaique.sources.media import scan_media

    (tmp_path / "nested").mkdir()
    for name in ("first.png", "nested/second.JPG", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = [r.path.rsplit("/", 1)[1] for r in scan_media(spark, str(tmp_path)).collect()]
    assert found == ["first.png", "second.JPG"]
    assert scan_media(spark, str(tmp_path / "missing")).count() == 0
