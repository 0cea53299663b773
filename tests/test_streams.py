"""Streams over several batches: merged updates, revisions that survive a new process, no rewriting of what stays."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from mosaique.session import local_session, shared_path
from mosaique.streaming import log_table, streams

SCHEMA = "job_id long, ts timestamp, event_id long, status string, percent int"


@pytest.fixture()
def events(spark, tmp_path):
    """Four files, each a batch; some jobs are in one of them only."""
    rows = []
    for k in range(4):
        part = spark.range(40).select(
            (F.col("id") % (7 + 3 * k)).alias("job_id"), F.timestamp_seconds(F.lit(1_700_000_000 + 1000 * k) + F.col("id")).alias("ts"), (F.col("id") + 100 * k).alias("event_id"),
            F.concat(F.lit(f"s{k}-"), F.col("id")).alias("status"), (F.col("id") % 101).cast("int").alias("percent"))
        if k == 3:
            part = part.filter("job_id > 12")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows.append(part)
    return str(tmp_path / "in"), rows


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_update_and_complete_results_are_the_batch_result(spark, events):
    path, _ = events
    batch = streams.job_rollup(spark.read.schema(SCHEMA).parquet(path), "job_id", "ts", "event_id")
    want = sorted(map(tuple, batch.collect()))
    for mode, key in (("update", ["job_id"]), ("complete", None)):
        found = streams.run_to_table(spark, streams.job_rollup(stream(spark, path), "job_id", "ts", "event_id"), mode, key)
        assert sorted(map(tuple, found.collect())) == want
    with pytest.raises(ValueError, match="key"):
        streams.run_to_table(spark, streams.job_rollup(stream(spark, path), "job_id", "ts", "event_id"), "update")


def latest(spark, path):
    rows = spark.read.schema(SCHEMA).parquet(path)
    return sorted((r.job_id, r.event_id, r.status) for r in rows.groupBy("job_id").agg(F.max_by(F.struct("event_id", "status"), "event_id").alias("r")).select("job_id", "r.*").collect())


def found(sink):
    return sorted((r.job_id, r.event_id, r.status) for r in sink.table().collect())


def test_latest_revisions_go_on_where_another_process_stopped(spark, events, tmp_path):
    path, _ = events
    base = shared_path(spark, "revisions")
    sink = log_table.LatestRevisions(spark, "job_id", "event_id", base)
    assert sink.table() is None
    sink.follow(stream(spark, path))
    assert found(sink) == latest(spark, path)
    spark.createDataFrame([(3, None, 9_000, "new", 1), (77, None, 9_001, "added", 2)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    again = log_table.LatestRevisions(spark, "job_id", "event_id", base)
    again.follow(stream(spark, path))
    assert found(again) == found(sink) == latest(spark, path) and (77, 9_001, "added") in found(again)


def lines(folder):
    """Rows in each parquet file under a folder."""
    import pyarrow.parquet as pq

    return {p: pq.read_metadata(p).num_rows for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def test_a_change_writes_what_it_changes(spark, tmp_path):
    base = str(tmp_path / "log")
    sink = log_table.LatestRevisions(spark, "job_id", "event_id", base)
    whole = spark.range(200).select(F.col("id").alias("job_id"), F.lit(1).cast("long").alias("event_id"), F.lit("a").alias("status"))
    sink.merge(whole, 0)
    sink.merge(whole.filter("job_id < 50"), 1)
    assert sum(lines(f"{base}/changes").values()) == 200
    one = whole.filter("job_id = 5").withColumns({"event_id": F.lit(2).cast("long"), "status": F.lit("b")})
    sink.merge(one, 2)
    sink.merge(one, 2)  # run again after a failure
    assert sum(lines(f"{base}/changes").values()) == 201 and sink.table().count() == 200
    assert [r["status"] for r in sink.table().filter("job_id = 5").collect()] == ["b"]


def test_orphans_are_in_no_file_after_compaction(spark, tmp_path):
    base = str(tmp_path / "log")
    sink = log_table.LatestRevisions(spark, "job_id", "event_id", base)
    whole = spark.range(200).select(F.col("id").alias("job_id"), F.lit(1).cast("long").alias("event_id"))
    sink.remove_orphans(whole)
    sink.merge(whole, 0)
    sink.remove_orphans(whole.filter("job_id < 10"))
    assert sorted(r["job_id"] for r in sink.table().collect()) == list(range(10))
    assert sum(lines(f"{base}/changes").values()) == 0 and sum(lines(f"{base}/whole").values()) == 10
    again = log_table.LatestRevisions(spark, "job_id", "event_id", base)
    again.merge(whole.filter("job_id in (3, 50)").withColumn("event_id", F.lit(2).cast("long")), 1)
    assert sorted((r["job_id"], r["event_id"]) for r in again.table().filter("event_id = 2").collect()) == [(3, 2), (50, 2)] and again.table().count() == 11
    again.merge(whole.filter("job_id = 3"), 0)  # a batch from before the compaction, run again, changes nothing
    assert again.table().count() == 11 and again.table().filter("job_id = 3").first()["event_id"] == 2


def test_many_changes_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_table, "MAX_CHANGES", 3)
    log = log_table.LogTable(spark, "k", str(tmp_path / "log"))
    for b in range(7):
        log.write(spark.createDataFrame([(b % 4, b)], "k int, v int"), b)
    assert sorted(map(tuple, log.table().collect())) == [(0, 4), (1, 5), (2, 6), (3, 3)]
    assert log._published() == (5, [6]) and sum(lines(f"{log.base}/whole").values()) == 4


def test_only_new_and_changed_files_are_fingerprinted(spark, tmp_path):
    """Three batches: new files; the same again with one changed and one new; nothing new. A second process goes on from the first."""
    seen, folder, base = [], str(tmp_path / "in"), str(tmp_path / "cache")
    compute = lambda rows: rows.select("path", "size_bytes", "mtime", (F.col("content") * 2).alias("hash"))
    batches = [[(f"/{k}.png", 10, 1, k) for k in range(20)], [(f"/{k}.png", 10, 1, k) for k in range(20)] + [("/3.png", 11, 1, 300), ("/new.png", 10, 2, 7)], [(f"/{k}.png", 10, 1, k) for k in range(4, 9)]]
    schema = "path string, size_bytes long, mtime long, content long"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        cache = log_table.FingerprintCache(spark, compute, base)
        cache.follow(spark.readStream.schema(schema).parquet(folder))
        seen += cache.computed.values()
    assert seen == [20, 2, 0]
    table = {r["path"]: r["hash"] for r in cache.table().collect()}
    assert len(table) == 21 and table["/3.png"] == 600 and table["/new.png"] == 14 and table["/8.png"] == 16


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from mosaique import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Context(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    assert local_session is not None and os.sep in session.shared_path(spark, "x")
