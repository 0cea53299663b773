"""Throttling folds rows in order of time; no key's events are collected into one row or one frame."""

from pyspark.sql import functions as F

from mosaique.operators import jobs
from mosaique.streaming import stateful, streams


def brute(rows, gap):
    last, seen = {}, []
    for user, us, number, final in rows:
        if final or user not in last or us - last[user] >= gap:
            last[user] = us
            seen.append((user, number))
    return sorted(seen)


def table(spark, begin, end):
    """A third of all events belong to one user."""
    user = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).cast("long")
    rows = spark.range(begin, end).select(user.alias("user_id"), F.timestamp_micros(F.col("id") * 7 % 4001 + F.floor(F.col("id") / 2000) * 4001).alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 50 == 7).alias("final"))
    return rows.repartition(3)


def local(df):
    return sorted((r.user_id, r.us, r.event_id, r.final) for r in df.withColumn("us", F.unix_micros("ts")).collect())


def test_throttle_collects_no_group(spark):
    events = table(spark, 0, 6000)
    found = jobs.throttle(events, ["user_id"], 90, F.col("final"))
    assert sorted(map(tuple, found.collect())) == brute(local(events), 90)
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
    assert jobs.throttle(events.limit(0), ["user_id"], 90, F.col("final")).count() == 0


def test_stream_carries_times_over_batches_and_restarts(spark, tmp_path):
    """The order of the batches is that of their times, so the stream sees what the table does; a second run goes on from the checkpoint."""
    folder, base = str(tmp_path / "in"), str(tmp_path / "base")
    for k in range(3):
        table(spark, k * 2000, k * 2000 + 2000).coalesce(1).write.mode("append").parquet(folder)
        if k == 0:
            continue
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
        found = stateful.throttle(spark, stream, "user_id", "ts", "event_id", F.col("final"), 90, base)
        assert sorted(map(tuple, found.collect())) == brute(local(spark.read.parquet(folder)), 90)


def test_state_holds_a_time_a_key(spark, tmp_path):
    """A batch of one key changes the state of one key: later batches don't write the others again."""
    folder, base = str(tmp_path / "in"), str(tmp_path / "base")
    rows = [[(u, 1_000_000, u, False) for u in range(400)], [(7, 5_000_000, 1000, False)]]
    for part in rows:
        spark.createDataFrame(part, "user_id long, us long, event_id long, final boolean").select("user_id", F.timestamp_micros("us").alias("ts"), "event_id", "final").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        found = stateful.throttle(spark, stream, "user_id", "ts", "event_id", F.col("final"), 90, base)
    assert found.count() == 401
    held = spark.read.format("statestore").option("stateVarName", "last").load(f"{base}/state")
    assert held.count() == 400 and held.filter("key.user_id = 7").select("value.value.us").first()[0] == 5_000_000


def test_timers_give_what_idle_time_gives(spark, tmp_path):
    """Stretches of activity over several batches, out of order within the delay, against a plain walk."""
    folder = str(tmp_path / "in")
    times = [(k % 5, (1000 + k * 37 % 90 + 60 * (k // 90)) * 1_000_000) for k in range(360)] + [(9, 10_000_000_000)]
    for k in range(0, len(times), 90):
        spark.createDataFrame(times[k : k + 90], "user_id long, us long").select("user_id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = streams.run_to_table(spark, stateful.expire(stream, "user_id", "ts", 2_000_000, "90 seconds"))
    want = []
    for user in range(5):
        own = sorted(us for u, us in times if u == user)
        start = 0
        for k in range(1, len(own) + 1):
            if k == len(own) or own[k] - own[k - 1] > 2_000_000:
                want.append((user, own[start], own[k - 1], k - start))
                start = k
    got = found.select("user_id", F.unix_micros("first"), F.unix_micros("last_seen"), "n")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_expiry_calls_no_python_for_a_key(spark, tmp_path):
    """Stretches are Spark's own session windows, with the same gap to the microsecond."""
    rows = [(1, 0), (1, 2_000_000), (1, 4_000_001), (2, 5), (3, 400_000_000)]
    spark.createDataFrame(rows, "user_id long, us long").select("user_id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    out = stateful.expire(stream, "user_id", "ts", 2_000_000, "90 seconds")
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "Python" not in plan
    got = streams.run_to_table(spark, out).select("user_id", F.unix_micros("first"), F.unix_micros("last_seen"), "n")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 2_000_000, 2), (1, 4_000_001, 4_000_001, 1), (2, 5, 5, 1)]
