"""The segmented scan against plain windows, with one key that holds most of the rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from mosaique.operators.scan import numbered, scan


def rows(seed, n, hot):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]) if rng.random() > hot else "hot", rng.choice([None, *range(40)]), k, rng.choice([None, 1, 2, 3])) for k in range(n)]


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_scan_is_a_window(spark, hot):
    df = spark.createDataFrame(rows(3, 700, hot), "k string, t int, id int, v int")
    within = Window.partitionBy("k").orderBy("t", "id")
    upto, before = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({"no": F.row_number().over(within), "s": F.sum(F.coalesce("v", F.lit(0))).over(upto), "p": F.last("v", ignorenulls=True).over(before)})
    found = scan(df, ["k"], ["t", "id"], number="no", sums={"s": F.col("v")}, lasts={"p": F.col("v")}, partitions=13)
    assert found.columns == ["k", "t", "id", "v", "no", "s", "p"]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[2]) == sorted(map(tuple, want.collect()), key=lambda r: r[2])


def test_descending_order_and_ties(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("a", 2)] * 50, "k string, t int")
    found = scan(df, ["k"], [F.desc("t")], number="no", partitions=7).collect()
    assert sorted(r["no"] for r in found) == list(range(1, 101))
    assert all(r["no"] <= 50 for r in found if r["t"] == 2)


def test_one_order_over_the_table(spark):
    df = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "v int")
    assert all(r["no"] == r["v"] + 1 for r in numbered(df, ["v"], "no").collect())


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, t int")
    assert scan(df, ["k"], ["t"], number="no", sums={"s": F.col("t")}, lasts={"p": F.col("t")}).collect() == []


def test_no_task_gets_a_hot_key_whole(spark):
    """Nine tenths of the rows have one key; the window's partitions still hold no more than a few ranges' share."""
    n, parts = 20_000, 16
    df = spark.range(n).select(F.when(F.col("id") % 10 > 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    found = scan(df, ["k"], ["id"], number="no", partitions=parts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_scan_part" in plan and "hashpartitioning(k" not in plan
    stored = df.repartitionByRange(parts, "k", "id").groupBy(F.spark_partition_id()).count()
    assert stored.agg(F.max("count")).first()[0] < 2 * n / parts
    assert found.filter("k = 0").agg(F.max("no")).first()[0] == df.filter("k = 0").count()


def shuffled_by(df):
    """What the plan's windows need together: (partition, key) of the scan, or a key's whole rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if " Window " in line or line.strip().startswith(("Window", "+- Window"))]


def test_operators_give_a_hot_key_to_no_window(spark):
    from mosaique.operators import batch, jobs, similarity, timeline

    n = 2_000
    hot = F.when(F.col("id") % 10 > 0, F.lit(0)).otherwise(-1 - F.col("id"))
    frames = spark.range(n).select(hot.alias("clip_id"), F.col("id").alias("frame_idx"), F.lit(20).alias("duration_ms"))
    bounds = timeline.frame_bounds(frames)
    members = spark.range(n).select(hot.alias("group_key"), F.col("id").alias("image_id"), F.lit(90.0).alias("score_to_anchor"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.format_string("%05d", "id").alias("path"))
    ordered = similarity.order_members(members)
    errors = spark.range(n).select(hot.alias("signature"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * F.when(F.col("id") < 1000, 1).otherwise(100)).alias("ts"))
    shown = jobs.suppress_repeats(errors, ["signature"], "60 seconds")
    for found in (bounds, ordered, shown):
        assert shuffled_by(found) and all("_scan_" in line for line in shuffled_by(found)), shuffled_by(found)
    assert bounds.filter("clip_id = 0").agg(F.max("end_ms")).first()[0] == 20 * n * 9 // 10
    assert ordered.filter("group_key = 0").agg(F.max("member_no"), F.count_distinct("member_no")).first()[:] == (n * 9 // 10, n * 9 // 10)
    burst = shown.filter("signature = 0 and event_id = 1").first()
    assert burst["shown"] and burst["suppressed"] == 899 and shown.filter("signature = 0 and not shown").count() == 899

    plan = spark.range(300).select(F.lit("/out").alias("folder"), F.when(F.col("id") % 10 > 0, F.lit("a.png")).otherwise(F.format_string("b%d.png", "id")).alias("name"), F.col("id").alias("position"))
    taken = spark.createDataFrame([("/out", "a (3).png"), ("/out", "a (5).png")], "folder string, name string")
    names = [r["final_name"] for r in batch.collision_free_names(plan, taken).filter("name = 'a.png'").orderBy("position").collect()]
    assert names[:5] == ["a.png", "a (2).png", "a (4).png", "a (6).png", "a (7).png"] and len(set(names)) == 270


def test_repeats_of_a_null_signature(spark):
    from mosaique.operators.jobs import suppress_repeats

    rows = [(None, 1, 0), (None, 2, 5), ("a", 3, 0), (None, 4, 100)]
    df = spark.createDataFrame(rows, "k string, event_id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    found = {r["event_id"]: (r["shown"], r["suppressed"]) for r in suppress_repeats(df, ["k"], "60 seconds").collect()}
    assert found == {1: (True, 1), 2: (False, 1), 3: (True, 0), 4: (True, 0)}
