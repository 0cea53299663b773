"""Rows chosen by place: the right ones, in slices or not, whatever the columns are called, and without a shuffle of texts."""

import re

import pytest
from pyspark.sql import functions as F

from mosaique.llm import exact_dedup, near_dedup, places
from mosaique.session import materialize


@pytest.fixture(scope="module")
def table(spark):
    """Several files, one of them with more rows than a bitmap."""
    rows = spark.range(0, 100_000, 1, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("x").alias("_file"), F.lit(1).alias("a.b"))
    return materialize(rows, "rows")


@pytest.mark.parametrize("slice_", [8_192, 1])
@pytest.mark.parametrize("gone", ["doc_id % 7 = 3", "doc_id between 32760 and 32800", "doc_id < 40000", "true", "false"])
def test_rows_at_places(table, monkeypatch, slice_, gone):
    monkeypatch.setattr(places, "SLICE", slice_)
    at = places.with_places(table).withColumnRenamed("_c0", "doc_id").filter(gone).select("_file", "_row")
    for inside in (True, False):
        rows = places.at_places(table, at, inside)
        assert rows.columns == ["_c0", "_c1", "_c2", "_c3", "_file", "_row"]
        want = table.filter(gone if inside else f"not ({gone})").select("doc_id")
        found = rows.select("_c0")
        assert found.count() == want.count() and found.exceptAll(want).isEmpty()


@pytest.mark.parametrize("slice_", [8_192, 1])
def test_drops_are_the_same_in_slices(spark, monkeypatch, slice_):
    monkeypatch.setattr(places, "SLICE", slice_)
    base = [f"Some text number {k} with enough words of its own {k * 7} to be told from others {k * 13} by any rule {k * 31} at all" for k in range(40)]
    rows = [(k, base[k % 40] if k < 80 else base[k - 80] + " and", "k", k) for k in range(120)] + [(5, base[5], "k", 200), (None, None, None, None)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, _metadata string, _row long").repartition(5), "docs")
    left = exact_dedup.drop_copies(docs, as_read=True)
    assert left.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in left.collect() if r.doc_id is not None)
    assert [i for _, i in ids] == [*range(40), *range(80, 120)] and left.filter("doc_id is null").count() == 1
    left = near_dedup.drop_near_copies(docs, as_read=True)
    assert left.columns == docs.columns
    found = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert found == sorted([*range(40), 5])  # both rows of an id that stays


def test_of_rows_with_equal_ids_and_lengths_the_first_stays(spark):
    docs = materialize(spark.createDataFrame([(1, "a  b", "first"), (1, "a\tb ", "second"), (1, "a b", "third")], "doc_id long, text string, mark string").coalesce(1), "docs")
    assert [r.mark for r in exact_dedup.drop_copies(docs, as_read=True).collect()] == ["first"]


def test_texts_are_not_shuffled(spark, sf_dir):
    """Neither drop has an exchange of anything but broadcast bitmaps above the scan of the texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for left in (exact_dedup.drop_copies(docs, as_read=True), near_dedup.drop_near_copies(docs, as_read=True)):
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and not re.search(r"(?<!Broadcast)Exchange |SortMergeJoin|Sort ", plan)
