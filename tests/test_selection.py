"""Exact percentiles by refinement, and paths without dots."""

import posixpath
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaique.functions import scalars as S
from mosaique.operators import selection


@pytest.mark.parametrize("few", [0, 50, 10_000])
def test_percentiles_are_exact(spark, few):
    rng = random.Random(few)
    values = {
        1: [rng.gauss(0, 1) for _ in range(900)], 2: [rng.choice([1.5, 2.5, 2.5, 9.0]) for _ in range(300)], 3: [7.0], 4: [10.0 ** rng.randint(-200, 200) for _ in range(200)],
        None: [float(k * k) for k in range(101)],
    }
    df = spark.createDataFrame([(k, v) for k, own in values.items() for v in [*own, None]], "k int, v double")
    shares = {"low": 0.02, "mid": 0.5, "high": 0.92, "top": 1.0}
    found = {r["k"]: r for r in selection.percentiles(df, ["k"], "v", shares, few).collect()}
    assert set(found) == set(values)
    for k, own in values.items():
        for name, p in shares.items():
            assert found[k][name] == pytest.approx(np.percentile(own, 100 * p), rel=1e-12)


def test_infinite_values_and_no_rows(spark):
    rows = [(1, float(v)) for v in range(60)] + [(1, float("inf")), (1, float("-inf"))]
    df = spark.createDataFrame(rows, "k int, v double")
    found = selection.percentiles(df, ["k"], "v", {"a": 0.0, "b": 0.5, "c": 1.0}, 0).first()
    assert (found["a"], found["b"], found["c"]) == (float("-inf"), 29.5, float("inf"))
    assert selection.percentiles(df.limit(0), ["k"], "v", {"a": 0.5}, 0).collect() == []


def test_paths_without_dots(spark):
    rng = random.Random(4)
    paths = ["/".join(rng.choice(["a", "b.png", "..", ".", "", "...", ".x"]) for _ in range(rng.randint(1, 8))) for _ in range(400)] + ["/lib/a/../b.png", "/lib/b.png", "/..", "..", "", "a/..", "//x//y/"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.normal_path(F.col("p")).alias("n"))
    for r in df.collect():
        want = posixpath.normpath(r["p"])
        assert r["n"] == ("/" + want.lstrip("/") if r["p"].startswith("/") else want), r["p"]
    schemes = spark.createDataFrame([("file:///a/../b/./c.png",), ("s3://bucket/../x//y",), ("s3://bucket",), (None,)], "p string").select(S.normal_path(F.col("p"))).collect()
    assert [r[0] for r in schemes] == ["file:///b/c.png", "s3://bucket/x/y", "s3://bucket/", None]


def test_best_by_rules_keeps_what_each_rule_keeps(spark):
    """One aggregate for all rules: ties keep the first member, nulls and NaN stand where sorting has them."""
    from mosaique.operators import similarity

    rnd, odd = random.Random(3), [None, float("nan"), 1.5, 2.5]
    rows = [(k % 7, k, k // 7, rnd.choice([10, 20, None]), 4, rnd.choice([5, 6, None]), rnd.choice(odd), rnd.choice(odd), "x" * rnd.randint(1, 3)) for k in range(84)]
    table = spark.createDataFrame(rows, "group_key long, image_id long, member_no long, width int, height int, size_bytes long, sharpness double, mtime double, path string")
    want = [(rule, r.image_id) for rule in similarity.keep_rules() for r in similarity.keep_best(table, rule).filter("best").collect()]
    assert sorted(tuple(r) for r in similarity.best_by_rules(table).collect()) == sorted(want) and len(want) == 49


def test_keep_best_query_orders_members_once(spark, sf_dir, monkeypatch):
    """Groups and members are numbered by two scans; the seven rules add none."""
    from mosaique.operators import scan, similarity
    from mosaique.queries import similar

    calls = []
    counted = lambda *a, **k: calls.append(1) or scan.scan(*a, **k)
    monkeypatch.setattr(similarity, "scan", counted)
    assert {r.rule for r in similar.keep_best(spark, sf_dir).collect()} == set(similarity.keep_rules())
    assert len(calls) == 1
