"""Exact top-k search against all inner products."""

import math
import random

import numpy as np
import pytest

from mosaique.llm import exact_search

SCHEMA = "vec_id long, embedding array<float>, rank int"


def plain(rows, k=5, every=50):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    by_id = {}
    for i, v in rows:
        by_id[i] = min(by_id.get(i, v), v)
    out = []
    for q, a in by_id.items():
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in by_id.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_table_against_all_products(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()]
    assert found(exact_search.search(table)) == plain(rows)
    # Small blocks: several units, several blocks in each.
    assert found(exact_search.search(table, k=3, every=7, block=64 * 30, query_block=4 * 64 * 20)) == plain(rows, 3, 7)


def test_copies_ties_and_close_vectors(spark):
    """A third of all rows is one vector; others differ from it in one component; more rounds than one are needed."""
    rng = random.Random(5)
    hot = [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(k, hot) for k in range(200)]
    rows += [(200 + k, [x + rng.choice([0, 1 / 256]) for x in hot]) for k in range(300)]
    rows += [(500 + k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(100)]
    table = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    assert found(exact_search.search(table, every=20, block=8 * 50)) == plain(rows, every=20)
    vectors = exact_search.integer_vectors(table)
    assert found(exact_search.top_k(vectors.filter("vec_id % 20 = 0"), vectors, first=1)) == plain(rows, every=20)


def test_a_component_far_off_loses_nothing(spark):
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 0.1) for _ in range(6)]) for k in range(150)]
    rows[3] = (3, [9000.0, -9000.0, 0.0, 0.0, 0.0, 1.0])
    table = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    assert found(exact_search.search(table, every=10)) == plain(rows, every=10)


@pytest.mark.parametrize("k", [1, 5])
def test_odd_rows(spark, k):
    rows = [(0, [0.5, 0.25]), (50, [0.5, -0.25]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, []), (6, [1.0]), (7, [0.1, 0.2, 0.3]), (7, [0.1, 0.2, 0.1]), (7, [0.1, 0.2, 0.3]), (100, [0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    assert found(exact_search.search(table, k)) == plain(rows, k)
    assert exact_search.search(table.limit(0), k).collect() == []
    assert found(exact_search.search(table.filter("vec_id in (0, 50)"), k)) == plain(rows[:2], k)
    # The only vector has no other row.
    assert exact_search.search(table.filter("vec_id = 0"), k).collect() == []


def test_scores_beyond_64_bits_take_no_part(spark):
    rows = [(0, [1.0, 1.0]), (1, [3.0e38, 1.0]), (2, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    assert found(exact_search.search(table)) == plain([rows[0], rows[2]])
