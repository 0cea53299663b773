"""The metric join against all pairs: nothing is lost, and pivots rule pairs out where the data have clusters."""

import random

import numpy as np
import pytest

from mosaique.operators import metric, similarity as sim

SCHEMA = "image_id long, a_hash long, d_hash long, color_hist array<double>"


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def clustered(seed, centres, each, flips):
    """Rasters around centres that are far from each other."""
    rng = random.Random(seed)
    rows = []
    for c in range(centres):
        a, d = rng.getrandbits(64), rng.getrandbits(56)
        hist = [rng.random() for _ in range(8)]
        for _ in range(each):
            x, y = a, d
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
                y ^= 1 << rng.randrange(56)
            h = [v + rng.random() / 10 for v in hist]
            rows.append((len(rows), signed(x), y, [v / sum(h) for v in h]))
    return rows


def pairs(df):
    return sorted(tuple(r) for r in df.select("src", "dst", "score").collect())


@pytest.mark.parametrize("threshold", [60, 72, 84, 95])
def test_no_pair_is_lost(spark, monkeypatch, threshold):
    monkeypatch.setattr(metric, "TILE_ROWS", 40)
    fp = spark.createDataFrame(clustered(threshold, 12, 20, 12), SCHEMA)
    want = pairs(sim.similar_pairs_exact(fp, threshold))
    assert want and pairs(sim.similar_pairs_metric(fp, threshold)) == want
    assert pairs(sim.similar_pairs_metric(fp, threshold, pivots=40)) == want
    assert pairs(sim.candidate_pairs_banded(fp, threshold)) == want


def test_pivots_rule_pairs_out(spark):
    """Clusters of flipped copies at 84: the cells leave a small share of all pairs."""
    fp = spark.createDataFrame(clustered(7, 30, 20, 4), SCHEMA)
    met = metric.candidate_pairs(fp, 84, "image_id", tuple(sim.ARRAYS), 30).count()
    assert met < 0.5 * 600 * 599 / 2
    assert pairs(sim.similar_pairs_metric(fp, 84, pivots=30)) == pairs(sim.similar_pairs_exact(fp, 84))


def test_a_third_are_copies(spark, monkeypatch):
    monkeypatch.setattr(metric, "TILE_ROWS", 30)
    rows = clustered(8, 20, 5, 8)
    rows += [(1000 + k, *rows[0][1:]) for k in range(50)]
    fp = spark.createDataFrame(rows, SCHEMA)
    assert pairs(sim.similar_pairs_metric(fp, 80)) == pairs(sim.similar_pairs_exact(fp, 80))


def test_odd_tables(spark):
    fp = spark.createDataFrame(clustered(9, 1, 1, 0), SCHEMA)
    assert sim.similar_pairs_metric(fp, 72).collect() == [] and sim.similar_pairs_metric(fp.limit(0), 72).collect() == []
    two = fp.unionByName(fp.withColumn("image_id", fp["image_id"] - 5))
    assert pairs(sim.similar_pairs_metric(two, 72)) == [(-5, 0, 100.0)]
    holed = two.unionByName(spark.createDataFrame([(9, None, 1, None)], SCHEMA))
    assert pairs(sim.similar_pairs_metric(holed, 72)) == [(-5, 0, 100.0)]


def test_distance_is_what_the_score_lacks(spark):
    rows = clustered(10, 6, 3, 20)
    fp = spark.createDataFrame(rows, SCHEMA)
    at = metric._Points(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
    far = at.distances(at, tuple(sim.ARRAYS))
    for src, dst, score in pairs(sim.similar_pairs_exact(fp, 0)):
        assert abs(100 - far[src, dst] - score) <= metric.ROUNDED


def test_bands_count_what_they_write():
    """Few rows want few bands, many rows may want more; thresholds that select nothing have none."""
    cost = lambda plan: sum(b.count * (sim._ball(-(-b.bits // b.count), b.left) + sim._ball(-(-b.bits // b.count), b.right)) for b in plan)
    assert cost(sim.band_plan(95, rows=100_000)) <= 16 < cost(sim.band_plan(90, rows=10_000_000))
    assert sim.band_plan(72, rows=10_000_000) == [] and sim.band_plan(100, rows=10)


def test_pairs_are_rows_only_when_close(spark, monkeypatch):
    """Tiles are compared as arrays: neither join has a row for every pair that meets, and both find what plain Python does."""
    monkeypatch.setattr(metric, "TILE_ROWS", 30)
    monkeypatch.setattr(metric, "BLOCK_PAIRS", 50)
    rows = clustered(11, 10, 12, 10)
    fp = spark.createDataFrame(rows, SCHEMA)
    want = []
    for m, (i, a, d, h) in enumerate(rows):
        for j, b, e, g in rows[m + 1 :]:
            ha, hd, l1 = ((a ^ b) & (1 << 64) - 1).bit_count(), (d ^ e).bit_count(), sum(abs(x - y) for x, y in zip(h, g))
            if 2128 * ha + 2688 * hd <= 3584 * 28 and round(max(0, (0.38 * (1 - ha / 64) + 0.42 * (1 - hd / 56) + 0.20 * max(0, min(1, 1 - l1 / 2))) * 100), 2) >= 72:
                want.append((i, j))
    assert len(want) > 100
    for found in (sim.similar_pairs_exact(fp, 72), sim.similar_pairs_exact(fp, 72, blocks=7), sim.similar_pairs_metric(fp, 72)):
        assert [p[:2] for p in pairs(found)] == sorted(want)
    met = metric.all_pairs(fp, 72, "image_id", tuple(sim.ARRAYS)).count()
    assert met < 2 * len(want) < 120 * 119 / 2
