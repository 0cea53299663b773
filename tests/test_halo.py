"""Array blocks with borders against plain loops over whole pictures."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaique.operators import halo, raster as R


def picture(seed, width, height, holes=0.0):
    rng = np.random.default_rng(seed)
    return {(x, y): int(rng.integers(0, 256)) for y in range(height) for x in range(width) if rng.random() >= holes}


def table(spark, pictures):
    return spark.createDataFrame([(k, x, y, v) for k, p in pictures.items() for (x, y), v in p.items()], "image_id long, x int, y int, luma int")


def plain_stencil(p, kernel, clamp):
    mx, my = max(x for x, _ in p), max(y for _, y in p)
    out = {}
    for x, y in p:
        at = [(x + dx, y + dy) for dx, dy, _ in kernel]
        if clamp:
            at = [(min(max(a, 0), mx), min(max(b, 0), my)) for a, b in at]
        if all(q in p for q in at):
            out[x, y] = sum(w * p[q] for q, (_, _, w) in zip(at, kernel, strict=True))
    return out


@pytest.mark.parametrize("clamp", [False, True])
@pytest.mark.parametrize("holes", [0.0, 0.02, 0.97])
def test_stencils_over_several_blocks(spark, monkeypatch, clamp, holes):
    monkeypatch.setattr(halo, "SIDE", 16)
    monkeypatch.setattr(halo.on_blocks, "__defaults__", (False, 16))
    pictures = {1: picture(1, 50, 37, holes), 2: picture(2, 16, 16, holes), 3: picture(3, 1, 40), 4: {(0, 0): 7}}
    kernel = [(0, 0, 4), (-3, 0, -1), (3, 1, -1), (0, -2, -2)] if holes < 0.5 else [(0, 0, 4)] + [(3, 3, 1)] * clamp
    found = R.stencils(table(spark, pictures), "luma", {"a": kernel, "b": [(0, 0, 1)]}, clamp)
    assert dict(found.dtypes)["a"] == "bigint"
    got = {(r["image_id"], r["x"], r["y"]): (r["a"], r["b"]) for r in found.collect()}
    want = {(k, *at): (v, p[at]) for k, p in pictures.items() for at, v in plain_stencil(p, kernel, clamp).items()}
    assert got == want


@pytest.mark.parametrize("radius", [0.4, 3.0, 30.0])
def test_gaussian_of_pictures_of_other_sizes(spark, radius):
    """The last radius reaches further than a block would be wide."""
    pictures = {1: picture(1, 70, 9), 2: picture(2, 5, 66)}
    reach = math.ceil(3 * radius)
    weights = np.exp(-np.arange(-reach, reach + 1.0) ** 2 / (2 * radius**2))
    weights /= weights.sum()
    got = {(r["image_id"], r["x"], r["y"]): r["luma"] for r in R.gaussian(table(spark, pictures), "luma", radius).collect()}
    assert len(got) == sum(map(len, pictures.values()))
    for k, p in pictures.items():
        whole = np.zeros((max(y for _, y in p) + 1, max(x for x, _ in p) + 1))
        for (x, y), v in p.items():
            whole[y, x] = v
        wide = np.pad(whole, reach, mode="edge")
        blurred = sum(w * v * wide[i : i + whole.shape[0], j : j + whole.shape[1]] for i, w in enumerate(weights) for j, v in enumerate(weights))
        for (x, y) in p:
            assert got[k, x, y] == math.floor(round(blurred[y, x], 6))


def test_rows_shuffled_do_not_follow_the_radius(spark):
    pixels = table(spark, {1: picture(1, 8, 8)})
    bare = lambda df: re.sub(r"#\d+L?|plan_id=\d+|apply\w*\(|\[id=[^\]]*\]|radius", "", df._jdf.queryExecution().executedPlan().toString())
    plans = [bare(R.gaussian(pixels, "luma", radius)) for radius in (0.5, 20.0)]
    assert "Generate" not in plans[0] and "explode" not in plans[0]
    count = lambda plan: (plan.count("Exchange"), plan.count("MapInArrow"), plan.count("Join"))
    assert count(plans[0]) == count(plans[1])
    # One row a pixel into the blocks; nine rows a block between them.
    assert plans[0].count("collect_list") > 0


def test_displaced_pixels_stay_in_their_own_picture(spark):
    pictures = {1: picture(1, 24, 8), 2: picture(2, 16, 8)}
    moved = R.displace(table(spark, pictures), "luma", F.lit(-3), F.lit(2), "to").collect()
    assert len(moved) == 24 * 8 + 16 * 8
    for r in moved:
        p = pictures[r["image_id"]]
        mx = max(x for x, _ in p)
        assert r["to"] == p[min(mx, r["x"] + 3), max(0, r["y"] - 2)]
    holed = dict(pictures[2])
    del holed[9, 3]
    kept = R.displace(table(spark, {2: holed}), "luma", F.lit(1), F.lit(0), "to").collect()
    assert len(kept) == len(holed) and [r["x"] for r in kept if r["to"] is None] == [10]


def test_no_pixels(spark):
    assert R.gaussian(table(spark, {1: {(0, 0): 1}}).limit(0), "luma", 2.0).collect() == []
