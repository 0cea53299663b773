"""The stride of an edit plan against a search over all strides."""

import math
import random

from mosaique.operators.timeline import plan_edit_reduction


def searched(n, ms, width, height, budget):
    area = width * height
    if max(1, n * area) <= budget:
        return 1
    s = min(max(1, math.ceil(max(1, n * area) / budget)), max(1, math.floor(n * 1000 / max(1, ms) / 10.0)))
    half = math.ceil(n / 2)
    fit = lambda s: min(1.0, math.sqrt(budget / max(1, area * max(2, math.ceil(n / s)))))
    scale = fit(s)
    if scale < 0.5 and n > 2:
        s = min(max(s, math.ceil(n / max(2, math.floor(budget / max(1, math.floor(area * 0.25)))))), max(1, half))
        scale = fit(s)
    scale = max(0.25, scale)
    top = max(s, half)
    return max(1, next((k for k in range(s, top + 1) if area * max(2, math.ceil(n / k)) * scale * scale <= budget), top))


def test_strides(spark):
    rng = random.Random(2)
    clips = [(rng.randint(1, 4000), rng.randint(0, 200_000), rng.randint(1, 900), rng.randint(1, 900)) for _ in range(400)] + [(12, 1026, 40, 30), (1, 0, 5000, 5000), (7, 100, 0, 10)]
    for budget in (4_000, 250_000, 40_000_000):
        df = spark.createDataFrame(clips, "n_frames long, total_ms long, width int, height int")
        for r in plan_edit_reduction(df, budget).collect():
            assert r["stride"] == searched(r["n_frames"], r["total_ms"], r["width"], r["height"], budget), (r, budget)
