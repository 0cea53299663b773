"""Quadtree coverings against a test of every point with every region."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaique.operators import cover

SCHEMA = "region_id long, kind string, box struct<left:int,top:int,right:int,bottom:int>, points array<struct<x:int,y:int>>, image_id long"


def in_polygon(x, y, ring):
    if len(ring) < 3:
        return False
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        odd ^= ((ay > y) != (by > y)) and ((side > 0) == (by > ay))
    return odd


def holds(kind, box, ring, x, y):
    if kind == "polygon":
        return in_polygon(x, y, ring)
    left, top, right, bottom = box
    w, h = right - left, bottom - top
    if w <= 0 or h <= 0 or not (left <= x <= right and top <= y <= bottom):
        return False
    return kind == "rect" or ((2 * x - left - right) * h) ** 2 + ((2 * y - top - bottom) * w) ** 2 <= (w * h) ** 2


def made(seed, n, wide):
    rng = random.Random(seed)
    regions = []
    for k in range(n):
        x, y, w, h = rng.randrange(-wide, wide), rng.randrange(-wide, wide), rng.randrange(0, wide), rng.randrange(0, wide)
        ring = [(x + rng.randrange(w + 1), y + rng.randrange(h + 1)) for _ in range(rng.choice([0, 2, 3, 5, 9]))]
        regions.append((k, rng.choice(["rect", "ellipse", "polygon"]), (x, y, x + w, y + h), ring, k % 3))
    points = [(k, rng.randrange(-wide, 2 * wide), rng.randrange(-wide, 2 * wide), k % 3) for k in range(3000)]
    return regions, points


@pytest.mark.parametrize(("seed", "wide"), [(1, 20), (2, 300), (3, 5000)])
def test_every_point_with_every_region(spark, seed, wide):
    regions, points = made(seed, 25, wide)
    df = spark.createDataFrame(points, "id long, x int, y int, image_id long")
    found = cover.points_in_regions(df, spark.createDataFrame(regions, SCHEMA))
    assert found.columns == ["id", "x", "y", "image_id", "region_id"]
    want = sorted((p[0], r[0]) for p in points for r in regions if holds(*r[1:4], p[1], p[2]))
    assert sorted((r["id"], r["region_id"]) for r in found.collect()) == want and len(want) > 500
    same = cover.points_in_regions(df, spark.createDataFrame(regions, SCHEMA), on=["image_id"])
    assert sorted((r["id"], r["region_id"]) for r in same.collect()) == sorted((p, r) for p, r in want if p % 3 == regions[r][4])


def test_most_cells_of_a_large_region_need_no_test():
    for kind in ("rect", "ellipse", "polygon"):
        k, cx, cy, inside = cover._cells(kind, (3, 5, 4000, 3900), np.array([[3, 5], [4000, 5], [4000, 3900], [3, 3900]], float), 3)
        area = np.where(inside == 1, 4.0**k, 0).sum()
        assert len(k) < 600 and area > 0.85 * 3997 * 3895 * (np.pi / 4 if kind == "ellipse" else 1)


def test_one_region_over_all_points(spark):
    """All points in one region, most of them in one place: no partition of the join gets more than a few shares."""
    n = 40_000
    points = spark.range(n).select("id", F.when(F.col("id") % 10 > 0, F.lit(77)).otherwise(F.col("id") % 1000).cast("int").alias("x"), F.lit(50).alias("y"))
    region = spark.createDataFrame([(1, "rect", (0, 0, 2000, 100), [], 0)], SCHEMA)
    found = cover.points_in_regions(points, region)
    assert found.count() == n and found.select("id").distinct().count() == n
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and "SortMergeJoin" in plan
    placed = points.withColumn("_salt", F.floor(F.rand(1) * cover.HOT)).filter("x = 77").groupBy("_salt").count()
    assert placed.agg(F.max("count")).first()[0] < 3 * n / cover.HOT


def test_odd_rows(spark):
    points = spark.createDataFrame([(1, None, 2, 0), (2, 5, 5, 0), (2, 5, 5, 0)], "id long, x int, y int, image_id long")
    regions = spark.createDataFrame([(1, "rect", None, None, 0), (2, "polygon", None, None, 0), (3, "rect", (5, 5, 5, 9), [], 0), (4, "rect", (5, 5, 6, 6), None, None), (5, None, (0, 0, 9, 9), None, 0)], SCHEMA)
    assert sorted((r["id"], r["region_id"]) for r in cover.points_in_regions(points, regions).collect()) == [(2, 4), (2, 4), (2, 5), (2, 5)]
    assert cover.points_in_regions(points.limit(0), regions).collect() == [] and cover.points_in_regions(points, regions.limit(0)).collect() == []


def test_many_points_and_regions_in_one_place(spark):
    """Half of all points and of all regions are in one place: its rows are dealt to many shares of the last join."""
    n, m = 4_000, 600
    points = spark.range(n).select("id", *[F.when(F.col("id") % 2 > 0, F.lit(5)).otherwise(F.col("id") % 40).cast("int").alias(c) for c in "xy"])
    regions = spark.createDataFrame([(k, "rect", (5, 5, 6, 6) if k % 2 else (k % 40, k % 40, k % 40 + 2, k % 40 + 2), [], 0) for k in range(m)], SCHEMA)
    found = cover.points_in_regions(points, regions)
    place = [5 if k % 2 else k % 40 for k in range(n)]
    want = sum(1 for p in place for k in range(m) if (5 <= p <= 6 if k % 2 else k % 40 <= p <= k % 40 + 2))
    assert found.count() == found.distinct().count() == want
    salts = [k for k in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in k]
    assert len(salts) == 1 and "_salt" in salts[0] and "_side" not in salts[0]
