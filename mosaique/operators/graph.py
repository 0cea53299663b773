"""Connected components as repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mosaique.session import materialize

#: So many edges (of two integers) are few enough for one task; more are contracted first.
TASK_EDGES = 100_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of at most TASK_EDGES edges: vertex and smallest vertex."""
    up: dict = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.types[0]
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(up.setdefault(u, u)), find(up.setdefault(v, v))
            up[max(a, b)] = min(a, b)
    every = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(every, kind), pa.array([find(x) for x in every], kind)], ["vertex", "hook"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """vertex and component (the smallest vertex it reaches) for every vertex of an undirected edge table.

    Each round hooks every vertex to the neighbour (or itself) that comes first in a hashed order, replaces
    both ends of every edge by their hooks and drops loops and repeats. The order is drawn anew each round, so
    that paths and stars alike shrink by a constant factor; the rounds grow with the logarithm of the input.
    Once at most TASK_EDGES edges are left, one task joins them. Each round is written to the shared folder. Null ends and self loops are ignored, except that a self loop
    makes its vertex known.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    pairs = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), "edges")
    kind = pairs.schema["u"].dataType.simpleString()

    def finish(edges: DataFrame) -> DataFrame:
        return materialize(edges.select("u", "v").coalesce(1).mapInArrow(_finish, f"vertex {kind}, hook {kind}"), "hooks")

    if pairs.count() <= TASK_EDGES:
        return finish(pairs).select("vertex", F.col("hook").alias("component"))
    vertices = pairs.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    hooks: list[DataFrame] = []
    left = materialize(pairs.filter("u <> v").distinct(), "edges")
    while (n := left.count()) > 0:
        if n <= TASK_EDGES:
            hooks.append(finish(left))
            break
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.lit(len(hooks)), F.col(c)).alias("h"), F.col(c).alias("x"))
        first = both.groupBy(F.col("u").alias("vertex")).agg(F.min(order("v")).alias("near"))
        first = first.select("vertex", F.least("near", order("vertex"))["x"].alias("hook"))
        hook = materialize(first, "hooks")
        hooks.append(hook)
        moved = left.join(hook.select(F.col("vertex").alias("u"), F.col("hook").alias("hu")).hint("merge"), "u")
        moved = moved.join(hook.select(F.col("vertex").alias("v"), F.col("hook").alias("hv")).hint("merge"), "v")
        moved = moved.filter("hu <> hv").select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v")).distinct()
        left = materialize(moved, "edges")
    found = vertices.withColumn("root", F.col("vertex"))
    for hook in hooks:
        step = hook.select(F.col("vertex").alias("root"), F.col("hook")).hint("merge")
        found = found.join(step, "root", "left").select("vertex", F.coalesce("hook", "root").alias("root"))
    if hooks:
        found = materialize(found, "roots")
    # Written first, so that the join below reads plain shuffles, which Spark can split where one component is large.
    least = materialize(found.groupBy("root").agg(F.min("vertex").alias("component")), "least")
    few = least.count() <= TASK_EDGES
    return found.join(least.hint("broadcast" if few else "merge"), "root").select("vertex", "component")
