"""Exact percentiles per key by refinement of histograms: no key's values meet in one buffer.

A key with few distinct values has them counted (map-side combined) and hands at most FEW counts to one aggregate. Any other
key is refined: per wanted rank a range of values is cut into BINS equal bins, counted over all partitions, and
the bin that holds the rank is the next range, until all values in it are equal. A round reads the table of counts once and
keeps BINS counts a rank; each cuts the range BINS times smaller.

Percentiles are interpolated between the two nearest ranks. Cases: null values don't count, keys without values have
no row, null keys are keys; NaN counts as larger than all numbers, and infinite values have bins of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mosaique.session import materialize

BINS, FEW = 256, 10_000


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], few: int = FEW) -> DataFrame:
    """keys and one double per name in `shares` (name -> share from 0 to 1)."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    counted = materialize(counted, "counted")
    sizes = materialize(counted.groupBy(*keys).agg(F.count("*").alias("_kinds"), F.sum("_n").alias("_all"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "sizes")
    exact = [F.percentile("_v", F.lit(p), F.col("_n")).alias(name) for name, p in shares.items()]
    many = sizes.filter(F.col("_kinds") > few)
    if many.isEmpty():
        return counted.groupBy(*keys).agg(*exact)
    renamed = many.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_all", "_low", "_high")
    met = _same(keys)
    small = counted.join(renamed.hint("merge"), met, "left_anti").groupBy(*keys).agg(*exact)
    large = materialize(counted.join(renamed.select(*[f"_of_{k}" for k in keys]).hint("merge"), met, "left_semi"), "large")
    return small.unionByName(_refined(large, renamed, keys, shares))


def _same(keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return out


def _refined(counted: DataFrame, sizes: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """The same for keys with many values, from their counts and their sizes (_of_ keys, _all, _low, _high)."""
    names = [f"_of_{k}" for k in keys]
    at = lambda p: F.lit(p) * (F.col("_all") - 1)
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(half).alias("half"), (F.floor(at(p)) if half == 0 else F.ceil(at(p))).cast("long").alias("rank")) for name, p in shares.items() for half in (0, 1)])
    todo = materialize(sizes.select(*names, F.explode(ranks).alias("r"), "_low", "_high").select(*names, "r.*", "_low", "_high"), "ranks")
    found = None
    by = [*names, "name", "half"]
    while True:
        done = todo.filter("_low = _high").select(*by, F.col("_low").alias("v"))
        found = done if found is None else found.unionByName(done)
        todo = materialize(todo.filter("_low <> _high"), "open")
        if todo.isEmpty():
            break
        width = (F.col("_high") - F.col("_low")) / BINS
        # An infinite end, or a range too narrow to be cut, leaves the ends as bins of their own.
        inner = F.when((width > 0) & (width < float("inf")), F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_low")) / width)).cast("int")).otherwise(1)
        bin_ = F.when(F.col("_v") == F.col("_low"), -1).when(F.col("_v") == F.col("_high"), BINS).otherwise(inner)
        rows = counted.join(todo.hint("merge"), _same(keys)).filter((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        bins = rows.groupBy(*by, "rank", bin_.alias("bin")).agg(F.sum("_n").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        # At most BINS + 2 bins a rank.
        bins = bins.groupBy(*by, "rank").agg(F.sort_array(F.collect_list(F.struct("bin", "n", "low", "high"))).alias("bins"))
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
        step = lambda s, b: F.struct(
            F.when(s["low"].isNull() & (s["before"] + b["n"] <= F.col("rank")), s["before"] + b["n"]).otherwise(s["before"]).alias("before"),
            F.when(s["low"].isNull() & (s["before"] + b["n"] > F.col("rank")), b["low"]).otherwise(s["low"]).alias("low"),
            F.when(s["low"].isNull() & (s["before"] + b["n"] > F.col("rank")), b["high"]).otherwise(s["high"]).alias("high"))
        hit = bins.withColumn("s", F.aggregate("bins", start, step))
        todo = materialize(hit.select(*by, (F.col("rank") - F.col("s.before")).alias("rank"), F.col("s.low").alias("_low"), F.col("s.high").alias("_high")), "open")
    sides = materialize(found, "found").groupBy(*names, "name").agg(*[F.max(F.when(F.col("half") == h, F.col("v"))).alias(f"v{h}") for h in (0, 1)])
    whole = sides.join(sizes.select(*[F.col(n).alias(f"_s{n}") for n in names], "_all").hint("merge"), _pairs(names))
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("name")] * (F.col("_all") - 1)
    value = F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise((F.ceil(share) - share) * F.col("v0") + (share - F.floor(share)) * F.col("v1"))
    return whole.groupBy(*names).agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in shares]).withColumnsRenamed({f"_of_{k}": k for k in keys})


def _pairs(names: list[str]):
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"_s{n}"))
    return out
