"""Segmented scan: row numbers, running sums and last values per key, without a window over a whole key.

A window per key puts all rows of a key into one task. Here the rows are dealt out by ranges of (key, order), so
that a key with most of the rows lies over many partitions, and

1. each partition numbers and sums its own rows of a key (a window over partition and key, which never holds more
   than a partition),
2. of each partition one row is kept: its first and its last key, and the count, sums and last values of the last key,
3. what the last key of a partition holds up to there is carried into the next partition, if that begins with the
   same key. These are as many rows as there are partitions; they are broadcast.

Cases: nulls are keys and order values like others (they equal each other, and come first in ascending order);
rows that tie in the whole order are told apart by where they are stored, in an arbitrary but fixed order; an empty
table gives an empty table; columns of the table keep their names and places.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from mosaique.session import materialize

_PART, _KEY, _POS, _AT = "_scan_part", "_scan_key", "_scan_pos", "_scan_at"


def _named(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def scan(
    df: DataFrame,
    keys: Sequence[str | Column],
    order: Sequence[str | Column],
    number: str | None = None,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """`df` with more columns, over the rows of each key in the order given.

    `number`: the row's place, from 1. `sums`: name -> sum of an expression over the rows up to this one, without nulls
    (0 before the first). `lasts`: name -> the value of an expression, not null, in the nearest row before this one.
    No keys: one scan over the whole table.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = {f"_scan_sum{k}": F.coalesce(e, F.lit(0)) for k, e in enumerate(sums.values())}
    value |= {f"_scan_last{k}": e for k, e in enumerate(lasts.values())}
    key = F.struct(*_named(keys)) if keys else F.struct(F.lit(0))
    own = [F.col(_KEY), *_named(order), F.col("_scan_tie")]
    table = df.withColumns({"_scan_tie": F.monotonically_increasing_id(), _KEY: key, **value})
    dealt = table.repartitionByRange(n, *own).sortWithinPartitions(*own)
    dealt = dealt.withColumns({_PART: F.spark_partition_id(), _POS: F.monotonically_increasing_id()}).drop("_scan_tie")
    dealt = materialize(dealt, "scan")

    within = Window.partitionBy(_PART, _KEY).orderBy(_POS)
    upto, before = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"{_AT}_n": F.row_number().over(within).cast("long")} if number else {}
    local |= {f"{_AT}_sum{k}": F.sum(f"_scan_sum{k}").over(upto) for k in range(len(sums))}
    local |= {f"{_AT}_last{k}": F.last(f"_scan_last{k}", ignorenulls=True).over(before) for k in range(len(lasts))}
    joined = dealt.withColumns(local).join(F.broadcast(_carried(dealt, len(sums), len(lasts))), [_PART], "left")
    follows = F.col(_KEY).eqNullSafe(F.col("_scan_lo"))
    out = {}
    if number:
        out[number] = F.col(f"{_AT}_n") + F.coalesce(F.when(follows, F.col("_scan_c")), F.lit(0))
    for k, name in enumerate(sums):
        out[name] = F.col(f"{_AT}_sum{k}") + F.coalesce(F.when(follows, F.col(f"_scan_c_sum{k}")), F.lit(0))
    for k, name in enumerate(lasts):
        out[name] = F.coalesce(f"{_AT}_last{k}", F.when(follows, F.col(f"_scan_c_last{k}")))
    return joined.select(*[joined[f"`{c}`"] for c in df.columns if c not in out], *[e.alias(c) for c, e in out.items()])


def _carried(dealt: DataFrame, n_sums: int, n_lasts: int) -> DataFrame:
    """Per partition what its first key holds in the partitions before it: one row a partition."""
    held = [F.count("*").alias("_scan_c"), *[F.sum(f"_scan_sum{k}").alias(f"_scan_c_sum{k}") for k in range(n_sums)]]
    held += [F.max_by(f"_scan_last{k}", F.when(F.col(f"_scan_last{k}").isNotNull(), F.col(_POS))).alias(f"_scan_c_last{k}") for k in range(n_lasts)]
    per_key = dealt.groupBy(_PART, _KEY).agg(*held)
    names = [c for c in per_key.columns if c.startswith("_scan_c")]
    # A partition's keys are in order, so that only its last one can go on in the next.
    edges = per_key.groupBy(_PART).agg(F.min(_KEY).alias("_scan_lo"), F.max(_KEY).alias("_scan_hi"), F.max_by(F.struct(*names), _KEY).alias("_scan_x"))
    run = Window.partitionBy("_scan_hi").orderBy(_PART).rowsBetween(Window.unboundedPreceding, 0)
    summed = lambda c: F.last(f"_scan_x.{c}", ignorenulls=True).over(run) if "_last" in c else F.sum(f"_scan_x.{c}").over(run)
    upto = edges.select(_PART, "_scan_lo", "_scan_hi", *[summed(c).alias(c) for c in names])
    every = Window.orderBy(_PART)
    same = F.lag("_scan_hi").over(every).eqNullSafe(F.col("_scan_lo"))
    return upto.select(_PART, "_scan_lo", *[F.when(same, F.lag(c).over(every)).alias(c) for c in names])


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """`df` with its place in one order over the whole table, from 1."""
    return scan(df, [], order, number=name)
