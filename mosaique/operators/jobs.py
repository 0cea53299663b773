"""Job events, errors, recent items and releases."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DataType

from mosaique.functions import scalars as S
from mosaique.operators.scan import scan


def job_history(jobs: DataFrame, n: int = 200) -> DataFrame:
    """The newest n jobs."""
    return jobs.orderBy(F.desc("started_at"), F.desc("job_id")).limit(n)


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that run and have no end."""
    return jobs.filter((F.col("status") == "Running") & F.col("finished_at").isNull())


def first_errors(errors: DataFrame, n: int) -> DataFrame:
    """The first n errors in order of position."""
    return errors.orderBy("position").limit(n)


def newest_release(releases: DataFrame, current: str, prereleases: bool = True) -> DataFrame:
    """At most one row: the highest version above the current one, without drafts."""
    rows = releases.withColumn("_key", S.version_key(F.col("tag"))).filter("not draft and _key is not null")
    rows = rows if prereleases else rows.filter("not prerelease")
    rows = rows.filter(F.col("_key") > S.version_key(F.lit(current)))
    return rows.orderBy(F.desc("_key"), "release_id").limit(1).drop("_key")


def pick_asset(assets: Column, product: str) -> Column:
    """The name of the installer to offer: x64 first, then anything but arm64, then by name."""
    low = lambda a: F.lower(a["name"])
    fit = F.filter(assets, lambda a: low(a).endswith(".exe") & low(a).contains(product) & low(a).contains("setup"))
    keyed = F.transform(fit, lambda a: F.struct((~low(a).contains("x64")).alias("x"), low(a).contains("arm64").alias("y"), low(a).alias("z"), a["name"].alias("name")))
    return F.array_min(keyed)["name"]


def recent_items(events: DataFrame, limit: int, keys: list[str], path: str = "path", ts: str = "ts") -> DataFrame:
    """The most recent items per key, one row per path: the newest times are taken before anything is ranked."""
    newest = events.groupBy(*keys, path).agg(F.max(ts).alias(ts))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts), path))
    return newest.withColumn("rank", rank).filter(F.col("rank") <= limit)


def suppress_repeats(errors: DataFrame, keys: list[str], gap: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Errors with `shown`: nothing of the same signature within the gap before; and `suppressed` after each shown one."""
    rows = scan(errors, keys, [ts, order], lasts={"_before": F.col(ts)})
    shown = F.col("_before").isNull() | (F.col(ts) - F.expr(f"interval {gap}") >= F.col("_before"))
    rows = scan(rows.withColumn("shown", shown).drop("_before"), keys, [ts, order], sums={"_burst": F.col("shown").cast("int")})
    # A burst may be nearly all rows: it is counted with partial sums, and joined by plain shuffles that Spark can split.
    by = [*keys, "_burst"]
    sizes = rows.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg((F.count("*") - 1).alias("suppressed"))
    met = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return rows.join(sizes.hint("merge"), met).select(*errors.columns, "shown", "suppressed")


def read_json_records(df: DataFrame, column: str, schema: str | DataType) -> tuple[DataFrame, DataFrame]:
    """(rows with `record`, quarantined rows): only JSON objects of the schema are records."""
    parsed = df.withColumn("record", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    text = F.ltrim(F.col(column))
    good = F.coalesce(text.startswith("{") & F.try_parse_json(column).isNotNull(), F.lit(False)) & F.col("record").isNotNull()
    return parsed.filter(good), parsed.filter(~good).drop("record")


def only_strings(values: Column) -> Column:
    """The strings of an array of variants, the rest dropped."""
    return F.filter(F.transform(values, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda s: s.isNotNull())


def read_release_feed(df: DataFrame, column: str) -> DataFrame:
    """Rows of release_id-like columns with one asset each, from nested JSON; releases without assets keep one row."""
    schema = "tag_name string, name string, draft boolean, prerelease boolean, assets array<struct<name: string, browser_download_url: string, size: long, digest: string>>"
    parsed = df.withColumn("r", F.from_json(column, schema))
    flat = parsed.select(*[c for c in df.columns if c != column], F.coalesce("r.tag_name", "r.name").alias("tag"), "r.draft", "r.prerelease", F.explode_outer("r.assets").alias("asset"))
    return flat.select(*[c for c in flat.columns if c != "asset"], F.col("asset.name").alias("asset_name"), F.greatest(F.lit(0).cast("long"), F.coalesce("asset.size", F.lit(0))).alias("asset_size"))


def throttle_rows(events: DataFrame, keys: list[str], final: Column, ts: str, order: str) -> DataFrame:
    """What `throttle_fold` reads: keys, _order, _us, _final."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.select(*keys, F.col(order).cast("long").alias("_order"), micros.alias("_us"), F.coalesce(final, F.lit(False)).alias("_final"))


def throttle_fold(rows: DataFrame, keys: list[str], gap_us: int, carry: bool = False) -> DataFrame:
    """keys, _order and _us of the rows seen, folded in order of time.

    The rows are sorted by key and time and pass a fold that holds one batch and one time, however many events a key has.
    With `carry`, rows without _order are the times last seen by an earlier fold, and the same are given for the next one.
    """
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("_order").isNotNull() if carry else F.lit(True), "_us", "_order")
    n, schema = len(keys), rows.select(*keys, "_order", "_us").schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            seen = []
            for values in zip(*columns, strict=True):
                if values[:n] != key:
                    if carry and key is not None:
                        seen.append((*key, None, last))
                    key, last = values[:n], None
                number, us, final = values[n:]
                if carry and number is None:
                    last = us
                elif final or last is None or us is not None and us - last >= gap_us:
                    last = us
                    seen.append((*key, number, us))
            yield batch_of(seen, batch.schema)
        if carry and key is not None:
            yield batch_of([(*key, None, last)], batch.schema)

    def batch_of(seen: list[tuple], like: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in seen], like.field(k).type) for k in range(n + 2)], like.names[: n + 2])

    return ordered.mapInArrow(fold, schema)


def throttle(events: DataFrame, keys: list[str], gap_us: int, final: Column, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """The events that a throttled listener sees: at least a gap after the last one seen, and every final one.

    The rule is greedy, so each key is folded in order. Events without a time come first and are all seen.
    """
    seen = throttle_fold(throttle_rows(events, keys, final, ts, order), keys, gap_us)
    return seen.select(*keys, F.col("_order").alias(order))
