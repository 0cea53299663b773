"""What the operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the word rules: space and the characters 9 to 13.
SPACE = r"\x20\x09-\x0D"
WORD = re.compile(f"[^{SPACE}]+")

#: A side is broadcast only while it has at most so many rows (of a few dozen bytes each).
BROADCAST_ROWS = 200_000


#: Rows in an Arrow batch: texts may be long, and a worker holds a batch several times over.
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, unless the session has chosen a smaller bound itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int | None = None) -> DataFrame:
    """Join whose strategy follows the counted size of `right`: broadcast up to BROADCAST_ROWS, else shuffle.

    `rows` is the count when the caller has it; `right` should be a table read back from storage.
    """
    rows = right.count() if rows is None else rows
    return left.join(right.hint("broadcast" if rows <= BROADCAST_ROWS else "merge"), on, how)
