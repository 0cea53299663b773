"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

1. Each text loses its white space and is hashed (SHA-256); the narrow digest table is written once.
2. A Misra-Gries summary (`stat.freqItems`) over that table names at most 1/support digests that may
   hold more than `support` of the rows; none that does is missed.
3. Exact counts and winners of those candidates come from one map-side combined aggregate. They are at
   most 1/support rows, so they are broadcast, and the rows of hot digests never meet in one task.
4. The remaining digests, none with more than `support` of the rows, go through an ordinary shuffle.

Cases: a null text counts as empty, all texts without visible characters are equal, a null id sorts last,
rows repeated with the same id and text count as members and one of them stays, an empty table gives an
empty result, other columns are ignored by `digests`/`exact_groups` and kept by `drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mosaique.llm import places
from mosaique.llm.common import SPACE, whole_text
from mosaique.session import materialize

#: Digests with more than this share of the rows are split off; their table has at most 1/SUPPORT rows.
SUPPORT = 0.001
#: Partial summaries that meet in the last step of the Misra-Gries pass.
SUMMARIES = 256


def text_digest(text_col: str = "text") -> Column:
    """Lowercase hex SHA-256 of the text without white space, in UTF-8."""
    return F.sha2(F.regexp_replace(whole_text(text_col), f"[{SPACE}]+", ""), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_points (code points of the original), digest, row (tells repeated rows apart); written once."""
    table = docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(whole_text(text_col)).cast("long").alias("n_points"),
        text_digest(text_col).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    return materialize(table, "digests")


def frequent_digests(table: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Candidates of the Misra-Gries summary: every digest above `support` of the rows, and some others."""
    # As many summaries as the cluster has cores: each has at most 1/support rows, and one task adds them up.
    tasks = max(SUMMARIES, table.sparkSession.sparkContext.defaultParallelism)
    summary = table.select("digest").coalesce(tasks).stat.freqItems(["digest"], support)
    return summary.select(F.explode("digest_freqItems").alias("digest"))


def _best() -> Column:
    """Orders the rows of a group: most code points, then smallest id, then first row."""
    return F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("row"))


def hot_winners(table: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Exact count and winner of each candidate; at most 1/support rows."""
    hot = table.join(F.broadcast(frequent_digests(table, support)), "digest")
    winners = hot.groupBy("digest").agg(F.min(_best()).alias("best"), F.count("*").alias("group_size"))
    return materialize(winners.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "winners")


def exact_groups(table: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Each row of `digests` with keep_id, group_size and kept."""
    winners = hot_winners(table, support)
    hot = table.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    rest = rest.withColumn("best", F.min(_best()).over(group)).withColumn("group_size", F.count("*").over(group))
    rest = rest.withColumn("keep_id", F.col("best.doc_id")).withColumn("keep_row", F.col("best.row"))
    columns = ["doc_id", "n_points", "digest", "row", "keep_id", "keep_row", "group_size"]
    return hot.select(columns).unionByName(rest.select(columns)).withColumn("kept", F.col("row") == F.col("keep_row"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_read: bool = False) -> DataFrame:
    """The rows that stay, with all their columns. Texts are read for their digests and once more for the rows that stay; none is shuffled.

    `as_read` says that `docs` is a table read from files as it is; any other is written first. Of rows with equal
    ids and texts of equal length the first in the order of files and rows stays.
    """
    table = docs if as_read else places.stored(docs)
    own_id, own_text = (f"_c{docs.columns.index(c)}" for c in (id_col, text_col))
    keyed = places.with_places(table).select(
        F.col(own_id).alias("doc_id"),
        F.char_length(whole_text(own_text)).cast("long").alias("n_points"),
        text_digest(own_text).alias("digest"),
        F.struct("_file", "_row").alias("row"),
    )
    gone = exact_groups(materialize(keyed, "digests")).filter("not kept").select("row.*")
    kept = places.at_places(table, gone, inside=False)
    return kept.drop("_file", "_row").toDF(*docs.columns)
