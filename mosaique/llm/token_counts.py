"""Token counts by a two-tier lookup, without a shuffle of pre-tokens.

Tier 1: every task summarises its fragments with a bounded Misra-Gries counter over all its texts; the
summaries (never the fragments themselves) are added up, and the most frequent fragments with their token
counts become one compact table that is broadcast. Tier 2: what that table lacks is encoded by the library
in the worker and remembered in its bounded cache. The table only saves time; counts are the library's.

Cases: a null or empty text has 0 bytes and 0 tokens, repeated rows each get a row, an empty table gives an
empty result, other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mosaique.llm.common import whole_text
from mosaique.llm.tokens import ByteBpe, Cache, encoder, vocabulary

#: Bounds: counters of a task, fragments it reports, fragments in the broadcast table, their longest length.
TASK_COUNTERS = 40_000
TASK_REPORTS = 4_000
TABLE_ENTRIES = 32_768
TABLE_LENGTH = 64


@dataclass(frozen=True)
class LengthTable:
    """Fragments and their token counts, as one string and one array; at most a few MB."""

    fragments: str
    lengths: bytes

    @classmethod
    def of(cls, found: dict[str, int]) -> LengthTable:
        return cls("\0".join(found), np.fromiter(found.values(), "<u2", len(found)).tobytes())

    def as_dict(self) -> dict[str, int]:
        return dict(zip(self.fragments.split("\0"), np.frombuffer(self.lengths, "<u2").tolist(), strict=True)) if self.lengths else {}


def reduce_counters(counts: Counter, keep: int) -> None:
    """The Misra-Gries step: take the same amount off every counter so that at most `keep` stay."""
    if len(counts) > keep:
        values = np.fromiter(counts.values(), np.int64, len(counts))
        off = int(np.partition(values, len(values) - keep - 1)[len(values) - keep - 1])
        kept = {k: v - off for k, v in counts.items() if v > off}
        counts.clear()
        counts.update(kept)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(ByteBpe.chunks(text))
            if len(counts) > 4 * TASK_COUNTERS:
                reduce_counters(counts, TASK_COUNTERS)
    top = [(k, n) for k, n in counts.most_common(TASK_REPORTS) if n > 1 and len(k) <= TABLE_LENGTH and "\0" not in k]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["fragment", "n"])


def frequent_lengths(docs: DataFrame, model: str, text_col: str = "text") -> LengthTable:
    """The table of tier 1, from all texts."""
    summed = docs.select(whole_text(text_col).alias("text")).mapInArrow(_summaries, "fragment string, n long").groupBy("fragment").agg(F.sum("n").alias("n"))
    top = summed.orderBy(F.desc("n"), "fragment").limit(TABLE_ENTRIES).select("fragment").toArrow()["fragment"].to_pylist()
    encode = encoder(ByteBpe, vocabulary(model)).encode
    return LengthTable.of({k: min(len(encode(k)) // 4, 65535) for k in top})


_TIERS: dict[tuple, Cache] = {}


def _counter(model: str, table: LengthTable) -> Cache:
    """The worker's lookup: the broadcast table first, then what the worker has encoded itself."""
    key = (model, hash(table.fragments))
    if key not in _TIERS:
        chunk = encoder(ByteBpe, vocabulary(model))._chunk
        _TIERS.clear()
        _TIERS[key] = Cache(lambda fragment: len(chunk(fragment)) // 4)
        _TIERS[key].update(table.as_dict())
    return _TIERS[key]


def token_counts(docs: DataFrame, model: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", table: LengthTable | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    table = frequent_lengths(docs, model, text_col) if table is None else table
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ByteBpe, vocabulary(model))
        lengths = _counter(model, shared.value)
        for batch in batches:
            n = []
            for text in batch.column(2).to_pylist():
                if own.whole(text):
                    n.append(len(own.encode_whole(text)) // 4)
                else:
                    n.append(sum(map(lengths.__getitem__, ByteBpe.chunks(text))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
