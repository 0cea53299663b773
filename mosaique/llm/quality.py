"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one integer whose bit k
says that rule k failed. A policy is a named, versioned set of rules: applying one, comparing two, or
asking what each rule costs are bitwise operations on the ledger and never read a text again.

Cases: a null or empty text has no words (all measurements 0), repeated rows each get a row, an empty
table gives an empty ledger; other columns are ignored by `ledger` and carried through untouched by `keep_good`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mosaique.llm.common import WORD

SYMBOL = re.compile(r"[#*$%&|<>]+")
WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ellipsis_lines", "n_alpha_words"]

#: Rule name -> condition that means failure. A rule's place in this list is its bit, for ever.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_words": "n_words > 1000000",
    "symbol_ratio": "10 * n_symbols > 3 * n_words",
    "short_words": "2 * word_chars < 5 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "duplicate_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
    "ellipsis_lines": "n_lines >= 4 and 10 * n_ellipsis_lines > 3 * n_lines",
    "few_alphabetic_words": "2 * n_alpha_words < n_words",
}
BITS = {name: k for k, name in enumerate(RULES)}

#: Policy name and version -> its rules. Old versions stay, so that earlier decisions can be repeated.
POLICIES: dict[str, list[str]] = {
    "base@1": ["few_words", "repeated_windows"],
    "web@1": ["few_words", "repeated_windows", "many_words", "symbol_ratio", "short_words", "long_words", "duplicate_lines", "ellipsis_lines", "few_alphabetic_words"],
    # No document is dropped for its size, or for being written without spaces between words.
    "web@2": ["few_words", "repeated_windows", "symbol_ratio", "short_words", "duplicate_lines", "ellipsis_lines", "few_alphabetic_words"],
    # Nor for its size here.
    "web@3": ["few_words", "repeated_windows", "symbol_ratio", "short_words", "long_words", "duplicate_lines", "ellipsis_lines", "few_alphabetic_words"],
}
PRODUCTION = "web@3"
#: The policy of the corpus pipeline.
CORPUS = "web@2"


def mask_of(policy: str) -> int:
    return sum(1 << BITS[rule] for rule in POLICIES[policy])


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    number = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # Equal keys are equal windows: no hash stands in for the words.
    key, span = number[:n], len(numbers)
    for k in range(1, window):
        if span * len(numbers) >= 1 << 63:
            found, key = np.unique(key, return_inverse=True)
            span = len(found)
        key, span = key * len(numbers) + number[k : k + n], span * len(numbers)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> list[int]:
    """The values of MEASURES for one text."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [
        len(words),
        sum(map(len, words)),
        sum(map(len, SYMBOL.findall(text))),
        sum(n - 1 for n in Counter(lines).values()),
        repeated_words(words),
        len(lines),
        sum(x.rstrip().endswith(("...", "…")) for x in lines),
        sum(any(map(str.isalpha, w)) for w in words) if not text.isascii() else len(ASCII_ALPHA.findall(text)),
    ]


ASCII_ALPHA = re.compile(r"[^\x20\x09-\x0DA-Za-z]*[A-Za-z][^\x20\x09-\x0D]*")


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(t or "") for t in batch.column(1).to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *MEASURES])


def failed_mask() -> Column:
    """Bit k is set where rule k fails."""
    total = F.lit(0).cast("long")
    for name, condition in RULES.items():
        total = total + F.when(F.expr(condition), F.lit(1 << BITS[name])).otherwise(F.lit(0))
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and `failed`: one bit per rule."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_measure_batches, schema).withColumn("failed", failed_mask())


def apply_policy(table: DataFrame, policy: str = PRODUCTION, to: str = "kept") -> DataFrame:
    """A boolean column: no rule of the policy failed."""
    return table.withColumn(to, F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablation(table: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that would stay without it.

    The ledger is first counted by mask (at most 2**rules rows); the rest is bitwise work on that table.
    """
    mask = mask_of(policy)
    masks = table.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = masks.select("failed", "n", F.explode(rules).alias("r")).select("failed", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed_docs"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without_rule"),
    )


def _keep_batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(t or "") for t in batch.column(at).to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *MEASURES])


def keep_good(docs: DataFrame, policy: str = CORPUS, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns, by the ledger's mask in one pass without a shuffle."""
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", " + ", ".join(f"{m} long" for m in MEASURES)
    table = plain.mapInArrow(lambda it: _keep_batches(it, at), schema).withColumn("failed", failed_mask())
    return apply_policy(table, policy).filter("kept").select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])
