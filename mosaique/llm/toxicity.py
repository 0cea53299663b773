"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a logistic score from its words and word beginnings; a document's score is
the noisy-or of its sentences: 1 - prod(1 - p). Only documents are labelled; the likelihood of the noisy-or
is what is maximised, so the model finds out by itself which sentences offend, and `offending_sentences`
names them.

The classifier is fitted on at most MAX_POSITIVE + MAX_NEGATIVE labelled documents (chosen by a hash of their
id), its only bound. Features are counted in the tasks, and those come to the driver that tell more than the best of as many
useless ones would: the logarithm of their number (the risk inflation criterion). All sentences of a labelled document are
learnt from; those with the same features are one with a multiplicity, which loses nothing. `max_words`,
`min_documents` and `max_sentences` can bound a fit further; by default they don't. Every document is scored from its whole text.

Cases: a null or empty text is one sentence without words, repeated rows each get a score, of the rows with one
labelled id one is learnt from (the one that a hash of its text puts first), documents without a label are only scored, a null label is no label, without labels of both kinds every score is the base rate
of the labels (0.5 if there are none), an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from mosaique.llm.common import whole_text
from mosaique.llm.tokens import Cache
from mosaique.session import materialize

MAX_POSITIVE = 3_000
MAX_NEGATIVE = 6_000
#: Lengths of the word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6, 7)
THRESHOLD = 0.7

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORDS = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[re.Match]:
    return [m for m in _SENTENCE.finditer(text) if _WORDS.search(m[0])]


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def marks(word: str) -> list[str]:
    """The features of a word: itself and its beginnings, which stand for inflected forms not seen in learning."""
    return [word, *(f"^{word[:k]}" for k in BEGINNINGS if k < len(word))]


def features_of(text: str) -> set[str]:
    return {f for w in set(words(text)) for f in marks(w)}


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    @cached_property
    def _known(self) -> Cache:
        """Word -> its features that have a weight."""
        return Cache(lambda w: tuple(f for f in marks(w) if f in self.weights), 200_000)

    def probabilities(self, text: str) -> list[float]:
        """One per sentence; of a text without sentences, one for the empty sentence."""
        found, known = sentences(text), self._known.__getitem__
        out = []
        for m in found:
            hits = {f for fs in map(known, words(m[0])) for f in fs}
            out.append(_logistic(self.bias + math.fsum(self.weights[f] for f in hits)))
        return out or [_logistic(self.bias)]

    def score(self, text: str) -> float:
        clean = math.fsum(math.log1p(-min(p, 1 - 1e-12)) for p in self.probabilities(text))
        return min(1.0, max(0.0, -math.expm1(clean)))


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that learning never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """text and label of at most MAX_POSITIVE + MAX_NEGATIVE labelled documents outside the held-out part."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("key")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    order = [F.xxhash64("key"), F.col("key")]
    chosen = known.filter("label = 1").orderBy(*order).limit(MAX_POSITIVE).unionByName(known.filter("label = 0").orderBy(*order).limit(MAX_NEGATIVE))
    found = docs.select(F.col(id_col).alias("key"), whole_text(text_col).alias("text")).join(F.broadcast(chosen), "key")
    one = found.groupBy("key", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return materialize(one.select("key", "text", "label"), "labelled")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[label].update(features_of(text))
    every = [*(counts[0].keys() | counts[1].keys())]
    yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([c[w] for w in every], pa.int64()) for c in counts]], ["word", "n0", "n1"])


def _vocabulary(sample: DataFrame, n0: int, n1: int, max_words: int | None, min_documents: int) -> list[str]:
    """The features whose likelihood ratio is more than chance gives the best of so many, those that tell most first."""
    counted = sample.select("text", "label").mapInArrow(_count_words, "word string, n0 long, n1 long")
    counted = counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= min_documents)
    counted = materialize(counted, "features")
    n_features = max(1, counted.count())

    def fits(k: Column, n: Column) -> Column:
        part = k / n
        return F.when((k <= 0) | (k >= n), 0.0).otherwise(k * F.log(part) + (n - k) * F.log(1 - part))

    a, b, every = F.col("n1"), F.col("n0"), F.lit(float(n0 + n1))
    gain = F.round(fits(a, F.lit(float(n1))) + fits(b, F.lit(float(n0))) - fits(a + b, every), 6)
    ordered = counted.withColumn("gain", gain).filter(F.col("gain") > math.log(n_features)).orderBy(F.desc("gain"), "word")
    return [r.word for r in (ordered if max_words is None else ordered.limit(max_words)).select("word").collect()]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_words: int | None = None, min_documents: int = 1, max_sentences: int | None = None,
) -> Model:
    sample = training_sample(docs, labels, id_col, text_col, label_col)
    by_label = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = by_label.get(0, 0), by_label.get(1, 0)
    if not n0 or not n1:
        rate = n1 / (n0 + n1) if n0 + n1 else 0.5
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return Model(math.log(rate / (1 - rate)))
    vocabulary = _vocabulary(sample, n0, n1, max_words, min_documents)
    at = {w: k for k, w in enumerate(vocabulary)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, label in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = sentences(text)
                known = Counter(tuple(sorted(at[f] for f in features_of(m[0]) if f in at)) for m in found)
                plain = known.pop((), 0) if found else 1
                kept = list(known)
                if max_sentences is not None and len(kept) > max_sentences:
                    order = sorted(range(len(kept)), key=lambda k: zlib.crc32(f"{k} {kept[k]}".encode()))
                    kept = [kept[k] for k in sorted(order[:max_sentences])]
                rows.append((key, label, plain, [known[x] for x in kept], [len(x) for x in kept], [w for x in kept for w in x]))
            kinds = [batch.schema.types[0], pa.int32(), pa.int32(), *[pa.list_(pa.int32())] * 3]
            names = ["key", "label", "n_plain", "times", "n_words", "word"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    kind = sample.schema["key"].dataType.simpleString()
    schema = f"key {kind}, label int, n_plain int, times array<int>, n_words array<int>, word array<int>"
    table = sample.select("key", "text", "label").mapInArrow(features, schema).orderBy("key").toArrow()
    bias, weights = _maximise(table, len(vocabulary))
    return Model(bias, {w: float(x) for w, x in zip(vocabulary, weights, strict=True) if abs(x) > 1e-3})


def _maximise(table: pa.Table, n_words: int, steps: int = 400, rate: float = 0.1, ridge: float = 2e-6) -> tuple[float, np.ndarray]:
    """Adam on the mean log likelihood of the noisy-or, with a ridge penalty on the weights."""
    label, n_plain = table["label"].to_numpy().astype(float), table["n_plain"].to_numpy()
    n_known = pc.list_value_length(table["times"]).to_numpy()
    times, lengths, word = (pc.list_flatten(table[name]).to_numpy() for name in ("times", "n_words", "word"))
    n, total = len(label), len(times)
    doc, sentence = np.repeat(np.arange(n), n_known), np.repeat(np.arange(total), lengths)
    theta = np.zeros(n_words + 1)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(sentence, theta[word], total)
        p, base = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-theta[-1]))
        clean = np.bincount(doc, times * np.logaddexp(0, z), n) + n_plain * np.logaddexp(0, theta[-1])
        toxic = -np.expm1(-np.maximum(clean, 1e-9))
        pull = np.where(label == 1, (1 - toxic) / np.maximum(toxic, 1e-9), -1.0)
        by_sentence = times * p * pull[doc]
        slope = np.empty_like(theta)
        slope[:-1] = np.bincount(word, by_sentence[sentence], n_words) / n - ridge * theta[:-1]
        slope[-1] = (by_sentence.sum() + base * (pull * n_plain).sum()) / n
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return float(theta[-1]), theta[:-1]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_offending (sentences at 0.5 or more) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            value, offending = [], []
            for text in batch.column(1).to_pylist():
                ps = own.probabilities(text)
                value.append(min(1.0, max(0.0, -math.expm1(math.fsum(math.log1p(-min(p, 1 - 1e-12)) for p in ps)))))
                offending.append(sum(p >= 0.5 for p in ps))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64()), pa.array(offending, pa.int64())], ["doc_id", "score", "n_offending"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(scores, f"doc_id {kind}, score double, n_offending long")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin, end (code points), probability, sentence for every sentence at `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows: list[tuple] = []
            take = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                hits = [(m.start(), m.end(), p, m[0].strip()) for m, p in zip(sentences(text), own.probabilities(text), strict=False) if p >= least]
                rows += hits
                take += [k] * len(hits)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], ["doc_id", "begin", "end", "probability", "sentence"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(locate, f"doc_id {kind}, begin long, end long, probability double, sentence string")
