"""Target-distribution importance resampling with hashed n-grams and Gumbel top-k.

Features of a text are its runs of 1 to 2 words; each falls into one of BUCKETS by its CRC-32. Both passes over the
texts intern their n-grams in an open-addressed NumPy table (`Interned`): xxhash64 of the n-gram's bytes is the key,
a slot's own bytes are compared with each n-gram that lands there, and the slots keep bucket and count. What a pass
needs is done per slot and not per occurrence:

1. Counting: the counts of the slots are added up by bucket; each batch sends at most BUCKETS rows to one
   map-side combined sum per table. All texts count, those of the target table too.
2. Weighing: a bucket's gain is the scaled logarithm of how much likelier it is in the target; the at most BUCKETS gains go to
   all tasks. Each slot looks up its gain once, and the slot ids of the occurrences gather the gains of a document.

The draw without replacement is Gumbel top-k: the weight plus noise from a keyed digest of the id; the documents are
numbered in the order of their scores over range partitions, and the first share of them is drawn.

A worker holds the words of one window (WINDOW words) at a time, whatever the length of a text: a run of words that
crosses a window's end is counted where it begins.

Cases: a null or empty text, or one without words, has no features, weight 0 and isn't drawn; a null id is hashed as the
empty string and comes after all others among equal scores; rows repeated with one id count, and are drawn, one by one;
empty tables give empty results (an empty target gives all buckets the gain of t = 0); other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from mosaique.llm.common import whole_text
from mosaique.operators.scan import numbered
from mosaique.session import materialize

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Words whose n-grams are interned together.
WINDOW = 100_000

#: A-Z become a-z; bytes that no word holds become spaces. Bytes of other characters stay.
_WORD_BYTES = bytes(b | 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))

# The multipliers of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


class _Spans:
    """n-grams as spans of one buffer, which is padded so that 8 bytes can be read anywhere."""

    def __init__(self, data: bytes, start: np.ndarray, end: np.ndarray):
        self.data = data + bytes(8)
        self.start, self.length = start, end - start
        self.at8 = np.ndarray(len(data) + 1, "<u8", self.data, strides=(1,))

    def xxh64(self) -> np.ndarray:
        """XXH64 of each span with seed 0: whole arrays at a time up to 31 bytes, one by one beyond."""
        start, n = self.start, self.length
        with np.errstate(over="ignore"):
            h = _P5 + n.astype(np.uint64)
            for lane in range(3):
                rows = np.flatnonzero(n >= 8 * lane + 8)
                if len(rows):
                    k = _rotl(self.at8[start[rows] + 8 * lane] * _P2, 31) * _P1
                    h[rows] = _rotl(h[rows] ^ k, 27) * _P1 + _P4
            rest, at = n & 7, start + (n & ~7)
            tail = self.at8[np.minimum(at, len(self.at8) - 1)]
            rows = np.flatnonzero(rest >= 4)
            h[rows] = _rotl(h[rows] ^ (tail[rows] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
            tail[rows] >>= np.uint64(32)
            rest[rows] -= 4
            for _ in range(3):
                rows = np.flatnonzero(rest > 0)
                h[rows] = _rotl(h[rows] ^ (tail[rows] & np.uint64(255)) * _P5, 11) * _P1
                tail[rows] >>= np.uint64(8)
                rest[rows] -= 1
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            h ^= h >> np.uint64(32)
        for k in np.flatnonzero(n >= 32).tolist():
            h[k] = xxhash.xxh64_intdigest(self.bytes(k))
        return h

    def bytes(self, k: int) -> bytes:
        return self.data[self.start[k] : self.start[k] + self.length[k]]

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a and b hold the same bytes, pair by pair."""
        same = self.length[a] == self.length[b]
        n, lane = self.length[a], 0
        while len(rows := np.flatnonzero(same & (n > 8 * lane))):
            left = np.minimum(n[rows] - 8 * lane, 8).astype(np.uint64)
            unread = (np.uint64(8) - left) << np.uint64(3)
            x = self.at8[self.start[a[rows]] + 8 * lane] ^ self.at8[self.start[b[rows]] + 8 * lane]
            same[rows] = (x << unread) == 0
            lane += 1
        return same


class Interned:
    """Open-addressed table of the distinct spans: key, bucket and count per slot, and the slot of each occurrence."""

    def __init__(self, spans: _Spans, buckets: int = BUCKETS):
        key = spans.xxh64()
        size = 1 << max(4, (2 * len(key)).bit_length())
        owner = np.full(size, -1, np.int64)
        self.slot = np.zeros(len(key), np.int64)
        left, at = np.arange(len(key)), (key & np.uint64(size - 1)).astype(np.int64)
        while len(left):
            free = owner[at] < 0
            owner[at[free]] = left[free]  # of several that want a slot the last gets it
            mine = owner[at]
            same = key[mine] == key[left]
            rows = np.flatnonzero(same)
            same[rows] = spans.equal(mine[rows], left[rows])
            self.slot[left[same]] = at[same]
            left, at = left[~same], (at[~same] + 1) & (size - 1)
        self.used = np.flatnonzero(owner >= 0)
        self.bucket = np.zeros(size, np.int64)
        own = owner[self.used]
        ends = zip(spans.start[own].tolist(), (spans.start[own] + spans.length[own]).tolist(), strict=True)
        self.bucket[self.used] = [zlib.crc32(spans.data[a:b]) % buckets for a, b in ends]
        self.count = np.bincount(self.slot, minlength=size)


def _windows(texts: Iterator[str], window: int) -> Iterator[tuple[_Spans, np.ndarray]]:
    """The n-grams that begin in each window of words, and the text that each belongs to."""
    words: list[bytes] = []
    own: list[np.ndarray] = []
    held = 0

    def cut() -> tuple[_Spans, np.ndarray]:
        """All runs that begin in the held words; the last word stays for the run over the edge."""
        text = np.concatenate(own)
        n = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(n + 1) - 1
        start = end - n
        two = np.flatnonzero(text[1:] == text[:-1])
        spans = _Spans(b" ".join(words), np.r_[start[first:], start[two]], np.r_[end[first:], end[two + 1]])
        return spans, np.r_[text[first:], text[two]]

    first = 0  # 1 where the first held word was counted as a word before
    for k, text in enumerate(texts):
        found = text.encode("utf-8").translate(_WORD_BYTES).split()
        for low in range(0, len(found), window):
            part = found[low : low + window]
            words += part
            own.append(np.full(len(part), k, np.int64))
            held += len(part)
            if held >= window:
                yield cut()
                words, own, held, first = words[-1:], [own[-1][-1:]], 1, 1
    if held > first:
        yield cut()


def bucket_counts(docs: DataFrame, name: str, text_col: str = "text", buckets: int = BUCKETS, window: int = WINDOW) -> DataFrame:
    """bucket and how many features of all texts fall into it; at most `buckets` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for spans, _ in _windows((t.as_py() for t in batch.column(0)), window):
                table = Interned(spans, buckets)
                total += np.bincount(table.bucket[table.used], weights=table.count[table.used], minlength=buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["bucket", "n"])

    rows = docs.select(whole_text(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    return materialize(rows.groupBy("bucket").agg(F.sum("n").alias(name)), f"counts_{name}")


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from two tables of at most `buckets` counts."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, table in ((s, source), (t, target)):
        found = table.toPandas().to_numpy(np.int64)
        into[found[:, 0]] = found[:, 1]
    whole_s, whole_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * whole_s / ((a + 1.0) * whole_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, window: int = WINDOW) -> DataFrame:
    """doc_id, n_features, weight, score per row of `docs`; written once."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n, total = np.zeros(m, np.int64), np.zeros(m, np.int64)
            for spans, text in _windows((t.as_py() for t in batch.column(2)), window):
                table = Interned(spans, len(gains))
                low, high = int(text.min()), int(text.max()) + 1
                gain = np.zeros(len(table.bucket), np.int64)
                gain[table.used] = gains[table.bucket[table.used]]
                # Sums of integers below 2**53, so that doubles hold them exactly.
                total[low:high] += np.bincount(text - low, weights=gain[table.slot]).astype(np.int64)
                n[low:high] += np.bincount(text - low)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(weight + np.array(noise, np.int64))], ["doc_id", "n_features", "weight", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("h"), whole_text(text_col).alias("text"))
    return materialize(rows.mapInArrow(weigh, f"doc_id {kind}, n_features long, weight long, score long"), "weights")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """`weighed` with `rank` (null: not drawn): the share with the highest scores of those with enough words."""
    enough = F.col("n_features") >= 2 * least_words - 1  # n words make 2 n - 1 runs
    able = weighed.filter(enough)
    drawn = percent * able.count() // 100
    place = numbered(able, [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    place = place.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return place.unionByName(weighed.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, window: int = WINDOW) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank, drawn towards the texts of `target`."""
    gains = bucket_gains(bucket_counts(docs, "s", buckets=buckets, window=window), bucket_counts(target, "t", buckets=buckets, window=window), buckets)
    return draw(weights(docs, gains, window=window), percent)
