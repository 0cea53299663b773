"""Importance resampling against a plain version, and its hash table against the xxhash library."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from mosaique.llm import resample

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain(docs, target, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)) for texts in ([d[1] for d in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    out = []
    for doc_id, text in docs:
        found = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return out


def by_row(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_hashes_and_slots(seed):
    rng = random.Random(seed)
    parts = [bytes(rng.randrange(97, 100) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 23, 24, 31, 32, 33, 80]))) for _ in range(3000)]
    end = np.cumsum([len(p) for p in parts])
    spans = resample._Spans(b"".join(parts), end - np.array([len(p) for p in parts]), end)
    assert spans.xxh64().tolist() == [xxhash.xxh64_intdigest(p) for p in parts]
    table, counts = resample.Interned(spans), collections.Counter(parts)
    assert len(table.used) == len(counts)
    for k, p in enumerate(parts):
        slot = table.slot[k]
        assert table.count[slot] == counts[p] and table.bucket[slot] == zlib.crc32(p) % 10_000


def test_equal_keys_with_other_bytes_get_slots_of_their_own(monkeypatch):
    monkeypatch.setattr(resample._Spans, "xxh64", lambda self: np.full(len(self.start), 15, np.uint64))
    parts = [b"one", b"two", b"one", b"onetwothree", b"two", b"onetwothrew"]
    end = np.cumsum([len(p) for p in parts])
    table = resample.Interned(resample._Spans(b"".join(parts), end - [len(p) for p in parts], end))
    assert len(table.used) == 4 and table.slot[0] == table.slot[2] and table.slot[1] == table.slot[4] and table.slot[3] != table.slot[5]


def test_documents_against_brute_force(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in target.collect()])
    assert by_row(resample.resample(docs, target).collect()) == by_row(want)
    assert by_row(resample.resample(docs, target, window=7).collect()) == by_row(want)


def test_odd_documents(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(1, "The quick brown fox"), (2, None)], "item_id long, text string")
    want = plain([tuple(r) for r in odd_docs.select("doc_id", "text").collect()], ["The quick brown fox", None])
    found = resample.resample(odd_docs, target, percent=60).collect()
    assert by_row(r[:4] for r in found) == by_row(r[:4] for r in want)
    ranks = sorted(r["rank"] for r in found if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 60 * sum(r[1] >= 39 for r in want) // 100
    assert resample.resample(no_docs, target).collect() == []
    assert len(resample.resample(odd_docs, target.limit(0)).collect()) == odd_docs.count()


def test_the_draw_leans_towards_the_target(spark):
    rng = random.Random(1)
    text = lambda words: " ".join(rng.choice(words) for _ in range(60))
    near, far = [f"near{k}" for k in range(50)], [f"far{k}" for k in range(50)]
    docs = spark.createDataFrame([(k, text(near if k % 4 == 0 else far)) for k in range(200)], "doc_id long, text string")
    target = spark.createDataFrame([(k, text(near)) for k in range(20)], "item_id long, text string")
    drawn = [r["doc_id"] for r in resample.resample(docs, target).collect() if r["rank"]]
    # 12 or 13 of 50 would be chance; the noise has the scale of one unit of the logarithm, as the gains do.
    assert len(drawn) == 50 and sum(d % 4 == 0 for d in drawn) > 25
