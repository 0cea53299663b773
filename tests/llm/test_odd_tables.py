"""Empty tables, clashing names, very long and repeated labelled texts, exact windows, parts of frequent lengths."""

import random

from mosaique.llm import packing, quality, toxicity
from mosaique.session import materialize

CALM = [f"calm{chr(97 + k)}{chr(97 + k % 7)}" for k in range(20)]


def bags(rnd, n):
    rows, labels = [], []
    for k in range(n):
        parts, bad = [" ".join(rnd.choice(CALM) for _ in range(6)) for _ in range(5)], k % 2
        if bad:
            parts[rnd.randrange(5)] += " nastyword"
        rows.append((k, ". ".join(parts) + ".", "x", 0.5, "y", 1))
        labels.append((k, bad, "z"))
    return rows, labels


SCHEMA, MARKS = "doc_id long, text string, key string, score double, label string, n_offending long", "doc_id long, toxic int, text string"


def test_toxicity_of_odd_tables(spark):
    rows, labels = bags(random.Random(4), 120)
    long = " ".join("calm words without harm." for _ in range(40_000))
    rows += [rows[1]] * 50 + [(1, long, None, None, None, None), (500, long, None, None, None, None), (None, None, None, None, None, None), (501, "", None, None, None, None), (502, long + " A nastyword here.", None, None, None, None)]
    labels += [labels[1]] * 3 + [(500, 0, None), (502, 1, None), (None, 1, None), (7, None, None)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, MARKS)
    sample = toxicity.training_sample(docs, marks)
    assert sample.count() == sample.select("key").distinct().count() <= 122
    for options in ({}, {"max_words": None, "min_documents": 1, "max_sentences": None}, {"max_sentences": 3}):
        model = toxicity.fit(docs, marks, **options)
        scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
        assert toxicity.score(docs, model).count() == len(rows) and scored[502] > 0.7 and scored[501] < 0.5 and scored[None] < 0.5
        found = [scored[k] > 0.7 for k in range(120) if k != 1]
        assert sum(a == bool(k % 2) for a, k in zip(found, [k for k in range(120) if k != 1], strict=True)) >= 95
    assert toxicity.score(docs.limit(0), model).collect() == [] and toxicity.fit(docs.limit(0), marks).weights == {}
    assert toxicity.offending_sentences(docs.limit(0), model).collect() == []


def test_repeated_windows_without_hashes():
    rnd = random.Random(9)
    for vocabulary, n in ((3, 200), (40, 400), (9_000, 30_000)):
        words = [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]
        words += words[10:30]
        seen, covered = {}, set()
        for k in range(len(words) - 4):
            seen.setdefault(tuple(words[k : k + 5]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                covered.update(p + o for p in places for o in range(5))
        assert quality.repeated_words(words) == len(covered)
    assert quality.repeated_words([]) == quality.repeated_words(["a"] * 5) == 0 and quality.repeated_words(["a"] * 6) == 6


def test_a_frequent_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 7)
    rows = [(k, 0, 0, 1000 if k % 3 else 40 + k % 5, k) for k in range(300)]
    table = materialize(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    placed = packing.pack(table).collect()
    assert sorted(r.doc_id for r in placed) == list(range(300))
    by = {}
    for r in placed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= packing.CAPACITY
