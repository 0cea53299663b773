"""The conversation trie against a plain version that lists all prefixes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from mosaique.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [r[2:] for r in sorted(own)] for c, own in convs.items()}
    members, ends, last = {}, {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        under = children.get(p, [])
        words = len(WORDS.findall(p[-1][1])) if p else 0
        leaves[p] = sum(leaves[x] for x in under) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[x] for x in under)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(p)) for p, m in members.items())


def found(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.select(columns).collect())


def made(seed, n, turns, texts):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), n):
        rows += [(c, t if rng.random() > 0.05 else None, rng.choice(["user", "bot", None]) if t % 3 == 0 else "user", rng.choice(texts)) for t in range(rng.randint(1, turns))]
    rng.shuffle(rows)
    return rows


def test_table_against_all_prefixes(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert found(prefix_trie.trie(table)) == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize(("seed", "block", "shard"), [(1, 512, 1_000_000), (2, 2, 1_000_000), (3, 3, 20), (4, 1, 10)])
def test_shared_prefixes_blocks_and_shards(spark, monkeypatch, seed, block, shard):
    """Few texts, so that all prefixes are shared; short blocks and shards, so that nodes are cut everywhere."""
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard)
    rows = made(seed, 120, 9, ["a", "b b", "c\td  e", None, ""])
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert found(prefix_trie.trie(table, block)) == plain(rows)


def test_copies_and_one_long_conversation(spark):
    """A third of all conversations are equal, and one holds a third of all rows."""
    rows = [(c, t, "user", f"turn {t} of all") for c in range(1, 120, 2) for t in range(5)]
    rows += [(200, t, "user", f"long {t % 7}") for t in range(300)] + [(220 + c, t, "bot", f"{c} {t % 2}") for c in range(30) for t in range(4)]
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert found(prefix_trie.trie(table, 16)) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS", 4)
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, None, None, None), (2, 5, "user", ""), (2, 5, "bot", "y"), (2, 5, "bot", "x"), (23, 0, "u", "short"), (37, 0, "u", "only"), (-5, 1, "u", "neg ative")]
    rows += [(c, 0, "u", "same") for c in range(40, 80)]
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert found(prefix_trie.trie(table)) == plain(rows)
    assert prefix_trie.trie(table.limit(0)).collect() == []
    alone = [(47, 0, "u", "gone")]  # its first turns are replaced by those of a conversation that isn't there
    assert found(prefix_trie.trie(spark.createDataFrame([(*r, 1) for r in alone], SCHEMA))) == plain(alone)


@pytest.mark.parametrize("seed", range(4))
def test_double_array(seed):
    """Every pair that was put in leads to its own place, and no other turn of a node leads anywhere."""
    rng = np.random.default_rng(seed)
    trie, level, held = prefix_trie.DoubleArray(3), np.arange(1, 4), {}
    for _ in range(4):
        pairs = sorted({(int(p), int(t)) for p in level for t in rng.integers(0, 300, rng.integers(1, 40))})
        parents, turns = (np.array(x) for x in zip(*pairs, strict=True))
        slots = trie.add_level(parents, turns)
        held |= dict(zip(pairs, slots.tolist(), strict=True))
        level = rng.choice(slots, 20, replace=False)
    assert len(set(held.values())) == len(held)
    for (p, t), slot in held.items():
        assert trie.step(np.array([p]), np.array([t]))[0] == slot
    for p in {p for p, _ in held}:
        for t in range(300):
            at = trie.base[p] + t
            assert ((p, t) in held) == bool(0 < at < trie.top and trie.check[at] == p)
