"""Parts of near-dedup without Spark: whole runs of batches, exact pairs through the inverted index, meetings of a unit."""

import numpy as np
import pyarrow as pa
import pytest

from mosaique.llm import near_dedup as N


@pytest.mark.parametrize("seed", range(6))
def test_runs_stay_whole(seed):
    rnd = np.random.default_rng(seed)
    key = np.sort(rnd.integers(0, rnd.integers(1, 40), 200))
    cuts = [0, *np.sort(rnd.choice(np.arange(1, 200), rnd.integers(0, 60), replace=False)).tolist(), 200]
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(np.arange(a, b))], ["k", "v"]) for a, b in zip(cuts, cuts[1:])]
    batches.insert(1, batches[0].slice(0, 0))
    runs = [(t.column(0).to_numpy(), t.column(1).to_numpy()) for t in N._whole_runs(iter(batches))]
    assert np.concatenate([v for _, v in runs]).tolist() == list(range(200))
    seen = [set(k.tolist()) for k, _ in runs]
    assert all(not (a & b) for i, a in enumerate(seen) for b in seen[i + 1 :])


def random_sets(rnd, n):
    base = [np.unique(rnd.integers(0, 1 << 60, 60).astype(np.uint64)) for _ in range(4)]
    out = []
    for _ in range(n):
        chosen = base[rnd.integers(0, 4)]
        kept = chosen[rnd.random(len(chosen)) > rnd.choice([0.0, 0.05, 0.1, 0.2])]
        out.append(np.unique(np.concatenate([kept, rnd.integers(0, 1 << 60, rnd.integers(0, 8)).astype(np.uint64)])))
    return out


@pytest.mark.parametrize(("seed", "n"), [(1, 2), (2, 4), (3, 5), (4, 40), (5, 120)])
def test_pairs_connect_what_is_similar(seed, n):
    rnd = np.random.default_rng(seed)
    sets, side = random_sets(rnd, n), np.sort(rnd.integers(0, 2, n))
    union, want = N._Union(n), N._Union(n)
    pairs = list(N._similar_pairs(sets, side, union, 80))
    exact = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    assert all(exact(sets[i], sets[j]) for i, j in pairs)
    for i in range(n):
        for j in range(i + 1, n):
            if side[i] == 0 and exact(sets[i], sets[j]):
                want.join(i, j)
    assert [union.find(k) for k in range(n)] == [want.find(k) for k in range(n)]


def test_meetings_hold_every_near_pair_and_name_equal_groups_alike():
    rnd = np.random.default_rng(8)
    sig = rnd.integers(0, 1 << 30, (9, N.COORDINATES)).astype(np.int32)
    sig[1, :70], sig[2, :70], sig[5] = sig[0, :70], sig[0, 10:80], sig[4]
    rows = [(unit, 0, v, v if v != 5 else 4, 100) for unit in (1, 2) for v in ([0, 1, 3] if unit == 1 else [0, 1, 2, 4, 5])]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array([sig[r[2]].tolist() for r in rows], pa.list_(pa.int32()))], ["unit", "side", "v", "label", "n", "sig"])
    out = pa.Table.from_batches(list(N._meetings(80)(iter([batch])))).to_pylist()
    assert sorted({r["v"] for r in out}) == [0, 1] and len({r["unit"] for r in out}) == 1  # 4 and 5 are connected already
