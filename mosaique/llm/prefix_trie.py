"""Prefix trie of conversations from double-array tries per prefix shard.

1. Turns get their places by a segmented scan (equal turns of one conversation: by role, then text) and 128-bit digests;
   texts end there. A rebuilt conversation is a path of digests, cut into blocks of BLOCK turns. A block begins at a
   prefix, named by a running sum of hashes of all turns before it, so that conversations with one prefix share it.
2. Equal block paths become one, with the number of conversations, their smallest id and sums. The distinct paths are dealt
   out by ranges of (prefix, turns), longer before shorter: a shard is a run of neighbours in that order, whatever
   number of paths shares a prefix. Only nodes on a shard's first or last path can also be in another shard.
3. A shard numbers its turns densely, packs a double-array trie (child = BASE[node] + turn, valid if CHECK[child] =
   node), walks all its paths through it level by level, and adds up each node's aggregates at its place in the arrays.
   All of them are sums over paths, also those over subtrees: a path *owns* the nodes that the path before it in the
   order doesn't have, so that each distinct node is owned once, and a node's subtree is what the paths through it
   own. The last path of the shard before comes with each shard as its first row.
4. Nodes that shards share (upper nodes, block ends) are merged by their names, the others are final.

Conversations over several blocks carry what later blocks own (a first pass over those blocks, and a scan); for all
others there is one pass.

Cases: a null turn comes first; null roles and texts are empty; rows repeated in one conversation are turns of their
own; a null conv_id takes no part; a conversation without turns (its own all replaced, the other one absent) is a
member of the root alone; an empty table gives no node; conversations of any length are cut into blocks; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from mosaique.llm.common import SPACE, whole_text
from mosaique.operators.scan import scan
from mosaique.session import materialize

EVERY = 20
HEADS = 4
BLOCK = 512
#: Turns of distinct paths in a shard, on average, where there are more than Spark's partitions hold.
SHARD_TURNS = 1_000_000
#: Ids that are joined into one string before they are hashed: those of one range of so many numbers.
ENDS = 1 << 16
_MASK = (1 << 62) - 1


def _with_head(df: DataFrame) -> DataFrame:
    """`df` with h, the number of turns that are replaced."""
    return df.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int"))


def turns(table: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), a, b (digests of role and text), words; written once."""
    role, text = whole_text("role"), whole_text("text")
    words = F.size(F.split(F.regexp_replace(F.concat(F.lit(" "), text), f"[{SPACE}]+$", ""), f"[{SPACE}]+")) - 1
    digest = [F.xxhash64(F.lit(k), role, text) for k in range(2)]
    rows = table.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), digest[0].alias("a"), digest[1].alias("b"), words.cast("long").alias("words")).filter("conv_id is not null")
    # Texts only travel where a conversation has several rows for one turn.
    same = ["conv_id", "turn", "role"]
    ties = materialize(rows.groupBy(*same).count().filter("count > 1").select(*same), "ties")
    tie: Column = F.lit(None).cast("string")
    if not ties.isEmpty():
        ties = ties.toDF("c_", "t_", "r_").withColumn("tied", F.lit(True))
        on = (F.col("conv_id") == F.col("c_")) & F.col("turn").eqNullSafe(F.col("t_")) & (F.col("role") == F.col("r_"))
        rows = rows.join(ties.hint("merge"), on, "left")
        tie = F.when(F.col("tied"), F.col("text"))
    rows = rows.select("conv_id", "turn", "role", tie.alias("tie"), "a", "b", "words")
    placed = scan(rows, ["conv_id"], ["turn", "role", "tie"], number="pos")
    return materialize(placed.select("conv_id", (F.col("pos") - 1).alias("pos"), "a", "b", "words"), "turns")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rebuilt conversations' turns, one row a conversation with n, the number of its turns), from `turns`."""
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    convs = _with_head(sizes).withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY)
    convs = materialize(convs, "conversations")
    heads = convs.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(heads.hint("merge"), "base", "left").withColumn("taken", F.least(F.col("h"), F.coalesce("n_base", F.lit(0))))
    convs = convs.withColumn("n", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "h", "taken", "n"), "conversations")
    first = placed.filter(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "base")
    before = convs.filter("taken > 0").select("conv_id", "base", "taken").join(first.hint("merge"), "base").filter("pos < taken")
    # h follows from the id; only conversations whose replacement is short are moved, and joined for that.
    own = _with_head(placed).filter("pos >= h")
    moved = materialize(convs.filter("taken < h and n > taken").select("conv_id", "taken"), "moved")
    if not moved.isEmpty():
        own = own.join(moved.hint("merge"), "conv_id", "left").withColumn("pos", F.col("pos") - F.when(F.col("taken").isNotNull(), F.col("h") - F.col("taken")).otherwise(0))
    columns = ["conv_id", "pos", "a", "b", "words"]
    return before.select(columns).unionByName(own.select(columns)), convs.select("conv_id", "n")


def _hashes(a: Column, b: Column, pos: Column) -> list[Column]:
    """Two hashes of a turn at its place, from 0 to 2**62 - 1, whose sums name a prefix."""
    return [F.shiftrightunsigned(F.xxhash64(a, b, pos), 2), F.shiftrightunsigned(F.xxhash64(b, a, pos), 2)]


def _turn_hash(a: int, b: int, pos: int) -> tuple[int, int]:
    """The same in Python: a chain of XXH64 over 8 bytes each."""
    out = []
    for chain in ((a, b, pos), (b, a, pos)):
        h = 42
        for x in chain:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        out.append(h >> 2)
    return out[0], out[1]


def blocks(rows: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """A row per conversation and block: conv_id, block, p, q (name of the prefix before it), t (digests), w (words), more (goes on), after (words of later blocks)."""
    cut = rows.withColumn("block", F.floor(F.col("pos") / block))
    one, two = _hashes(F.col("a"), F.col("b"), F.col("pos"))
    parts = F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words")))
    made = cut.withColumns({"ha": one, "hb": two}).groupBy("conv_id", "block").agg(
        parts.alias("x"), F.sum(F.col("ha").cast("decimal(38,0)")).alias("ha"), F.sum(F.col("hb").cast("decimal(38,0)")).alias("hb"))
    made = made.select(
        "conv_id", "block", F.flatten(F.transform("x", lambda r: F.array(r["a"], r["b"]))).alias("t"), F.transform("x", lambda r: r["words"]).alias("w"), "ha", "hb")
    empty = convs.filter("n = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.array().cast("array<bigint>").alias("t"), F.array().cast("array<bigint>").alias("w"), F.lit(0).cast("decimal(38,0)").alias("ha"), F.lit(0).cast("decimal(38,0)").alias("hb"))
    made = materialize(made.unionByName(empty).withColumn("sum_w", F.aggregate("w", F.lit(0).cast("long"), lambda x, y: x + y)), "blocks")
    long = materialize(convs.filter(F.col("n") > block).select("conv_id", "n"), "long")
    zero = F.lit(0).cast("long")
    if long.isEmpty():
        return made.select("conv_id", "block", zero.alias("p"), zero.alias("q"), "t", "w", F.lit(False).alias("more"), zero.alias("after"))
    here = made.join(long.hint("merge"), "conv_id", "left")
    whole = here.filter("n is not null").select("conv_id", "block", "ha", "hb", "sum_w", "n")
    upto = scan(whole, ["conv_id"], ["block"], sums={"sa": F.col("ha"), "sb": F.col("hb")})
    later = scan(whole, ["conv_id"], [F.desc("block")], sums={"sw": F.col("sum_w")}).select("conv_id", "block", (F.col("sw") - F.col("sum_w")).alias("after"))
    name = lambda s, h: F.pmod(F.col(s) - F.col(h), F.lit(1 << 62).cast("decimal(38,0)")).cast("long")
    upto = upto.select("conv_id", "block", name("sa", "ha").alias("p"), name("sb", "hb").alias("q"), ((F.col("block") + 1) * block < F.col("n")).alias("more"))
    carried = upto.join(later.hint("merge"), ["conv_id", "block"])
    joined = made.join(carried.hint("merge"), ["conv_id", "block"], "left")
    return materialize(joined.select("conv_id", "block", F.coalesce("p", zero).alias("p"), F.coalesce("q", zero).alias("q"), "t", "w", F.coalesce("more", F.lit(False)).alias("more"), F.coalesce("after", zero).alias("after")), "long_blocks")


_PATH = ["block", "p", "q", "t"]


def _paths(rows: DataFrame) -> DataFrame:
    """Distinct block paths in shards, in order, with sums over their conversations; each shard begins with the last path before it (`n` null)."""
    keyed = rows.withColumns({"ka": F.xxhash64("block", "p", "q", "t"), "kb": F.xxhash64("t", "q", "p", "block")})
    merged = keyed.groupBy("ka", "kb").agg(
        *[F.any_value(c).alias(c) for c in (*_PATH, "w")], F.count("*").alias("n"), F.min("conv_id").alias("least"), F.sum("after").alias("after"),
        F.sum("own_after").alias("own_after"), F.sum("leaves_after").alias("leaves_after"), F.max("more").alias("more"))
    merged = materialize(merged, "merged_paths")
    spark, order = rows.sparkSession, [F.desc(c) for c in _PATH]
    turns_ = merged.agg(F.sum(F.size("w"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns_ // SHARD_TURNS))
    dealt = materialize(merged.repartitionByRange(shards, *order).withColumn("shard", F.spark_partition_id()), "paths")
    last = dealt.groupBy("shard").agg(F.min(F.struct(*_PATH)).alias("x"))
    # As many rows as shards.
    handed = last.withColumn("x", F.lag("x").over(Window.orderBy("shard"))).filter("x is not null").select("shard", "x.*")
    handed = handed.select(*[F.col(c) if c in handed.columns else F.lit(None).cast(t).alias(c) for c, t in dealt.dtypes])
    whole = dealt.unionByName(handed).repartition(shards, "shard")
    return whole.sortWithinPartitions("shard", F.col("n").isNotNull(), *order)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, pa.Table]]:
    """(the last path before it, the rows) of each shard of a partition."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[tuple | None, pa.Table]:
        table = pa.Table.from_batches(held)
        before = None
        if not table.column("n")[0].is_valid:
            before = tuple(table.column(c)[0].as_py() for c in _PATH)
            table = table.slice(1)
        return before, table.combine_chunks()

    for batch in batches:
        while batch.num_rows:
            shard = batch.column("shard").to_numpy()
            if held and held[-1].column("shard")[0].as_py() != shard[0]:
                yield whole()
                held.clear()
            same = int(np.searchsorted(shard, shard[0], side="right"))
            held.append(batch.slice(0, same))
            batch = batch.slice(same)
    if held:
        yield whole()


class DoubleArray:
    """Tries over dense turn ids in two arrays, one root for each first id of `roots`; slot 0 is free, root r is slot r + 1."""

    def __init__(self, n_roots: int):
        self.base = np.zeros(4 * n_roots + 16, np.int64)
        self.check = np.full(len(self.base), -1, np.int64)
        self.check[1 : n_roots + 1] = 0
        self.top = n_roots + 1

    def _room(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base))
            self.base = np.concatenate([self.base, np.zeros(more - len(self.base), np.int64)])
            self.check = np.concatenate([self.check, np.full(more - len(self.check), -1, np.int64)])

    def add_level(self, parents: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Put the children of one level into the arrays: (parent, turn) pairs, distinct and sorted. Their slots."""
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]]) if len(parents) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(parents)])
        # Only children take the next free places one after another.
        one = first[size == 1]
        self._room(self.top + len(one))
        slots = np.zeros(len(parents), np.int64)
        slots[one] = np.arange(self.top, self.top + len(one))
        self.base[parents[one]] = slots[one] - turn[one]
        self.check[slots[one]] = parents[one]
        self.top += len(one)
        # Siblings need a base at which all of their places are free: gaps that others of the level left are tried first.
        low = self.top
        for begin, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            mine = turn[begin : begin + n]
            place, span = mine - mine[0], int(mine[-1] - mine[0]) + 1
            self._room(self.top + span)
            gaps = (low + np.flatnonzero(self.check[low : min(low + 1024, self.top)] < 0)[:32]).tolist()
            at = next((g for g in gaps if (self.check[g + place] < 0).all()), self.top)
            if at == self.top:
                # Nothing fits here, nor will much that follows.
                low = min(gaps[-1] + 1 if gaps else low + 1024, self.top)
            slots[begin : begin + n] = at + place
            self.base[parents[begin]] = at - mine[0]
            self.check[at + place] = parents[begin]
            self.top = max(self.top, at + span)
        return slots

    def step(self, node: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The child of each node by a turn; all must be there."""
        child = self.base[node] + turn
        assert (self.check[child] == node).all()
        return child


def _lcp(a: np.ndarray, b: np.ndarray) -> int:
    """Turns at the beginning that two paths (of two digests a turn) share."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0] if len(differ) else n) // 2


def _owned(before: tuple | None, table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The paths of a shard, the depth at which each leaves the path before it (-1: none begins at its prefix), and where prefixes change."""
    column = lambda c: table.column(c).to_numpy()
    start = np.stack([column("block"), column("p"), column("q")])
    flat = table.column("t").combine_chunks()
    ends = flat.offsets.to_numpy()
    turn = flat.values.to_numpy()
    paths = [turn[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    fresh = np.r_[True, (start[:, 1:] != start[:, :-1]).any(axis=0)]
    shared = np.full(len(paths), -1, np.int64)
    if before is not None and before[:3] == tuple(start[:, 0].tolist()):
        shared[0] = _lcp(paths[0], np.array(before[3], np.int64))
    for k in np.flatnonzero(~fresh).tolist():
        shared[k] = _lcp(paths[k], paths[k - 1])
    return paths, shared, fresh


def _tail_sums(w: pa.ListArray, n: np.ndarray) -> np.ndarray:
    """Per path and depth d from 0 to its length the words of its turns from the d-th on (at 0: of all)."""
    width = int(n.max(initial=0))
    out = np.zeros((len(n), width + 2), np.int64)
    cell = np.arange(1, width + 1) <= n[:, None]
    out[:, 1 : width + 1][cell] = w.flatten().to_numpy()
    out[:, :] = np.cumsum(out[:, ::-1], axis=1)[:, ::-1]
    out[:, 0] = out[:, 1] if width else 0
    return out


_NODES = "a long, b long, pa long, pb long, depth long, least long, parent_least long, n long, words long, children long, leaves long, total long, own long, ka long, kb long, open boolean"


def _shard_nodes(block: int):
    """The nodes of each shard with their partial aggregates; `open` ones may have more in other shards."""

    def build(before: tuple | None, table: pa.Table) -> pa.RecordBatch:
        paths, shared, fresh = _owned(before, table)
        column = lambda c: table.column(c).to_numpy()
        m, size = len(paths), np.fromiter((len(p) // 2 for p in paths), np.int64, len(paths))
        base_depth, prefix = column("block") * block, np.stack([column("p"), column("q")])
        weight, least, more = column("n"), column("least"), column("more").astype(bool)
        tail = _tail_sums(table.column("w").combine_chunks(), size)
        width = int(size.max(initial=0))
        # Dense turn ids in this shard, level by level, so that siblings have neighbouring ones.
        pairs = np.concatenate(paths).reshape(-1, 2)
        at_depth = np.arange(len(pairs)) - np.repeat(np.cumsum(size) - size, size)
        by_level = np.argsort(at_depth, kind="stable")
        _, first, dense = np.unique(np.ascontiguousarray(pairs[by_level]).view([("a", "<i8"), ("b", "<i8")]).ravel(), return_index=True, return_inverse=True)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        numbers = np.empty(len(pairs), np.int64)
        numbers[by_level] = rank[dense]
        turn = np.zeros((m, width), np.int64)
        turn[np.arange(width) < size[:, None]] = numbers
        # Pack level by level, then walk all paths: the slot of each path at each depth.
        root = np.cumsum(fresh)
        trie = DoubleArray(int(root[-1]))
        slot = np.zeros((m, width + 1), np.int64)
        slot[:, 0] = root
        for d in range(width):
            rows = np.flatnonzero(size > d)
            # Neighbours in the order share their nodes; the first of each run brings the node.
            parent, child = slot[rows, d], turn[rows, d]
            new = np.flatnonzero(np.r_[True, (parent[1:] != parent[:-1]) | (child[1:] != child[:-1])])
            new = new[np.lexsort((child[new], parent[new]))]
            trie.add_level(parent[new], child[new])
            slot[rows, d + 1] = trie.step(slot[rows, d], turn[rows, d])
        top = trie.top
        zeros = lambda: np.zeros(top, np.int64)
        n, total, own, leaves, children, words, depth = (zeros() for _ in range(7))
        low, parent, ends = np.full(top, np.iinfo(np.int64).max), zeros(), np.full(top, -1, np.int64)
        leaf = (shared < size) & ~more
        own_after, after, leaves_after = column("own_after"), column("after"), column("leaves_after")
        for d in range(width + 1):
            rows = np.flatnonzero(size >= d)
            at = slot[rows, d]
            depth[at] = base_depth[rows] + d
            np.minimum.at(low, at, least[rows])
            if d < width:
                on = rows[(size[rows] > d) & (shared[rows] <= d)]
                np.add.at(children, slot[on, d], 1)
            if d:
                parent[at] = slot[rows, d - 1]
                words[at] = tail[rows, d] - tail[rows, d + 1]
            # A block's root counts what its paths have only at the very beginning; else the block before has counted it.
            rows = rows[(d > 0) | (base_depth[rows] == 0)]
            at = slot[rows, d]
            np.add.at(n, at, weight[rows])
            np.add.at(total, at, weight[rows] * tail[rows, d] + after[rows])
            np.add.at(own, at, tail[rows, np.maximum(np.minimum(shared[rows], size[rows]) + 1, d)] + own_after[rows])
            np.add.at(leaves, at, leaf[rows] + leaves_after[rows])
        ends[slot[np.arange(m), size]] = np.arange(m)
        # Names, for nodes that others may have too: those of the first and the last path, roots, and ends of whole blocks.
        opened, name = np.zeros(top, bool), np.zeros((2, top), np.int64)
        asked = {0, m - 1} | set(np.flatnonzero(more).tolist())
        opened[slot[fresh, 0]] = True
        name[:, slot[:, 0]] = prefix
        for k in sorted(asked):
            held = [int(prefix[0, k]), int(prefix[1, k])]
            border = k in (0, m - 1)
            for d in range(int(size[k])):
                h = _turn_hash(int(paths[k][2 * d]), int(paths[k][2 * d + 1]), int(base_depth[k]) + d)
                held = [(held[0] + h[0]) & _MASK, (held[1] + h[1]) & _MASK]
                at = slot[k, d + 1]
                name[:, at] = held
                opened[at] |= border or d + 1 == size[k]
        used = np.flatnonzero(trie.check[:top] >= 0)
        up, end = parent[used], ends[used]
        path_key = [np.where(end >= 0, column(c)[end], 0) for c in ("ka", "kb")]
        real = up > 0  # all but roots
        values = {
            "a": name[0, used], "b": name[1, used], "pa": name[0, up], "pb": name[1, up], "depth": depth[used], "least": low[used], "parent_least": low[up], "n": n[used],
            "words": words[used], "children": children[used], "leaves": leaves[used], "total": total[used], "own": own[used], "ka": path_key[0], "kb": path_key[1],
        }
        arrays = [pa.array(v) for v in values.values()]
        # Parents: none (a root), open (to be looked up by name) or settled.
        arrays[2] = pa.array(values["pa"], mask=~(real & opened[up]))
        arrays[6] = pa.array(values["parent_least"], mask=~(real & ~opened[up]))
        for at in (13, 14):
            arrays[at] = pa.array(path_key[at - 13], mask=end < 0)
        return pa.RecordBatch.from_arrays([*arrays, pa.array(opened[used])], [*values, "open"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, table in _shards(batches):
            yield build(before, table)

    return shards


def _owned_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per path: the conversation that stands for it, the block, the words that it owns and whether it ends in a leaf."""
    for before, table in _shards(batches):
        paths, shared, _ = _owned(before, table)
        size = np.fromiter((len(p) // 2 for p in paths), np.int64, len(paths))
        tail = _tail_sums(table.column("w").combine_chunks(), size)
        own = tail[np.arange(len(paths)), np.minimum(shared, size) + 1]
        leaf = (shared < size) & ~table.column("more").to_numpy().astype(bool)
        yield pa.RecordBatch.from_arrays([table.column("least").combine_chunks(), table.column("block").combine_chunks(), pa.array(own), pa.array(leaf.astype(np.int64))], ["conv_id", "block", "own", "leaf"])


def _with_later(rows: DataFrame) -> DataFrame:
    """`rows` with own_after and leaves_after: what later blocks own, once for each distinct path."""
    zero = F.lit(0).cast("long")
    plain = rows.withColumns({"own_after": zero, "leaves_after": zero})
    later = rows.filter("block > 0")
    if later.isEmpty():
        return plain
    paths = _paths(plain.filter("block > 0"))
    owned = paths.mapInArrow(_owned_parts, "conv_id long, block long, own long, leaf long")
    owned = materialize(owned, "owned")
    # A conversation of several blocks begins at block 0, which owns nothing here.
    every = rows.filter("more or block > 0").select("conv_id", "block").join(owned.hint("merge"), ["conv_id", "block"], "left")
    every = every.select("conv_id", "block", F.coalesce("own", zero).alias("own"), F.coalesce("leaf", zero).alias("leaf"))
    sums = scan(every, ["conv_id"], [F.desc("block")], sums={"own_sum": F.col("own"), "leaf_sum": F.col("leaf")})
    sums = sums.select("conv_id", "block", (F.col("own_sum") - F.col("own")).alias("own_after"), (F.col("leaf_sum") - F.col("leaf")).alias("leaves_after"))
    joined = rows.join(sums.hint("merge"), ["conv_id", "block"], "left")
    return materialize(joined.withColumns({c: F.coalesce(c, zero) for c in ("own_after", "leaves_after")}), "with_later")


def ends(rows: DataFrame) -> DataFrame:
    """ka, kb of a path and ends_sha256: the hash of the ids, ascending, of the conversations that end there."""
    last = rows.filter("not more").select(F.xxhash64(*_PATH).alias("ka"), F.xxhash64("t", "q", "p", "block").alias("kb"), "conv_id")
    # A range of ENDS numbers makes one string; a path's strings are hashed one after the other.
    parts = last.groupBy("ka", "kb", F.floor(F.col("conv_id") / ENDS).alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    dealt = materialize(parts, "ends").repartition("ka", "kb").sortWithinPartitions("ka", "kb", "part")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha = None, None
        for batch in batches:
            done: list[tuple] = []
            for ka, kb, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if (ka, kb) == held:
                    sha.update(f",{ids}".encode())
                    continue
                if held:
                    done.append((*held, sha.hexdigest()))
                held, sha = (ka, kb), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict({c: [r[k] for r in done] for k, c in enumerate(("ka", "kb", "sha"))}, schema=_SHA)
        if held:
            yield pa.RecordBatch.from_pydict({"ka": [held[0]], "kb": [held[1]], "sha": [sha.hexdigest()]}, schema=_SHA)

    return dealt.mapInArrow(digest, "ka long, kb long, sha string")


_SHA = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("sha", pa.string())])


def trie(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(turns(table))
    rows = _with_later(blocks(rows, convs, block))
    paths = _paths(rows)
    nodes = materialize(paths.mapInArrow(_shard_nodes(block), _NODES), "nodes")
    sums = ["n", "children", "leaves", "total", "own"]
    opened = nodes.filter("open").groupBy("a", "b", "depth").agg(
        *[F.sum(c).alias(c) for c in sums], F.min("least").alias("least"), F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
        F.min("parent_least").alias("parent_least"), F.max("ka").alias("ka"), F.max("kb").alias("kb"))
    opened = materialize(opened, "merged")
    columns = ["depth", "least", "parent_least", "pa", "pb", "ka", "kb", *sums]
    every = nodes.filter("not open").select(columns).unionByName(opened.select(columns))
    # Children of merged nodes look up their parent's name; the others know it.
    names = opened.select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("merged_least"))
    under = every.filter("pa is not null").join(names.hint("merge"), ["pa", "pb", "depth"], "left")
    other = every.filter("pa is null").withColumn("merged_least", F.lit(None).cast("long"))
    every = under.select(*columns, "merged_least").unionByName(other.select(*columns, "merged_least"))
    sha = ends(rows)
    with_ends = every.filter("ka is not null").join(sha.hint("merge"), ["ka", "kb"], "left").select(*columns, "merged_least", "sha")
    every = with_ends.unionByName(every.filter("ka is null").withColumn("sha", F.lit(None).cast("string")).select(*columns, "merged_least", "sha"))
    return every.select(
        F.col("least").alias("conv_id"), "depth", F.coalesce("merged_least", "parent_least").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("total") - F.col("own")).alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
