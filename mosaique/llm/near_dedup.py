"""Near-dedup of texts as a chosen-path set similarity join.

A document is its set of distinct word shingles. Equal sets become one class first, so that a large group of
exact copies is one vertex. Then:

1. TREES independent trees branch every class by minwise tokens: a node picks coordinates of the signature by a
   hash of its own name, and a class goes to the BRANCH children named by its tokens there (by one token at the
   root, by two below it). Nodes with one class end. The first tree is compared before the others, which leave out nodes
   that it has connected.
2. A node of up to SMALL classes is compared exhaustively, by signature first; what agrees in LEAST with another
   class of the node is compared on the full sets. Nodes that propose the same classes are compared once.
3. A larger node is cut into chunks of about SMALL classes, all with the same PIVOTS classes added, which are
   compared in the same way. All links so far give connected components, and only what lies outside a node's
   largest component can still need a link there. If that is nothing, the node is done: a large group of
   near copies ends here. If it is at most WITHIN times SMALL classes, they are compared with every chunk, at the next
   level with the components known so far; nodes that hold the same group leave out the pairs that one of them compares.
   Otherwise the node branches on, to DEPTH levels, and at last all that is left is compared, tile by tile.

Every link is confirmed on the full sets, and every pair that meets in an undivided node is tested unless it is
already connected. Rows grow with a node's size, never with its square, but for nodes that stay loose to the
last level. At similarity 0.8 two classes share a given root node with a probability of 0.8, and a node that
branches keeps them together in some child with 0.87: a pair is missed with about 1e-7 where root nodes are
enough, with 1e-4 after four levels of branching. With 96 coordinates an agreement under 0.6 has a probability of about
2e-6. Shingles are 64-bit hashes; a false match of two different shingles has a probability of about 1e-13
for a pair of long texts, and one alone moves a similarity by less than the limit can tell.

Cases: a null, empty or blank text has an empty set and is linked with nothing; fewer words than a shingle
make one shingle of all of them; rows repeated with one id share its component; rows with a null id are never
linked (component null, kept); an empty table gives an empty result; other columns are ignored, and kept
by `drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from mosaique.llm import places
from mosaique.llm.common import join_sized, whole_text
from mosaique.llm.tokens import Cache
from mosaique.operators.graph import connected_components
from mosaique.session import materialize

COORDINATES = 96
TREES = 5
BRANCH = 2
DEPTH = 8
#: Classes that are compared with each other at once; classes that all chunks of a larger node share.
SMALL = 512
PIVOTS = 12
#: A larger node is compared as a whole when at most so many times SMALL classes are outside its largest component: that takes
#: no more rows than to cut it into chunks first and to branch it once.
WITHIN = 2
#: Share of the coordinates in which two classes agree before their sets are compared.
LEAST = 0.6

_M = np.uint64(0x9E3779B97F4A7C15)
_HASHES = Cache(lambda w: xxhash.xxh64_intdigest(w), 60_000)


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; A-Z are lower-cased, words end at white space."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        key = np.full(n, width, np.uint64)
        for j in range(width):
            key = (key ^ h[j : j + n]) * _M
            key ^= key >> np.uint64(31)
    return np.unique(key)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    a = rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


_A, _B = _coefficients()


def signature(found: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set, one per coordinate."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 1024):
            part = found[at : at + 1024, None] * _A + _B
            np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _digest(found: np.ndarray) -> tuple[int, int]:
    data = found.tobytes()
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(data), "<i8").tolist())


def sets(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), sig (array of int) per document; written once."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, d1, d2, sig = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingle_set(text, k)
                    one, two = _digest(found)
                    n.append(len(found))
                    d1.append(one)
                    d2.append(two)
                    sig.append(signature(found) if len(found) else np.zeros(COORDINATES, np.int32))
                flat = pa.array(np.concatenate(sig) if sig else np.zeros(0, np.int32), pa.int32())
                ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * COORDINATES)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                    ["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return materialize(rows.mapInArrow(describe, f"doc_id {kind}, n_shingles long, d1 long, d2 long, sig array<int>"), "sets")


def _roots(classes: DataFrame, trees: range) -> DataFrame:
    """The first level of some trees. Their coordinates are all different, so that the trees are independent."""
    child = []
    for tree in trees:
        for k in range(BRANCH):
            child.append(F.xxhash64(F.lit(tree), F.lit(k), F.get("sig", F.lit(tree * BRANCH + k))))
    return classes.select("v", F.explode(F.array(*child)).alias("node"))


def _children(rows: DataFrame) -> DataFrame:
    """node, v and label for BRANCH children, by two tokens each, of each row of node, v, label and sig."""
    child = []
    for k in range(BRANCH):
        one = F.pmod(F.xxhash64("node", F.lit(2 * k)), F.lit(COORDINATES)).cast("int")
        two = F.pmod(F.xxhash64("node", F.lit(2 * k + 1)), F.lit(COORDINATES)).cast("int")
        child.append(F.xxhash64("node", F.lit(k), F.get("sig", one), F.get("sig", two)))
    return rows.select("v", "label", F.explode(F.array(*child)).alias("node"))


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, cut so that all rows with one value of the first column (sorted by it) come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if held and (last or held[-1].column(0)[0].as_py() != key[0]):
            # Rows of the run that is held end where the key changes; what follows up to the last run is whole too.
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)]).combine_chunks()
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column and where each row begins."""
    whole = column.combine_chunks()
    ends = whole.offsets.to_numpy()
    return whole.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _meetings(percent: int):
    """The classes of each unit that could be similar, as smaller units named by a hash of their members.

    Rows: unit, side (0: compared with all, 1: only with side 0), v, label, n_shingles, sig. Two classes meet when their
    labels differ, their sizes allow the similarity and their signatures agree in LEAST.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _whole_runs(batches):
            unit, side, v, label, n = (run.column(c).to_numpy() for c in range(5))
            sig = _lists(run.column(5))[0].reshape(len(v), COORDINATES)
            union, met = _Union(len(v)), np.zeros(len(v), bool)
            left, step = np.flatnonzero(side == 0), 1
            while len(left := left[left + step < len(v)]) and len(left := left[unit[left] == unit[left + step]]):
                other = left + step
                fits = (label[left] != label[other]) & (100 * np.minimum(n[left], n[other]) >= percent * np.maximum(n[left], n[other]))
                i, j = left[fits], other[fits]
                near = (sig[i] == sig[j]).sum(axis=1) >= LEAST * COORDINATES
                for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
                    union.join(a, b)
                met[i[near]] = met[j[near]] = True
                step += 1
            found = np.flatnonzero(met)
            root = np.fromiter((union.find(k) for k in found.tolist()), np.int64, len(found))
            found = found[np.lexsort((found, root))]
            root.sort()
            edges = [*np.flatnonzero(np.r_[True, root[1:] != root[:-1]]).tolist(), len(root)] if len(root) else [0]
            name = np.empty(len(found), np.int64)
            for low, high in zip(edges, edges[1:], strict=False):
                members = np.stack([v[found[low:high]], side[found[low:high]]])
                name[low:high] = np.uint64(xxhash.xxh64_intdigest(members[:, np.argsort(members[0], kind="stable")].tobytes())).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(side[found]), pa.array(v[found]), pa.array(label[found])], ["unit", "side", "v", "label"])

    return compare


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _similar_pairs(sets: list[np.ndarray], side: np.ndarray, union: _Union, percent: int) -> Iterator[tuple[int, int]]:
    """Exactly similar pairs that connect what `union` does not hold together yet.

    Few sets are compared pair by pair; more through an inverted index, which gives the intersections of one set
    with all others at once.
    """
    m = len(sets)
    if m <= 4:
        for i in range(m):
            for j in range(i + 1, m):
                if side[i] == 0 and union.find(i) != union.find(j) and _similar(sets[i], sets[j], percent) and union.join(i, j):
                    yield i, j
        return
    n = np.fromiter(map(len, sets), np.int64, m)
    owner = np.repeat(np.arange(m), n)
    _, word, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posting = owner[np.argsort(word, kind="stable")]
    first = np.cumsum(df) - df
    begin = np.cumsum(n) - n
    for i in range(m):
        if side[i]:
            return
        roots = np.fromiter(map(union.find, range(m)), np.int64, m)
        if (roots == roots[0]).all():
            return
        mine = word[begin[i] : begin[i] + n[i]]
        size = df[mine]
        at = np.repeat(first[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        both = np.bincount(posting[at], minlength=m)
        for j in np.flatnonzero((100 * both >= percent * (n[i] + n - both)) & (roots != roots[i])).tolist():
            if (j > i or side[j]) and union.join(i, j):
                yield i, j


def _confirm(percent: int):
    """Exact links of each unit. Rows: unit, side, v, label, words (the whole set)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _whole_runs(batches):
            unit, side, v, label = (run.column(c).to_numpy() for c in range(4))
            words = [np.frombuffer(x.as_buffer(), "<u8") for x in run.column(4)]
            edges = [*np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]).tolist(), len(unit)]
            src: list[int] = []
            dst: list[int] = []
            for low, high in zip(edges, edges[1:], strict=False):
                union, first = _Union(high - low), {}
                for i, x in enumerate(label[low:high].tolist()):
                    union.join(first.setdefault(x, i), i)
                for i, j in _similar_pairs(words[low:high], side[low:high], union, percent):
                    src.append(int(v[low + i]))
                    dst.append(int(v[low + j]))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return compare


def _whole_sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """v, d1, d2 and words (its whole set as bytes) of the rows with a wanted v, chosen by their places while the texts are read.

    An id may stand in several rows: (d1, d2) tells which of them is the class.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
            digests = [_digest(f) for f in found]
            ends = [pa.array([d[n] for d in digests], pa.int64()) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *ends, pa.array([f.astype("<u8").tobytes() for f in found], pa.binary())], ["v", "d1", "d2", "words"])

    own_id, own_text = (f"_c{docs.columns.index(c)}" for c in (id_col, text_col))
    at = places.with_places(docs).select(F.col(own_id).cast("long").alias("v"), "_file", "_row")
    at = at.join(wanted.select("v").hint("merge"), "v", "left_semi").select("_file", "_row")
    texts = places.at_places(docs, at, inside=True).select(F.col(own_id).cast("long").alias("v"), whole_text(own_text).alias("text"))
    return materialize(texts.mapInArrow(words, "v long, d1 long, d2 long, words binary"), "words")


def confirmed_links(docs: DataFrame, classes: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """src, dst: exactly similar classes, enough to connect all that are. `classes` has v, d1, d2, n_shingles, sig."""
    small = F.lit(SMALL)
    sized = classes.select("v", "n_shingles", "sig").hint("merge")
    words: DataFrame | None = None
    links: list[DataFrame] = []

    def meet(units: DataFrame) -> DataFrame:
        rows = units.join(sized, "v").select("unit", "side", "v", "label", "n_shingles", "sig")
        rows = rows.repartition("unit").sortWithinPartitions("unit", "side", "v")
        return materialize(rows.mapInArrow(_meetings(percent), "unit long, side int, v long, label long").distinct(), "meetings")

    def confirm(met: DataFrame) -> None:
        """Reads the texts of the classes that meet for the first time; sets that are known stay in `words`."""
        nonlocal words
        asked = materialize(classes.select("v", "d1", "d2").join(met.select("v").hint("merge"), "v", "left_semi"), "asked")
        new = asked if words is None else materialize(asked.join(words.select("v").hint("merge"), "v", "left_anti"), "wanted")
        if words is None or not new.isEmpty():
            more = _whole_sets(docs, new, k, id_col, text_col)
            words = more if words is None else words.unionByName(more)
        have = join_sized(words, asked, ["v", "d1", "d2"], "left_semi").groupBy("v").agg(F.any_value("words").alias("words"))
        rows = met.join(have.hint("merge"), "v").select("unit", "side", "v", "label", "words")
        rows = rows.repartition("unit").sortWithinPartitions("unit", "side", "v")
        links.append(materialize(rows.mapInArrow(_confirm(percent), "src long, dst long").distinct(), "links"))

    def united() -> DataFrame:
        found = links[0]
        for more in links[1:]:
            found = found.unionByName(more)
        return found

    def labelled(rows: DataFrame) -> DataFrame:
        """With the component of each v, so far, as its label."""
        return rows.join(labels.hint("merge"), "v", "left").withColumn("label", F.coalesce("component", "v")).drop("component")

    def mains(rows: DataFrame) -> DataFrame:
        """node, main (the label of most of its rows) and n_rest (rows with other labels) of the nodes that have both."""
        parts = rows.groupBy("node", "label").agg(F.count("*").alias("n"))
        main = parts.groupBy("node").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("n_rest"))
        return materialize(main.filter("n_rest > 0"), "main")

    def tiles(rows: DataFrame) -> DataFrame:
        """Units that compare whole nodes: some members, by tiles, with every chunk of all. Rows have main and n_rest.

        What is outside the largest component is compared with all; or, if that is less, what a node has besides the members that it
        shares with one earlier node of these, where those are compared.
        """
        rows = materialize(rows.join(rows.groupBy("v").agg(F.min("node").alias("earlier")).hint("merge"), "v"), "ends")
        shared = rows.filter("earlier < node").groupBy("node", "earlier").agg(F.count("*").alias("n"))
        shared = shared.groupBy("node").agg(F.max_by("earlier", F.struct("n", "earlier")).alias("known"), F.max("n").alias("n_known"))
        rows = join_sized(rows, materialize(shared, "shared"), ["node"], "left")
        n_new = F.col("n_node") - F.coalesce("n_known", F.lit(0))
        rows = rows.withColumn("first", F.when(n_new < F.col("n_rest"), F.col("earlier") != F.col("known")).otherwise(F.col("label") != F.col("main")))
        n_tiles = F.ceil(F.least(n_new, "n_rest") / small).cast("int")
        rows = rows.withColumn("n_tiles", n_tiles).filter("n_tiles > 0")
        tile = F.pmod(F.xxhash64("v", F.lit(5)), F.col("n_tiles")).cast("int")
        tiled = lambda rows, tile, chunk, side: rows.select(F.xxhash64("node", tile, chunk, F.lit("rest")).alias("unit"), F.lit(side).alias("side"), "v", "label")
        some = rows.filter("first").select("node", "v", "label", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("to"))
        every = rows.select("node", "v", "label", "chunk", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("to"))
        return tiled(some, "tile", "to", 0).unionByName(tiled(every, "to", "chunk", 1))

    def compared(level: DataFrame, depth: int, within: int | None) -> DataFrame:
        """Compares small nodes, larger ones with at most `within` rows outside their largest component (None: all) and the chunks
        of the others, whose rows it returns. `level`: node, v, label."""
        level = materialize(level, "level")
        # Written first, so that the join reads plain shuffles, which Spark can split where one node is large.
        # A node whose members are connected already has nothing to add.
        nodes = level.groupBy("node").agg(F.count("*").alias("n_node"), F.min("label").alias("_low"), F.max("label").alias("_high"))
        nodes = materialize(nodes.filter("_low <> _high").select("node", "n_node"), "nodes")
        n_chunks = F.ceil(F.col("n_node") / small).cast("int")
        rows = level.join(nodes.hint("merge"), "node").select("node", "v", "label", "n_node", n_chunks.alias("n_chunks"), F.pmod(F.xxhash64("v", F.lit(depth)), n_chunks).cast("int").alias("chunk"))
        rows = materialize(rows, "rows")
        in_chunk = lambda rows, chunk: rows.select(F.xxhash64("node", chunk).alias("unit"), F.lit(0).alias("side"), "v", "label")
        large = rows.filter(F.col("n_node") > small)
        if large.isEmpty():
            confirm(meet(in_chunk(rows, "chunk")))
            return large
        few = 0
        if within != 0:
            main = mains(large)
            whole = main if within is None else main.filter(F.col("n_rest") <= within)
            few = whole.count()
            ends = join_sized(large, whole, ["node"], "inner", few)
            large = join_sized(large, whole, ["node"], "left_anti", few)
        first = F.min(F.struct(F.xxhash64("v").alias("h"), "v", "label", "n_chunks", "chunk")).alias("first")
        pivots = large.groupBy("node", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(PIVOTS)).alias("slot")).agg(first).select("node", "first.*")
        pivots = pivots.select("node", "v", "label", "chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("to")).filter("to <> chunk")
        units = in_chunk(rows.filter(F.col("n_node") <= small), "chunk").unionByName(in_chunk(large, "chunk")).unionByName(in_chunk(pivots, "to"))
        confirm(meet(units.unionByName(tiles(ends)) if few else units))
        return large

    # One tree alone connects most of what is similar, so that the nodes of the others are mostly connected already:
    # a large group of near copies is compared in one tree, not in all.
    large = compared(_roots(classes, range(1)).withColumn("label", F.col("v")), 0, 0)
    labels = connected_components(united()).withColumnRenamed("vertex", "v")
    seen = len(links)
    level = labelled(_roots(classes, range(1, TREES)).unionByName(large.select("v", "node")))
    for depth in range(1, DEPTH + 2):
        large = compared(level, depth, WITHIN * SMALL if depth <= DEPTH else None)
        if large.isEmpty():
            break
        if any(not more.isEmpty() for more in links[seen:]):
            labels = connected_components(united()).withColumnRenamed("vertex", "v")
        seen = len(links)
        # In each large node only what is outside its largest component can still need a link.
        state = materialize(labelled(large.select("node", "v")), "state")
        main = mains(state)
        if main.isEmpty():
            break
        opened = join_sized(state, main, ["node"], "inner")
        if depth == DEPTH:
            level = opened.select("node", "v", "label")
            continue
        again = opened.filter(F.col("n_rest") <= WITHIN * SMALL).select("node", "v", "label")
        branching = opened.filter(F.col("n_rest") > WITHIN * SMALL).select("node", "v", "label")
        level = _children(branching.join(classes.select("v", "sig").hint("merge"), "v")).select("node", "v", "label").unionByName(again)
    return united()


def components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", as_read: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    `as_read` says that `docs` is a table read from files as it is; any other is written first.
    """
    docs = docs if as_read else places.stored(docs)
    table = sets(docs, k, id_col, text_col)
    real = table.filter("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("d1", "d2").agg(F.min("doc_id").cast("long").alias("v"), F.count("*").alias("n_rows"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig"))
    classes = materialize(classes, "classes")
    labels = _renamed(connected_components(confirmed_links(docs, classes, k, percent, id_col, text_col)))
    linked = classes.select("d1", "d2", "v", "n_rows").join(labels.hint("merge"), "v", "left")
    linked = linked.filter("label is not null or n_rows > 1")
    linked = materialize(linked.select("d1", "d2", F.coalesce("label", "v").alias("component_id")), "linked")
    keyed = table.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("d1")).alias("d1"), "d2")
    joined = join_sized(keyed, linked, ["d1", "d2"], "left")
    joined = joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _renamed(found: DataFrame) -> DataFrame:
    return found.withColumnRenamed("vertex", "v").withColumnRenamed("component", "label")


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", as_read: bool = False) -> DataFrame:
    """The documents that stay (the smallest id of each component), with all their columns. Ids and places travel, never texts.

    `as_read` says that `docs` is a table read from files as it is; any other is written first.
    """
    table = docs if as_read else places.stored(docs)
    gone = components(table, k, percent, id_col, text_col, as_read=True).filter("not kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    gone = materialize(gone, "gone")
    own = F.col(f"_c{docs.columns.index(id_col)}")
    at = places.with_places(table).select(own.alias("_id"), "_file", "_row").join(gone.hint("merge"), F.col("_id") == F.col("_gone_id"), "left_semi")
    return places.at_places(table, at.select("_file", "_row"), inside=False).drop("_file", "_row").toDF(*docs.columns)
