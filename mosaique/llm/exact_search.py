"""Exact top-k search by inner product with a vector-approximation file.

Components become integers (floor of SCALE times the component), and scores are integer inner products.

1. The vectors are packed into blocks of BLOCK bytes. A block's approximation has one byte per component: the number of
   the cell that the component lies in, of 256 equal cells between the block's smallest and largest value there. The
   exact vectors are kept apart.
2. Query blocks scan the approximations of all blocks. With a cell's corner and the cell widths one matrix product gives
   bounds of all scores of a block: the upper and the lower bound differ by a constant of query and block. A query's k-th largest
   lower bound so far is a floor of its k-th score; what lies below it is passed over, the rest is a candidate.
3. Candidates of all blocks meet per query: the k-th largest lower bound over all blocks prunes again.
4. Exact vectors are read in the order of their bounds, in rounds of FIRST, 4 FIRST, 16 FIRST ... candidates a query. A query
   is certain when its k-th exact score is above the next bound; only others go on to the next round.

Every block of queries meets every block of vectors once, by an equi-join on pairs of groups, so that work grows with
the number of queries times the number of vectors, as it must, and bytes that move with the number of query blocks. Candidates
are a few dozen a query; copies of one vector all tie at the k-th bound, so of vectors with equal components only the k + 1
smallest ids are ever packed (a query's own row may be one of them): no other can be among its k best.

Cases: null ids, null or empty tables, and vectors null or holding null or non-finite components take no part, nor do those with a
component of 2**26 / SCALE or more, whose scores could leave 64 bits; vectors of other lengths count as filled up with
zeros (an empty one scores 0); of rows that share an id the one with the smallest vector stands for it; other columns are ignored; a
query gets all other rows if they are fewer than k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mosaique.session import materialize

K = 5
QUERY_EVERY = 50
SCALE = 256
#: Bytes of cells in a block of vectors; blocks that meet a block of queries in one unit; bytes of a block of queries.
BLOCK = 1 << 16
GROUP_BLOCKS = 64
QUERY_BLOCK = 1 << 20
#: Queries whose bounds a worker holds at once for a block of vectors.
TILE = 256
#: Candidates a query whose exact vectors are read in the first round.
FIRST = 16
LARGEST = 1 << 26


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of int) of the vectors that take part, one row an id; written once."""
    v = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(F.lit(float(scale)) * x.cast("double")) < LARGEST) & ~F.isnan(x.cast("double")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col)).filter(F.col("vec_id").isNotNull() & F.col(vector_col).isNotNull() & fine)
    rows = materialize(rows.select("vec_id", F.transform(v, lambda x: x.cast("int")).alias("v")), "vectors")
    twice = materialize(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "twice")
    if twice.isEmpty():
        return rows
    once = rows.join(twice.hint("merge"), "vec_id", "left_anti")
    one = rows.join(twice.hint("merge"), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    return materialize(once.unionByName(one), "vectors")


def _representatives(vectors: DataFrame, k: int) -> DataFrame:
    """Of vectors with equal components the k + 1 smallest ids: a query's k best need no others."""
    copies = vectors.groupBy(F.xxhash64("v").alias("h")).agg(F.count("*").alias("n")).filter(F.col("n") > k + 1).select("h")
    copies = materialize(copies, "copies")
    if copies.isEmpty():
        return vectors
    keyed = vectors.withColumn("h", F.xxhash64("v"))
    few = keyed.join(copies.hint("merge"), "h", "left_anti").select("vec_id", "v")
    # Smallest ids per share of a group first, so that a large group is never sorted in one task.
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
    many = keyed.join(copies.hint("merge"), "h").withColumn("_share", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    many = many.withColumn("_n", order("v", "_share")).filter(F.col("_n") <= k + 1)
    many = many.withColumn("_n", order("v")).filter(F.col("_n") <= k + 1)
    return materialize(few.unionByName(many.select("vec_id", "v")), "representatives")


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of integer lists as a matrix, filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


def _packed(kind: str, size: int):
    """Blocks of up to `size` bytes: ids, width and either cells with corners and steps ("cells") or the integers ("exact")."""
    width = 1 if kind == "cells" else 4

    def block(table: pa.Table) -> pa.RecordBatch:
        ids = table.column(0).combine_chunks().to_numpy().astype("<i8")
        found = _matrix(table.column(1).combine_chunks())
        low = step = np.zeros(0, np.int64)
        if kind == "cells":
            low = found.min(axis=0)
            step = (found.max(axis=0) - low) // 256 + 1
        body = ((found - low) // step).astype(np.uint8) if kind == "cells" else found.astype("<i4")
        data = [ids.tobytes(), low.astype("<i8").tobytes(), step.astype("<i8").tobytes(), body.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in found.shape] + [pa.array([x], pa.binary()) for x in data], ["n", "dim", "ids", "low", "step", "body"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, rows = 0, size
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            longest = int(np.diff(batch.column(1).offsets.to_numpy()).max(initial=1))
            rows = min(rows, max(1, size // (width * max(longest, 1))))
            while n >= rows:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, rows))
                held, n = table.slice(rows).to_batches(), n - rows
        if n:
            yield block(pa.Table.from_batches(held))

    return pack


_BLOCK_SCHEMA = "n int, dim int, ids binary, low binary, step binary, body binary"


def _above(q: np.ndarray, floor: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int):
    """Query and vector numbers, lower and upper bounds of what may be among the k best; `floor` rises in place."""
    base = (q * step) @ cells.T + (q @ low)[:, None]
    # Far outside the error of doubles for integers of this size.
    room = np.abs(q) @ (np.abs(low) + 256 * step) * 1e-12
    least = np.minimum(q, 0) @ (step - 1) - room
    most = np.maximum(q, 0) @ (step - 1) + room
    base[own] = -np.inf
    n = base.shape[1]
    if n >= k:
        np.maximum(floor, np.partition(base, n - k, axis=1)[:, n - k] + least, out=floor)
    a, b = np.nonzero((base + most[:, None] >= floor[:, None]) & (base > -np.inf))
    found = base[a, b]
    return a, b, found + least[a], found + most[a]


def _bounds(k: int):
    """Candidates of each unit. Rows, sorted: qg, vg, side (0 its block of queries, 1 a block of cells), and the block's columns."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, queries, floor = np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0)
        held: list[tuple[np.ndarray, ...]] = []

        def settled() -> Iterator[pa.RecordBatch]:
            """What still reaches the floor that all blocks of the unit have raised."""
            for a, ids, least, most in held:
                kept = most >= floor[a]
                yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (q_ids[a], ids, least, most)], ["query_id", "vec_id", "least", "most"])
            held.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                side, n, dim = (batch.column(c)[r].as_py() for c in (2, 3, 4))
                ids, low, step = (np.frombuffer(batch.column(c)[r].as_buffer(), "<i8") for c in (5, 6, 7))
                body = batch.column(8)[r].as_buffer()
                if side == 0:
                    yield from settled()
                    q_ids, queries, floor = ids.copy(), np.frombuffer(body, "<i4").reshape(n, dim).astype(np.float64), np.full(n, -np.inf)
                    by_id = np.argsort(q_ids, kind="stable")
                    continue
                dim_ = min(dim, queries.shape[1])
                cells = np.frombuffer(body, np.uint8).reshape(n, dim)[:, :dim_].astype(np.float64)
                corner, width = low[:dim_].astype(np.float64), step[:dim_].astype(np.float64)
                # Ids are unique, so that each vector is at most one query's own row.
                at = np.minimum(np.searchsorted(q_ids, ids, sorter=by_id), len(q_ids) - 1)
                own_v = np.flatnonzero(q_ids[by_id[at]] == ids)
                own_q = by_id[at[own_v]]
                for begin in range(0, len(q_ids), TILE):
                    part = slice(begin, begin + TILE)
                    here = (own_q >= begin) & (own_q < begin + TILE)
                    a, b, least, most = _above(queries[part, :dim_], floor[part], cells, corner, width, (own_q[here] - begin, own_v[here]), k)
                    held.append((a + begin, ids[b], least, most))
        yield from settled()

    return search


def candidates(queries: DataFrame, vectors: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, most (an upper bound of the score) of all pairs that may be among the k best; written."""
    cells = materialize(vectors.mapInArrow(_packed("cells", block), _BLOCK_SCHEMA), "cells")
    # So few partitions that blocks of queries are full.
    n_bytes = queries.agg(F.sum(4 * F.size("v"))).first()[0] or 0
    asked = materialize(queries.repartition(-(-n_bytes // query_block) or 1).mapInArrow(_packed("exact", query_block), _BLOCK_SCHEMA), "queries")
    n_blocks = cells.count()
    groups = max(1, -(-n_blocks // GROUP_BLOCKS), min(n_blocks, 4 * cells.sparkSession.sparkContext.defaultParallelism))
    blocks = cells.select("*", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("vg"))
    numbers = asked.select("*", F.xxhash64("ids").alias("qg"))
    names = materialize(numbers.select("qg"), "names")
    all_groups = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    # Each block of queries goes to every group, each block of vectors to every block of queries: a pair meets once.
    left = numbers.select("*", all_groups.alias("vg")).withColumn("side", F.lit(0))
    right = blocks.join(names.withColumn("vg", all_groups).hint("merge"), "vg").withColumn("side", F.lit(1))
    columns = ["qg", "vg", "side", "n", "dim", "ids", "low", "step", "body"]
    units = left.select(columns).unionByName(right.select(columns)).repartition("qg", "vg").sortWithinPartitions("qg", "vg", "side")
    found = materialize(units.mapInArrow(_bounds(k), "query_id long, vec_id long, least double, most double"), "bounds")
    # Only the k best lower bounds of each unit matter, and those are among its candidates.
    best = Window.partitionBy("query_id").orderBy(F.desc("least"))
    kth = found.select("query_id", "least").withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k)
    kth = kth.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("least").alias("floor"))
    kth = materialize(kth.filter(F.col("_n") == k).select("query_id", "floor"), "floors")
    kept = found.join(kth.hint("merge"), "query_id", "left").filter(F.col("floor").isNull() | (F.col("most") >= F.col("floor")))
    return materialize(kept.select("query_id", "vec_id", "most"), "candidates")


def _score(q: str, v: str):
    product = F.zip_with(q, v, lambda a, b: F.coalesce(a.cast("long") * b.cast("long"), F.lit(0)))
    return F.aggregate(product, F.lit(0).cast("long"), lambda a, x: a + x)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, first: int = FIRST, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of `vectors` (both: vec_id, v), ties to the smaller id."""
    packed = _representatives(vectors, k)
    left = candidates(queries, packed, k, block, query_block)
    exact = packed.select("vec_id", "v")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    place = Window.partitionBy("query_id").orderBy(F.desc("most"), "vec_id")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    left = materialize(left.withColumn("place", F.row_number().over(place)), "order")
    best, low, read = None, 0, first
    while True:
        part = left.filter((F.col("place") > low) & (F.col("place") <= low + read))
        got = part.join(exact.hint("merge"), "vec_id").join(asked.hint("merge"), "query_id").select("query_id", "vec_id", _score("q", "v").alias("score"))
        got = got if best is None else best.unionByName(got)
        best = materialize(got.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "vec_id", "score"), "best")
        low += read
        read *= 4
        kth = best.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("kth"))
        rest = left.filter(F.col("place") > low).join(kth.hint("merge"), "query_id").filter((F.col("_n") < k) | (F.col("most") >= F.col("kth")))
        left = materialize(rest.select("query_id", "vec_id", "most", "place"), "order")
        if left.isEmpty():
            return best.select("query_id", F.row_number().over(by_score).cast("int").alias("rank"), "vec_id", "score")


def search(table: DataFrame, k: int = K, every: int = QUERY_EVERY, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best rows for each row whose id is divisible by `every`."""
    vectors = integer_vectors(table)
    queries = vectors.filter(F.col("vec_id") % every == 0)
    return top_k(queries, vectors, k, block=block, query_block=query_block)
