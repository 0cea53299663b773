"""Lossless similarity join in a metric space, by pivots: for thresholds at which bands of bits select nothing.

What a score lacks to 100 is a weighted sum of two Hamming distances and a histogram distance, each a metric, so that
their sum D is one. A pair is similar if D is at most a radius.

1. Pivots are chosen far from each other from a bounded sample (they change what is tested, never what is found). Each row
   belongs to the cell of its nearest pivot.
2. A row can be similar to one of another cell only if the triangle inequality allows it: D(row, pivot) is within the radius
   of the distances that the cell's own rows have to their pivot, and at most 2 radii more than the distance to its own pivot. To such
   cells it is sent as well; of each two cells one sends to the other, so that no pair meets twice.
3. Inside a cell its own rows meet all rows in tiles of bounded size: the rows of a tile come to one task, which compares them as
   arrays, block by block, and hands on only pairs that the hashes and histograms leave. No pair is ever a row before that.

How much that saves depends on the data: rasters in clusters keep most pairs apart, but all pairs of random ones are about
equally far from each other, so that at low thresholds nearly every pair is tested (once, as in the exact join).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mosaique.functions import scalars as S
from mosaique.session import materialize

#: Rows from which pivots are chosen; rows of a tile.
SAMPLE, TILE_ROWS = 2_000, 10_000
#: Pairs that a task compares at once; tiles of a group, at least as many blocks as keep the cores busy.
BLOCK_PAIRS, LEAST_BLOCKS = 1 << 18, 4
#: Scores have two decimals, so that a distance may be half of the last one more.
ROUNDED = 0.005 + 1e-9


class _Points:
    """Hashes and histograms as arrays."""

    def __init__(self, a: np.ndarray, d: np.ndarray, hist: np.ndarray):
        self.a, self.d, self.hist = a.view(np.uint64), d.view(np.uint64), hist

    def distances(self, other: _Points, layout: tuple[int, int, float]) -> np.ndarray:
        """D between all rows of both."""
        a_bits, d_bits, l1 = layout
        ha, hd = (np.bitwise_count(x[:, None] ^ y[None, :]) for x, y in ((self.a, other.a), (self.d, other.d)))
        near = np.stack([np.abs(self.hist - h).sum(axis=1) for h in other.hist], axis=1) if len(other.hist) else np.zeros((len(self.a), 0))
        return S.WEIGHT_A / a_bits * ha + S.WEIGHT_D / d_bits * hd + S.WEIGHT_H * np.minimum(near / l1, 1.0)


def _points(a: pa.Array, d: pa.Array, hist: pa.ListArray) -> _Points:
    n = len(a)
    return _Points(a.to_numpy(), d.to_numpy(), hist.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1)))


def _known(fp: DataFrame) -> DataFrame:
    """Rows without a hash or histogram are similar to nothing."""
    return fp.filter("a_hash is not null and d_hash is not null and color_hist is not null and forall(color_hist, h -> h is not null)")


def choose_pivots(fp: DataFrame, count: int, id_col: str, layout: tuple[int, int, float]) -> _Points:
    """Pivots far from each other, one after the other, from the SAMPLE rows whose hashed ids are smallest."""
    rows = _known(fp).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select("a_hash", "d_hash", "color_hist").toArrow().combine_chunks()
    found = _points(*(c.combine_chunks() for c in rows.columns)) if rows.num_rows else _Points(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1)))
    at, least = [0], np.full(rows.num_rows, np.inf)
    while rows.num_rows and len(at) < count:
        last = _Points(found.a[at[-1:]], found.d[at[-1:]], found.hist[at[-1:]])
        least = np.minimum(least, found.distances(last, layout)[:, 0])
        if least.max() <= 0:
            break
        at.append(int(least.argmax()))
    return _Points(found.a[at], found.d[at], found.hist[at]) if rows.num_rows else found


def cells(fp: DataFrame, threshold: float, pivots: _Points, id_col: str, layout: tuple[int, int, float]) -> tuple[DataFrame, DataFrame]:
    """(rows with `cell` and `far`, their distance to its pivot; the same of other cells' rows that may be similar to some)."""
    radius = 100 - threshold + ROUNDED
    names = [id_col, "a_hash", "d_hash", "color_hist"]
    kind = fp.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, a_hash long, d_hash long, color_hist array<double>, cell int, far double"

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _points(*batch.columns[1:4]).distances(pivots, layout)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], [*names, "cell", "far"])

    homes = materialize(_known(fp.select(*names)).mapInArrow(home, schema), "homes")
    # As many rows as pivots.
    low, high = np.full(len(pivots.a), np.inf), np.full(len(pivots.a), -np.inf)
    for row in homes.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high")).collect():
        low[row["cell"]], high[row["cell"]] = row["low"], row["high"]

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = np.arange(len(pivots.a))
        for batch in batches:
            far = _points(*batch.columns[1:4]).distances(pivots, layout)
            own, near = batch.column(4).to_numpy()[:, None], batch.column(5).to_numpy()[:, None]
            may = (far <= near + 2 * radius) & (far <= high + radius) & (far >= low - radius)
            # Of two cells the one with the larger number sends where both numbers are even or odd, else the other.
            rows, cell = np.nonzero(may & (to != own) & ((to < own) ^ ((to + own) % 2 == 1)))
            taken = pa.RecordBatch.from_arrays(batch.columns[:4], names).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(far[rows, cell])], [*names, "cell", "far"])

    return homes, materialize(homes.mapInArrow(outer, schema), "outer")


def _close(one: _Points, two: _Points, threshold: float, layout: tuple[int, int, float], triangle: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(places in both, Hamming distances, histogram distance) of the pairs that can reach the threshold, some BLOCK_PAIRS at a time."""
    a_bits, d_bits, l1 = layout
    wa, wd, room = S.WEIGHT_A * d_bits, S.WEIGHT_D * a_bits, a_bits * d_bits * (100 - threshold)
    step = max(1, BLOCK_PAIRS // max(1, len(two.a)))
    for low in range(0, len(one.a), step):
        rest = low + 1 if triangle else 0
        ha, hd = (np.bitwise_count(x[low : low + step, None] ^ y[None, rest:]) for x, y in ((one.a, two.a), (one.d, two.d)))
        i, j = np.nonzero(ha * np.int32(wa) + hd * np.int32(wd) <= room)
        ha, hd = ha[i, j].astype(np.int32), hd[i, j].astype(np.int32)
        i, j = i + low, j + rest
        far = np.zeros(len(i))
        for k in range(one.hist.shape[1]):  # in the order of `scalars.hist_l1`, so that sums are equal to the last bit
            far += np.abs(one.hist[i, k] - two.hist[j, k])
        # What remains to be tested exactly: all but pairs that rounding can't lift to the threshold.
        lacks = S.WEIGHT_A / a_bits * ha + S.WEIGHT_D / d_bits * hd + S.WEIGHT_H * np.minimum(far / l1, 1.0)
        found = (lacks <= 100 - threshold + ROUNDED) & ((i < j) | (not triangle))
        yield i[found], j[found], ha[found], hd[found], far[found]


def _compare(threshold: float, layout: tuple[int, int, float]):
    """The close pairs of each tile. Rows: cell, kind, bi, bj, side, id, a_hash, d_hash, color_hist, sorted by the first five."""

    def tile(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        kind, bi, bj = (table.column(c)[0].as_py() for c in (1, 2, 3))
        split = int(np.searchsorted(table.column(4).to_numpy(), 1))
        points = lambda t: _points(*(t.column(c).combine_chunks() for c in (6, 7, 8)))
        triangle = kind == 0 and bi == bj
        left, right = table.slice(0, split), table if triangle else table.slice(split)
        if not left.num_rows or not right.num_rows:
            return
        ids = [t.column(5).combine_chunks() for t in (left, right)]
        for i, j, ha, hd, far in _close(points(left), points(right), threshold, layout, triangle):
            if len(i):
                yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(i)), ids[1].take(pa.array(j)), *map(pa.array, (ha, hd, far))], ["one", "two", "ha", "hd", "l1"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in range(4)])
            edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:], strict=False):
                key = tuple(at[:, low].tolist())
                if held and key != name:
                    yield from tile(held)
                    held = []
                held.append(batch.slice(low, high - low))
                name = key
        if held:
            yield from tile(held)

    return compare


def pairs_in_cells(homes: DataFrame, outer: DataFrame | None, threshold: float, id_col: str, layout: tuple[int, int, float], blocks: int | None = None) -> DataFrame:
    """l_id, r_id (l_id < r_id), ha, hd and l1 of all pairs of a cell that can reach the threshold, each once: its own rows with each other and with the outer ones.

    Own rows are dealt to blocks of about TILE_ROWS (or `blocks` of them); of two blocks one is the left side of their tile, and a block's
    own tile holds it once. A row is copied once for each tile that it is in.
    """
    counted = lambda df, to: df.groupBy("cell").agg(F.count("*").alias(to))
    size = counted(homes, "n").withColumn("m", F.lit(0).cast("long")) if outer is None else counted(homes, "n").join(counted(outer, "m").hint("merge"), "cell", "left")
    tiles = lambda n: F.ceil(n / TILE_ROWS).cast("int")
    size = size.select("cell", (F.lit(blocks) if blocks else tiles(F.col("n"))).alias("ti"), tiles(F.coalesce("m", F.lit(0))).alias("tj"))
    size = materialize(size, "tiles")
    columns = ["a_hash", "d_hash", "color_hist"]

    def side(df: DataFrame, own: str, at: Column) -> DataFrame:
        """Rows with their block `b`, once for each of the tiles `at`."""
        placed = df.join(size.hint("merge"), "cell").withColumn("b", F.pmod(F.xxhash64(id_col), F.col(own)).cast("int"))
        return placed.withColumn("t", F.explode(at)).select("cell", "t.*", F.col(id_col).alias("id"), *columns)

    up_to = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: k < n)
    place = lambda kind, i, j, side: F.struct(*[F.lit(c).cast("int").alias(name) if isinstance(c, int) else c.cast("int").alias(name) for name, c in (("kind", kind), ("bi", i), ("bj", j), ("side", side))])
    b = F.col("b")
    own = F.concat(
        F.transform(up_to(F.col("ti") - b), lambda k: place(0, b, b + k, 0)),
        F.transform(up_to(b), lambda k: place(0, k, b, 1)),
        F.transform(up_to(F.col("tj")), lambda k: place(1, b, k, 0)),
    )
    rows = side(homes, "ti", own)
    if outer is not None:
        rows = rows.unionByName(side(outer, "tj", F.transform(up_to(F.col("ti")), lambda k: place(1, k, b, 1))))
    tile = ["cell", "kind", "bi", "bj"]
    kind = homes.schema[id_col].dataType.simpleString()
    rows = rows.select(*tile, "side", "id", *columns).repartition(*tile).sortWithinPartitions(*tile, "side")
    met = rows.mapInArrow(_compare(threshold, layout), f"one {kind}, two {kind}, ha int, hd int, l1 double").filter("one <> two")
    return met.select(F.least("one", "two").alias(f"l_{id_col}"), F.greatest("one", "two").alias(f"r_{id_col}"), "ha", "hd", "l1")


def all_pairs(fp: DataFrame, threshold: float, id_col: str, layout: tuple[int, int, float], blocks: int | None = None) -> DataFrame:
    """The pairs that can reach the threshold, with their distances, after a test of every row with every other."""
    rows = _known(fp.select(id_col, "a_hash", "d_hash", "color_hist")).withColumn("cell", F.lit(0))
    return pairs_in_cells(rows, None, threshold, id_col, layout, blocks or max(LEAST_BLOCKS, -(-fp.count() // TILE_ROWS)))


def candidate_pairs(fp: DataFrame, threshold: float, id_col: str, layout: tuple[int, int, float], count: int | None = None) -> DataFrame:
    """The same from cells around pivots, in which fewer rows meet."""
    rows = fp.count()
    pivots = choose_pivots(fp, count or min(64, max(8, round(rows**0.5 / 4))), id_col, layout)
    homes, outer = cells(fp, threshold, pivots, id_col, layout)
    return pairs_in_cells(homes, outer, threshold, id_col, layout)
