"""Rasters as array blocks with borders: stencils of any reach with one row a pixel shuffled, whatever the reach.

1. The pixels of a picture are gathered into square blocks (one row a pixel, shuffled once).
2. Each block sends copies of its borders to its eight neighbours at most: rows a block, not a pixel.
3. A block with its borders is one array with a mask; a kernel is applied inside it, as one sum over shifted arrays.

Blocks are at least as wide as the kernel reaches, so that only direct neighbours count. Places without a pixel are masked:
a result needs its own pixel and all that the kernel asks for, where edges repeat if `clamp` is set. A null value counts 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ID = "image_id"
#: Side of a block where the kernel's reach allows it.
SIDE = 64
_AROUND = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1)]
#: Bytes of blocks in an Arrow batch, about, and the bounds of its rows.
BATCH_BYTES, LEAST_ROWS, MOST_ROWS = 1 << 25, 64, 1_000

#: (values, known) with borders -> name -> (values, known) of the block itself.
Kernel = Callable[[np.ndarray, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]


def _from(side: int, reach: int, d: int) -> slice:
    """Rows or columns of a block that its neighbour in direction d needs."""
    return slice(0, side) if d == 0 else slice(side - reach, side) if d > 0 else slice(0, reach)


def _to(side: int, reach: int, d: int) -> int:
    """Where a block's array with borders holds what came in direction d."""
    return reach if d == 0 else 0 if d > 0 else reach + side


def _bound_batches(spark: SparkSession, side: int, reach: int) -> None:
    """Bound what a Python worker holds at once, unless the session has chosen a smaller bound itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = min(MOST_ROWS, max(LEAST_ROWS, BATCH_BYTES // (9 * (side + 2 * reach) ** 2)))
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def on_blocks(pixels: DataFrame, channel: str, reach: int, kernel: Kernel, names: list[str], clamp: bool = False, side: int = SIDE) -> DataFrame:
    """image_id, x, y and the named results (double) of a kernel that looks `reach` pixels around."""
    side = max(side, reach)
    _bound_batches(pixels.sparkSession, side, reach)
    id_type = pixels.schema[ID].dataType
    tall = lambda c: F.floor(F.col(c) / side).cast("int")
    blocks = pixels.withColumns({"_bx": tall("x"), "_by": tall("y")}).groupBy(ID, "_bx", "_by").agg(
        F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.coalesce(F.col(channel).cast("double"), F.lit(0.0)).alias("v"))).alias("_p"),
        F.max("x").alias("_mx"), F.max("y").alias("_my"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block's own array, and its borders addressed to the neighbours that are inside the table's quarter plane."""
        for batch in batches:
            for r in range(batch.num_rows):
                bx, by, mx, my = (batch.column(c)[r].as_py() for c in (1, 2, 4, 5))
                x, y, v = (f.to_numpy() for f in batch.column(3)[r].values.flatten())
                # Only as much of the block as its pixels take up.
                shape = (my - by * side + 1, mx - bx * side + 1)
                values, known = np.zeros(shape), np.zeros(shape, np.uint8)
                values[y - by * side, x - bx * side] = v
                known[y - by * side, x - bx * side] = 1
                parts = {(i, j): (_from(side, reach, j), _from(side, reach, i)) for i, j in _AROUND if reach or (i, j) == (0, 0)}
                parts = {d: at for d, at in parts.items() if d == (0, 0) or known[at].any()}
                ints = [[bx + i for i, _ in parts], [by + j for _, j in parts], [i for i, _ in parts], [j for _, j in parts], [values[at].shape[1] for at in parts.values()], [mx] * len(parts), [my] * len(parts)]
                arrays = [pa.array([part[at].tobytes() for at in parts.values()], pa.binary()) for part in (values, known)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[r].as_py()] * len(parts), batch.schema.field(0).type), *[pa.array(c, pa.int32()) for c in ints], *arrays], [ID, "bx", "by", "i", "j", "w", "mx", "my", "values", "known"])

    ints = [T.StructField(n, T.IntegerType()) for n in ("bx", "by", "i", "j", "w", "mx", "my")]
    schema = T.StructType([T.StructField(ID, id_type), *ints, T.StructField("values", T.BinaryType()), T.StructField("known", T.BinaryType())])
    sent = blocks.select(ID, "_bx", "_by", "_p", F.col("_mx").cast("int"), F.col("_my").cast("int")).mapInArrow(cut, schema)
    whole = sent.groupBy(ID, "bx", "by").agg(F.collect_list(F.struct("i", "j", "w", "values", "known")).alias("parts"))
    # Borders that were sent beyond the picture meet no block of their own.
    whole = whole.filter(F.exists("parts", lambda p: (p["i"] == 0) & (p["j"] == 0)))
    if clamp:
        size = blocks.groupBy(F.col(ID).alias("_id")).agg(F.max("_mx").cast("int").alias("mx"), F.max("_my").cast("int").alias("my"))
        whole = whole.join(size.hint("merge"), F.col(ID) == F.col("_id")).select(ID, "bx", "by", "parts", "mx", "my")
    else:
        whole = whole.select(ID, "bx", "by", "parts", F.lit(None).cast("int").alias("mx"), F.lit(None).cast("int").alias("my"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                bx, by, mx, my = (batch.column(c)[r].as_py() for c in (1, 2, 4, 5))
                parts = batch.column(3)[r].as_py()
                # As high and wide as its pixels and those above and beside them, or as the block where a neighbour follows.
                wide = side if any(p["i"] < 0 for p in parts) else max(p["w"] for p in parts if p["i"] == 0)
                high = side if any(p["j"] < 0 for p in parts) else max(len(p["known"]) // p["w"] for p in parts if p["j"] == 0)
                values, known = np.zeros((high + 2 * reach, wide + 2 * reach)), np.zeros((high + 2 * reach, wide + 2 * reach), bool)
                for p in parts:
                    there = np.frombuffer(p["known"], np.uint8).reshape(-1, p["w"])
                    y, x = _to(side, reach, p["j"]), _to(side, reach, p["i"])
                    values[y : y + there.shape[0], x : x + there.shape[1]] = np.frombuffer(p["values"], float).reshape(there.shape)
                    known[y : y + there.shape[0], x : x + there.shape[1]] = there
                own = known[reach : reach + high, reach : reach + wide].copy()
                if clamp:
                    # What lies beyond the picture repeats its edge.
                    beside = lambda b, n, m: np.clip(np.arange(b * side - reach, b * side + n + reach), 0, m) - (b * side - reach)
                    ys, xs = np.clip(beside(by, high, my), 0, high + 2 * reach - 1), np.clip(beside(bx, wide, mx), 0, wide + 2 * reach - 1)
                    values, known = values[np.ix_(ys, xs)], known[np.ix_(ys, xs)]
                found = kernel(values, known)
                for _, there in found.values():
                    own &= there
                y, x = np.nonzero(own)
                ids = pa.array([batch.column(0)[r].as_py()] * len(y), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array((x + bx * side).astype(np.int32)), pa.array((y + by * side).astype(np.int32)), *[pa.array(found[n][0][y, x]) for n in names]], [ID, "x", "y", *names])

    schema = T.StructType([T.StructField(ID, id_type), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    return whole.mapInArrow(apply, schema)


def weighted(weights: dict[str, dict[tuple[int, int], float]], reach: int) -> Kernel:
    """Per name the sum of weight * value over (dx, dy) places, known where all places of all kernels are."""
    places = {at for found in weights.values() for at in found}

    def kernel(values: np.ndarray, known: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        height, width = (n - 2 * reach for n in values.shape)
        at = lambda dx, dy: (slice(reach + dy, reach + dy + height), slice(reach + dx, reach + dx + width))
        there = np.ones((height, width), bool)
        for place in places:
            there &= known[at(*place)]
        return {name: (sum(w * values[at(*place)] for place, w in found.items()), there) for name, found in weights.items()}

    return kernel


def separable(weights: np.ndarray, reach: int, name: str) -> Kernel:
    """One row of 2 * reach + 1 weights along x, then along y. Masked places count 0."""

    def along(values: np.ndarray) -> np.ndarray:
        """Weighted sums over runs of each row."""
        return np.lib.stride_tricks.sliding_window_view(values, 2 * reach + 1, axis=1) @ weights

    def kernel(values: np.ndarray, known: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = along(np.ascontiguousarray(along(values).T)).T
        return {name: (out, np.ones(out.shape, bool))}

    return kernel
