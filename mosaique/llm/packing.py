"""Best-fit packing by linear grouping.

1. Texts are encoded and cut into pieces of at most `capacity` ids. Only (id, piece, start, length, crc)
   of each piece is written; the rest works on these narrow rows.
2. The histogram of piece lengths (at most `capacity` rows, however many pieces there are) goes to the
   driver. Large lengths are sorted and split into groups of equal cardinality, each rounded up to
   its largest length. The few sizes are packed by a configuration linear programme (column generation).
3. Its whole bins take actual pieces in place of the rounded ones, and what is left over (remainders of the
   programme and small pieces, longest first) goes by best fit into the smallest gap that takes it.
   All of this is done on runs of equal bins, so that the plan has a size bounded by `capacity`.
4. The plan is broadcast; each piece finds its place from its length and its rank among the pieces of that
   length. Ranks are numbered within (length, salt), so that one common length never meets in one task.

Cases: a null or empty text is a piece with the end id alone, repeated rows are packed each, an empty table
gives an empty result, other columns are ignored. Only texts above the capacity are cut.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mosaique.llm.common import whole_text
from mosaique.llm.tokens import ByteBpe, WordBpe, encoder, vocabulary
from mosaique.session import materialize

CAPACITY = 4096
#: Numbers of groups that are tried until the bins are within GOOD of the lower bound (all ids by capacity).
GROUPS = (16, 64, 128)
GOOD = 0.002
#: A length above capacity / LARGE is large.
LARGE = 8
#: The programme stops when its value is within this share of the best.
GAP = 0.001
#: Pieces of one length that are ranked in one group, about.
RANKED_TOGETHER = 50_000


def pieces(docs: DataFrame, model: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece."""
    kind = WordBpe if model.startswith("word") else ByteBpe
    tail = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(kind, vocabulary(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    data = own.encode(text) + tail
                    for p, first in enumerate(range(0, len(data), 4 * capacity)):
                        chunk = data[first : first + 4 * capacity]
                        row.append(k)
                        piece.append(p)
                        start.append(first // 4)
                        length.append(len(chunk) // 4)
                        crc.append(zlib.crc32(chunk))
                        if with_ids:
                            ids.append(chunk)
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {docs.select(id_col).schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(cut, schema)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """The linear programme: how often to use each way of filling a bin, so that every size is packed.

    Column generation: start with bins of one size, and add the filling with the best price until none pays.
    """
    m, need = len(sizes), np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    most = capacity // min(sizes)
    for _ in range(40 * m + 200):
        price = np.maximum(np.linalg.solve(basis.T, np.ones(m)), 0)
        best = np.zeros((most + 1, capacity + 1))
        pick = np.full((most + 1, capacity + 1), -1, int)
        for layer in range(1, most + 1):
            best[layer] = best[layer - 1]
            for i, s in enumerate(sizes):
                value = best[layer - 1, : capacity + 1 - s] + price[i]
                better = value > best[layer, s:] + 1e-12
                best[layer, s:][better] = value[better]
                pick[layer, s:][better] = i
        if best[most, capacity] <= 1 + GAP:
            break
        column, room = np.zeros(m), capacity
        for layer in range(most, 0, -1):
            if (i := pick[layer, room]) >= 0:
                column[i] += 1
                room -= sizes[i]
        along, now = np.linalg.solve(basis, column), np.linalg.solve(basis, need)
        ratios = np.where(along > 1e-9, np.maximum(now, 0) / np.maximum(along, 1e-9), np.inf)
        basis[:, int(np.argmin(ratios))] = column
    amount = np.linalg.solve(basis, need)
    return [(basis[:, k].astype(int).tolist(), float(amount[k])) for k in range(m) if amount[k] > 0]


class _Gaps:
    """Runs of bins by the room that is left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.open, self.bins = capacity, {}, [], 0

    def add(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in self.runs:
                self.runs[room] = []
                bisect.insort(self.open, room)
            self.runs[room].append((first, count))

    def take(self, length: int, count: int) -> tuple[int, int, int]:
        """Room, first bin and number of bins of the tightest run that takes `length`; new bins if none does."""
        at = bisect.bisect_left(self.open, length)
        if at == len(self.open):
            fresh = -(-count // (self.capacity // length))
            self.bins += fresh
            return self.capacity, self.bins - fresh, fresh
        room = self.open[at]
        first, n = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            self.open.pop(at)
        return room, first, n


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The plan with the fewest bins among the numbers of groups in GROUPS."""
    bound = -(-sum(length * n for length, n in histogram.items()) // capacity)
    best = None
    for groups in GROUPS:
        found = plan(histogram, capacity, groups)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] <= (1 + GOOD) * bound:
            break
    return best


def plan(histogram: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, one past the last, first bin, pieces per bin, offset) and the number of bins.

    The piece of a length with rank r in such a row goes to bin first + (r - first rank) // per bin.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps, used = _Gaps(capacity), dict.fromkeys(histogram, 0)
    large = sorted((n for n in histogram if capacity // LARGE < n < capacity), reverse=True)
    if histogram.get(capacity):
        rows.append((capacity, 0, histogram[capacity], 0, 1, 0))
        used[capacity], gaps.bins = histogram[capacity], histogram[capacity]
    total = sum(histogram[n] for n in large)
    if total:
        # A group is a list of (length, first rank, count), longest first; its size is its first length.
        group_of: list[list[list[int]]] = [[]]
        left = per_group = -(-total // groups)
        for length in large:
            rank, count = 0, histogram[length]
            while count:
                if not left:
                    group_of.append([])
                    left = per_group
                took = min(left, count)
                group_of[-1].append([length, rank, took])
                rank, count, left = rank + took, count - took, left - took
        merged: dict[int, list[list[int]]] = {}
        for runs in group_of:
            merged.setdefault(runs[0][0], []).extend(runs)
        sizes = list(merged)
        demand = [sum(r[2] for r in merged[s]) for s in sizes]
        for column, amount in configurations(sizes, demand, capacity):
            bins = int(amount + 1e-6)
            bins = min([bins, *(sum(r[2] for r in merged[s]) // a for s, a in zip(sizes, column, strict=True) if a)])
            if bins <= 0:
                continue
            first, gaps.bins = gaps.bins, gaps.bins + bins
            slots = []  # one list of runs per place in the bin
            for s, a in zip(sizes, column, strict=True):
                for _ in range(a):
                    slot, need = [], bins
                    while need:
                        run = merged[s][0]
                        took = min(need, run[2])
                        slot.append((run[0], run[1], took))
                        run[1], run[2], need = run[1] + took, run[2] - took, need - took
                        if not run[2]:
                            merged[s].pop(0)
                    slots.append(slot)
            _fill(rows, gaps, slots, first, capacity)
        rest = [tuple(r) for runs in merged.values() for r in runs if r[2]]
    else:
        rest = []
    rest += [(n, 0, c) for n, c in histogram.items() if n <= capacity // LARGE and n < capacity and c]
    for length, rank, count in sorted(rest, reverse=True):
        while count:
            room, first, bins = gaps.take(length, count)
            per_bin = room // length
            full = min(bins, count // per_bin)
            if full:
                rows.append((length, rank, rank + full * per_bin, first, per_bin, capacity - room))
                gaps.add(room - per_bin * length, first, full)
                rank, count = rank + full * per_bin, count - full * per_bin
            at, bins = first + full, bins - full
            if bins and 0 < count < per_bin:
                rows.append((length, rank, rank + count, at, per_bin, capacity - room))
                gaps.add(room - count * length, at, 1)
                rank, count, at, bins = rank + count, 0, at + 1, bins - 1
            gaps.add(room, at, bins)
    return rows, gaps.bins


def _fill(rows: list, gaps: _Gaps, slots: list[list[tuple[int, int, int]]], first: int, capacity: int) -> None:
    """Put actual runs into the places of equal bins; bins with the same lengths form a run of gaps."""
    edges = sorted({0, *(int(x) for slot in slots for x in np.cumsum([r[2] for r in slot]))})
    at = [0] * len(slots)
    done = [0] * len(slots)
    for low, high in zip(edges, edges[1:], strict=False):
        offset = 0
        for k, slot in enumerate(slots):
            length, rank, count = slot[at[k]]
            rows.append((length, rank + done[k], rank + done[k] + high - low, first + low, 1, offset))
            offset += length
            done[k] += high - low
            if done[k] == count:
                at[k], done[k] = at[k] + 1, 0
        gaps.add(capacity - offset, first + low, high - low)


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `table` (which has doc_id, piece, start, length, ids_crc32 and is read from storage) with sequence_id and offset."""
    spark = table.sparkSession
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, _ = best_plan(histogram, capacity)
    names = ["_length", "_low", "_high", "_bin", "_per_bin", "_offset"]
    plan_rows = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    # A length with many pieces is ranked in parts of about RANKED_TOGETHER; its number of parts follows its own count.
    parts = spark.createDataFrame([(length, -(-n // RANKED_TOGETHER)) for length, n in histogram.items()], "_salted long, _salts long")
    salted = table.join(F.broadcast(parts), F.col("length") == F.col("_salted")).drop("_salted")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_salts"))).drop("_salts")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    base = base.withColumnRenamed("length", "_base_length").withColumnRenamed("_salt", "_base_salt")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1)
    ranked = ranked.join(base.hint("merge"), (F.col("length") == F.col("_base_length")) & (F.col("_salt") == F.col("_base_salt")))
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base"))
    found = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    placed = ranked.join(F.broadcast(plan_rows), found)
    k = F.col("_rank") - F.col("_low")
    return placed.select(
        *table.columns,
        (F.col("_bin") + F.expr("(_rank - _low) div _per_bin")).alias("sequence_id"),
        (F.col("_offset") + F.pmod(k, F.col("_per_bin")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, model: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(materialize(pieces(docs, model, end_id, capacity, id_col, text_col), "pieces"), capacity)


def sequences(docs: DataFrame, model: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id and ids (little-endian unsigned 32-bit bytes), at most `capacity` ids each."""
    placed = pack(materialize(pieces(docs, model, end_id, capacity, id_col, text_col, with_ids=True), "pieces"), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
