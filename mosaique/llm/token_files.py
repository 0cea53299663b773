"""Token-id shards with a minimal perfect hash index.

A shard is one block of bytes, written through Spark's text sink (so that its commit protocol and every
file system it knows serve), little-endian throughout:

    magic "MQTOKS01" | u64 block bytes | u32 id width (2 or 4) | u64 documents | u64 ids
    | payload: the raw ids of the documents in ascending key order
    | per slot of the index: u32 fingerprint, u32 place in key order, u64 first id, u32 number of ids
    | index: u32 levels, then per level u64 seed, u64 bits, the bit words (u64), ranks per word (u32)
    | keys in order: i64 doc_id, u32 repeat (0 for the block's first row with that id; null ids are marked in it)

and ends with a line feed. The index (levels of collision-free bits, numbered by rank) maps each key to its
own slot in constant time; the stored fingerprint rejects keys that the shard does not hold, and the key
itself settles the rest. A directory with one row per block (first and last id, ids before it) leads to the block.

Texts are ranged by id before they are encoded: ranging ids instead would encode every text twice, once for the
sample that chooses the ranges. A file holds FILE_BLOCKS blocks at most, which bounds what a reader takes into memory.

Cases: a null or empty text holds only the end id, rows repeated with one id keep one entry each (told apart
by `repeat` within a block) in the order of their texts and may fill several tasks, null ids come first, an empty
table gives no blocks and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mosaique.llm.common import BROADCAST_ROWS, join_sized, whole_text
from mosaique.llm.tokens import ByteBpe, WordBpe, encoder, vocabulary
from mosaique.session import materialize

MAGIC = b"MQTOKS01"
_HEAD = struct.Struct("<8sQIQQ")
_SLOT = np.dtype([("print", "<u4"), ("place", "<u4"), ("first", "<u8"), ("n", "<u4")])
_KEY = np.dtype([("id", "<i8"), ("repeat", "<u4")])
#: A block is closed when its payload reaches this size.
BLOCK_BYTES = 32 << 20
#: Blocks in a file at most.
FILE_BLOCKS = 4
#: One in so many blocks begins a fence; keys meet the blocks of their fence only.
FENCE = 64
_NULL = 1 << 31


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(keys["id"].astype(np.uint64)) + _mix(keys["repeat"].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash: at each level the keys that are alone in their place take it, the rest go on."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]], n_bits: list[int]):
        self.levels, self.n_bits = levels, n_bits

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys have the same 64-bit hash")
        levels, sizes, left, before = [], [], hashes, 0
        while len(left):
            seed, bits = len(levels) + 1, max(64, -(-2 * len(left) // 64) * 64)
            at = _mix(left ^ _mix(np.array([seed], np.uint64))) % np.uint64(bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ranks = before + np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.uint32)
            levels.append((seed, words, ranks.astype("<u4")))
            sizes.append(bits)
            before += int(alone.sum())
            left = left[~alone[at.astype(np.int64)]]
        return cls(levels, sizes)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that no level has."""
        found = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for (seed, words, ranks), bits in zip(self.levels, self.n_bits, strict=True):
            at = _mix(hashes[open_] ^ _mix(np.array([seed], np.uint64))) % np.uint64(bits)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            found[open_[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return found

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<I", len(self.levels))]
        for (seed, words, ranks), bits in zip(self.levels, self.n_bits, strict=True):
            parts += [struct.pack("<QQ", seed, bits), words.astype("<u8").tobytes(), ranks.astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[PerfectHash, int]:
        (n,), levels, sizes = struct.unpack_from("<I", data, at), [], []
        at += 4
        for _ in range(n):
            seed, bits = struct.unpack_from("<QQ", data, at)
            at += 16
            words = np.frombuffer(data, "<u8", bits // 64, at)
            at += bits // 8
            ranks = np.frombuffer(data, "<u4", bits // 64, at)
            at += bits // 16
            levels.append((seed, words, ranks))
            sizes.append(bits)
        return cls(levels, sizes), at


def write_block(keys: np.ndarray, ids: list[bytes], width: int) -> bytes:
    """One block. `ids` holds each document's ids as little-endian bytes of `width` per id, in key order."""
    n = np.array([len(x) // width for x in ids], np.int64)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
    hashes = key_hash(keys)
    index = PerfectHash.build(hashes)
    slots = np.empty(len(keys), _SLOT)
    at = index.slots(hashes)
    for name, values in (("print", fingerprint(hashes)), ("place", np.arange(len(keys))), ("first", first), ("n", n)):
        slots[name][at] = values
    body = b"".join([*ids, slots.tobytes(), index.to_bytes(), keys.astype(_KEY).tobytes()])
    return _HEAD.pack(MAGIC, _HEAD.size + len(body), width, len(keys), int(n.sum())) + body


class Block:
    """A block that was read back."""

    def __init__(self, data: memoryview):
        magic, self.size, self.width, self.docs, self.total = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.payload = data[_HEAD.size : _HEAD.size + self.width * self.total]
        at = _HEAD.size + self.width * self.total
        self.slots = np.frombuffer(data, _SLOT, self.docs, at)
        self.index, at = PerfectHash.from_bytes(data, at + _SLOT.itemsize * self.docs)
        self.keys = np.frombuffer(data, _KEY, self.docs, at)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the block does not hold it."""
        if not self.docs:
            return np.full(len(keys), -1, np.int64)
        hashes = key_hash(keys)
        at = self.index.slots(hashes)
        safe = np.maximum(at, 0)
        good = (at >= 0) & (self.slots["print"][safe] == fingerprint(hashes)) & (self.keys[self.slots["place"][safe]] == keys.astype(_KEY))
        return np.where(good, at, -1)

    def ids(self, slot: int) -> np.ndarray:
        """The ids of one slot."""
        first, n = int(self.slots["first"][slot]), int(self.slots["n"][slot])
        return np.frombuffer(self.payload, f"<u{self.width}", n, first * self.width)


def blocks(data: bytes) -> Iterator[tuple[int, Block]]:
    """Offset and block for each block of a file."""
    view, at = memoryview(data), 0
    while at < len(view):
        block = Block(view[at:])
        yield at, block
        at += block.size + 1


def write_shards(docs: DataFrame, path: str, model: str = "byte_bpe_50k.json", end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write shards in ascending id order."""
    kind = WordBpe if model.startswith("word") else ByteBpe

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(kind, vocabulary(model))
        width = 2 if max(own.library.get_vocab_size(with_added_tokens=True), (end_id or 0) + 1) <= 1 << 16 else 4
        tail = b"" if end_id is None else end_id.to_bytes(width, "little")
        keys: list[tuple[int, int]] = []
        ids: list[bytes] = []
        size, last, repeat = 0, None, -1

        def block() -> pa.RecordBatch:
            data = write_block(np.array(keys, _KEY), ids, width)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                repeat = repeat + 1 if (doc_id,) == last else 0
                last = (doc_id,)
                raw = own.encode(text)
                ids.append((np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes() if width == 2 else raw) + tail)
                keys.append((doc_id or 0, repeat | (_NULL if doc_id is None else 0)))
                size += len(ids[-1])
                if size >= BLOCK_BYTES:
                    yield block()
                    keys, ids, size, last = [], [], 0, None
        if keys:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    # The hash of the text spreads an id with very many rows over several tasks.
    spread = F.xxhash64("text")
    rows = rows.repartitionByRange("doc_id", spread).sortWithinPartitions("doc_id", spread, "text")
    # The text sink writes the bytes of a value as they are; blocks are bytes, whatever the type is called.
    rows.mapInArrow(shard, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """One row per block: path, offset, n_docs, n_ids, first_id, last_id, start (ids of all blocks before it)."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, at, b.docs, b.total, int(b.keys["id"][0]), int(b.keys["id"][-1]), bool(b.keys["repeat"][0] & _NULL)) for at, b in blocks(data.as_buffer())]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                names = ["path", "offset", "n_docs", "n_ids", "first_id", "last_id", "has_null"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    schema = "path string, offset long, n_docs long, n_ids long, first_id long, last_id long, has_null boolean"
    order = Window.orderBy(F.desc("has_null"), "first_id", "path", "offset").rowsBetween(Window.unboundedPreceding, -1)
    return _files(spark, path).mapInArrow(heads, schema).withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, repeat, start, n_tokens, ids_crc32 of every document, looked up through the shards' indexes.

    Blocks give narrow rows with starts of their own; the directory (one row per block) is joined to those, so
    that neither payloads nor the directory pass through the driver.
    """
    starts = materialize(directory(spark, path).select("path", "offset", "start"), "directory")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, block in blocks(data.as_buffer()):
                    slot = block.find(block.keys)
                    crc = [zlib.crc32(block.ids(s).astype("<u4").tobytes()) for s in slot.tolist()]
                    null = (block.keys["repeat"] & _NULL) != 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.keys["id"].astype(np.int64), mask=null), pa.array((block.keys["repeat"] & (_NULL - 1)).astype(np.int64)), pa.array(block.slots["first"][slot].astype(np.int64)),
                         pa.array(block.slots["n"][slot].astype(np.int64)), pa.array(crc, pa.int64()), pa.array([name] * block.docs, pa.string()), pa.array([at] * block.docs, pa.int64())],
                        ["doc_id", "repeat", "first", "n_tokens", "ids_crc32", "path", "offset"],
                    )

    found = _files(spark, path).mapInArrow(rows, "doc_id long, repeat long, first long, n_tokens long, ids_crc32 long, path string, offset long")
    joined = join_sized(found, starts, ["path", "offset"], "inner")
    return joined.select("doc_id", "repeat", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def fences(blocks_table: DataFrame) -> list[int]:
    """Every FENCE-th first id in order: one number per FENCE blocks, some ten thousand for a hundred TB of texts."""
    ranged = blocks_table.filter("first_id is not null").select("first_id").repartitionByRange("first_id").sortWithinPartitions("first_id")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange(-at % FENCE, batch.num_rows, FENCE)))
            at += batch.num_rows

    return sorted({r[0] for r in ranged.mapInArrow(some, "first_id long").collect()})


def _fenced(rows: DataFrame, edges: list[int], low: str, high: str) -> DataFrame:
    """The rows with `fence`, once for each fence between the ids in `low` and `high`."""
    shared = rows.sparkSession.sparkContext.broadcast(np.array(edges, np.int64))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (np.searchsorted(shared.value, batch.column(batch.schema.get_field_index(c)).to_numpy(), "right") for c in (low, high))
            n = last - first + 1
            rows = np.repeat(np.arange(batch.num_rows), n)
            fence = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(fence.astype(np.int64))], [*batch.schema.names, "fence"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(number, f"{schema}, fence long")


def lookup(spark: SparkSession, path: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, repeat and ids (array of int) for the given ids; ids that no shard holds give no row.

    Keys and the directory's blocks are joined on fences, which cut the range of ids so that a key meets some FENCE
    blocks and takes those whose id range holds it; each file then answers its own keys through its indexes.
    """
    blocks_table = materialize(directory(spark, path).select("path", "first_id", "last_id"), "directory")
    edges = fences(blocks_table)
    wanted = keys.select(F.col(id_col).cast("long").alias("key")).filter("key is not null").distinct()
    wanted = materialize(_fenced(wanted, edges, "key", "key"), "keys")
    ranges = materialize(_fenced(blocks_table, edges, "first_id", "last_id"), "ranges")
    few = wanted.count() <= BROADCAST_ROWS
    routed = ranges.join(wanted.hint("broadcast" if few else "merge"), "fence").filter("key between first_id and last_id")
    asked = materialize(routed.groupBy("path").agg(F.array_sort(F.collect_set("key")).alias("keys")), "asked")

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ids in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                out: list[tuple[int, int, list[int]]] = []
                for _, block in blocks(data.as_buffer()):
                    repeat, left = 0, np.array(ids, np.int64)
                    while len(left):
                        ask = np.empty(len(left), _KEY)
                        ask["id"], ask["repeat"] = left, repeat
                        slot = block.find(ask)
                        out += [(int(k), repeat, block.ids(s).astype(np.int64).tolist()) for k, s in zip(left, slot, strict=True) if s >= 0]
                        left, repeat = left[slot >= 0], repeat + 1
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["doc_id", "repeat", "ids"])

    # Only the files that are asked are opened where these are few.
    files = _files(spark, path).join(asked.hint("broadcast" if few else "merge"), "path").select("content", "keys")
    return files.mapInArrow(answers, "doc_id long, repeat long, ids array<int>")
