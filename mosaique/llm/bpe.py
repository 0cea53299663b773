"""BPE encoding with forced-boundary splitting, and decoding.

Two byte symbols that stand side by side in no token of the vocabulary are a certain cut: no merge can ever
cross it. Each word is cut there, the fragments are encoded independently, and their ids concatenated.

Cases: a null or empty text has no ids and decodes to the empty text, repeated rows each get a row, an empty
table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mosaique.llm.common import whole_text
from mosaique.llm.tokens import WordBpe, encoder, vocabulary


def encode(docs: DataFrame, model: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int)."""

    def batch_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(WordBpe, vocabulary(model))
        for batch in batches:
            for rows in range(0, batch.num_rows, 256):
                part = batch.slice(rows, 256)
                found = [own.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *[len(x) // 4 for x in found]]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(batch_ids, f"doc_id {kind}, ids array<int>")


def decode(ids: DataFrame, model: str = "word_bpe_49k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text, as the library decodes without skipping special tokens."""

    def batch_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(WordBpe, vocabulary(model))
        for batch in batches:
            texts = pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    kind = ids.select(id_col).schema[0].dataType.simpleString()
    return ids.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(batch_texts, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, keeping only digests."""

    def batch_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(WordBpe, vocabulary(model))
        for batch in batches:
            n, coded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(own.encode(text), "<u4").tolist()
                n.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(own.decimals.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(batch_digests, schema)
