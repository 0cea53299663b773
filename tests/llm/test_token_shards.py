"""Shards with many blocks: ids that fill several tasks, bounded files, look-ups over fences."""

import numpy as np

from mosaique.llm import token_files
from mosaique.session import materialize, shared_path


def test_an_id_with_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 200)
    monkeypatch.setattr(token_files, "FILE_BLOCKS", 2)
    monkeypatch.setattr(token_files, "FENCE", 2)
    rows = [(7, f"text number {k} of one id") for k in range(300)] + [(k, f"row {k}") for k in range(100, 200)] + [(None, "no id"), (7, "text number 3 of one id")]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string"), "many")
    path = shared_path(spark, "many")
    token_files.write_shards(docs, path)
    read = token_files.read_documents(spark, path).orderBy("start").collect()
    assert len(read) == len(rows) and [r.start for r in read] == np.cumsum([0, *[r.n_tokens for r in read]])[:-1].tolist()
    ids = [r.doc_id for r in read]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    assert token_files.directory(spark, path).groupBy("path").count().agg({"count": "max"}).first()[0] <= 2
    own = token_files.encoder(token_files.ByteBpe, token_files.vocabulary("byte_bpe_50k.json"))
    want = sorted([*np.frombuffer(own.encode(t), "<u4").tolist(), 2] for i, t in rows if i in (7, 111, 199))
    found = token_files.lookup(spark, path, spark.createDataFrame([(7,), (111,), (199,), (500,), (-3,), (7,)], "doc_id long"))
    assert sorted(r.ids for r in found.collect()) == want


def test_equal_ids_come_in_the_order_of_their_texts(spark):
    rows = [(1, t) for t in "zyxabc"]
    digests = set()
    for order in (rows, rows[::-1]):
        path = shared_path(spark, "order")
        token_files.write_shards(materialize(spark.createDataFrame(order, "doc_id long, text string").repartition(3), "order"), path)
        digests.add(tuple(r.ids_crc32 for r in token_files.read_documents(spark, path).orderBy("start").collect()))
    assert len(digests) == 1
