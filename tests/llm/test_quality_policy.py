"""The corpus policy keeps long texts and texts without spaces between words, by the ledger's mask."""

from mosaique.llm import quality


def test_corpus_policy_keeps_texts_without_spaces(spark):
    chinese = "\n".join(f"这是一段没有空格的中文文字它的内容很干净第{k}段讲述不同的事情" for k in "一二三四五六七八九十甲乙")
    docs = spark.createDataFrame([(1, chinese, 7), (2, "too short", 8), (3, None, 9)], "doc_id long, text string, failed long")
    assert [tuple(r) for r in quality.keep_good(docs).collect()] == [(1, chinese, 7)]
    assert quality.keep_good(docs, "web@1").count() == 0
    assert quality.measure("w " * 1_000_001)[0] > 1_000_000 and "many_words" not in quality.POLICIES[quality.CORPUS]
    table = quality.apply_policy(quality.ledger(docs), quality.CORPUS)
    assert [r.doc_id for r in table.filter("kept").collect()] == [1]
