"""The pipeline's stages on nulls, repeated rows, very long texts and columns named like the operators' own."""

import corpus_pipeline
from mosaique.session import materialize

NAMES = ["digest", "failed", "kept", "node", "unit", "v", "label", "words", "_gone_id", "_dedup_id", "piece", "length", "sequence_id", "offset", "start", "_c1", "n_words", "key"]


def test_stages_on_odd_documents(spark):
    long = " ".join(f"word{k % 9973} text{k % 7}" for k in range(30_000))
    body = "The committee met in the old hall on the first day of spring and talked about the river for hours"
    texts = [(1, body), (2, body.replace(" hall", "  hall")), (3, None), (4, ""), (5, long), (6, long + " end"), (7, f"{body} with Dr. Anna Novak at a.novak@mail.example.org"), (7, f"{body} with Dr. Anna Novak at a.novak@mail.example.org"), (None, "A text without an id that is long enough to count as a document here")]
    columns = ", ".join(f"`{n}` string" for n in NAMES)
    rows = [(d, t, "en", "web", len(t or ""), *(["x", None] * 9)) for d, t in texts]
    docs = materialize(spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {columns}"), "odd")
    columns_in = docs.columns
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), name)
        found[name] = sorted((r.doc_id or -1 for r in docs.collect()))
        if name != "packing":
            assert docs.columns == columns_in and all(r.v is None and r.digest == "x" for r in docs.collect())
        if name == "privacy":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert "novak" not in texts[7].lower() and texts[7].startswith(body) and texts[5] == long
    assert found["quality_rules"] == [-1, 1, 2, 5, 6, 7, 7] and found["exact_dedup"] in ([-1, 2, 5, 6, 7], [-1, 1, 5, 6, 7])
    assert found["near_dedup"] == sorted(set(found["exact_dedup"]) - {6}) and set(found["packing"]) == set(found["privacy"])
