"""Near-duplicates where rows share a doc_id and differ in text."""

from __future__ import annotations

from lumaframe.llm import minhash


def test_unlike_texts_of_one_id_stay(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(100)) for k in "abc")
    near = lambda text: text.replace("50", "changed")
    rows = [(1, a), (1, b), (1, a), (2, near(a)), (3, near(b)), (4, c), (None, b), (5, ""), (5, None), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = sorted((r.doc_id is not None, r.doc_id, r.text or "") for r in minhash.filter_documents(docs.where("doc_id IS NOT NULL")).collect())
    assert kept == [(True, 1, a), (True, 1, b), (True, 4, c), (True, 5, ""), (True, 5, " ")]
    found = minhash.classes(docs.where("doc_id IS NOT NULL")).collect()
    assert len(found) == 9 and sorted({(r.doc_id, r.class_id) for r in found}) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    assert len({r.stays for r in found}) == 5
