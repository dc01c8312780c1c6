"""Rows that share a doc_id but not a text, repeated labels, items without a name, and columns named as the operators' own."""

from __future__ import annotations

import pytest

from lumaframe.llm import decontamination, line_dedup, minhash, mixing, quality_rules, suffix_dedup, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PASSAGE = " ".join(f"word{i}" for i in range(80))
OTHER = " ".join(f"öther{i}" for i in range(120))


@pytest.fixture(scope="module")
def shared(spark):
    rows = [(1, PASSAGE), (5, f"{PASSAGE} tail of the first"), (5, OTHER), (5, OTHER), (7, OTHER), (None, "short")]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)


def test_lines_of_unlike_rows(shared):
    got = {(r.doc_id, r.n_words): r for r in line_dedup.dedup(shared).collect()}
    assert got[5, 84].n_removed > 60
    assert got[5, 120].n_removed == 0 and got[5, 120].kept == OTHER
    assert got[7, 120].n_removed > 100


def test_bytes_of_unlike_rows(shared):
    rows = [(r.doc_id, r.n_bytes, bytes(r.kept).decode()) for r in suffix_dedup.dedup(shared).collect()]
    assert [k for i, n, k in rows if i == 5 and n == len(OTHER.encode())] == [OTHER, OTHER]
    assert next(k for i, n, k in rows if i == 5 and n == len(f"{PASSAGE} tail of the first")) == " tail of the first"
    assert next(k for i, _, k in rows if i == 7) == ""


def test_labels_count_once(spark):
    words = ["awful", "vile", "nice", "calm", "grey", "blue"]
    docs = spark.createDataFrame([(i, " ".join(words[(i * 7 + j) % 6] if j % 3 else words[(i % 2) * 3] for j in range(40)), "en", "s", 0) for i in range(200)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id bigint, quality int, toxic int")
    one = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    two = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels.unionByName(labels).unionByName(labels.limit(0))).collect()}
    assert one == two


def test_item_without_a_name(spark, shared):
    items = spark.createDataFrame([(None, PASSAGE), (3, OTHER), (3, "öther1 öther2")], "item_id bigint, text string")
    got = {(r.doc_id, r.n_words): r for r in decontamination.contamination(shared, items).collect()}
    assert got[1, 80].contaminated and got[1, 80]["items"] == []
    assert got[7, 120]["items"] == ["3"]


def test_reserved_columns_survive(spark, shared):
    from pyspark.sql import functions as F

    own = {n: F.lit(f"mine {n}") for n in ("_row_key", "_node", "_text_hash", "_key", "_total", "_times", "_copy", "_n")}
    docs = shared.withColumns(own)
    bench = spark.createDataFrame([(1, "not in there at all")], "item_id bigint, text string")
    for kept in (decontamination.filter_documents(docs, bench), minhash.filter_documents(docs), quality_rules.filter_documents(docs), mixing.apply_mix(docs)):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[n] == f"mine {n}" for r in rows for n in own)


def test_bytes_with_more_keys_than_are_sent(shared, monkeypatch):
    few = sorted((r.doc_id or 0, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.dedup(shared).collect())
    monkeypatch.setattr(suffix_dedup, "SENT", 0)
    assert sorted((r.doc_id or 0, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.dedup(shared).collect()) == few
