"""What the plans of the training-data operators hold, and what they don't."""

from __future__ import annotations

import re

import pytest

from lumaframe.llm import components, language_model, mixing, quality_rules
from lumaframe.llm.common import top_rows

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quality_is_native(spark):
    measured = quality_rules.measure(spark.read.parquet(f"{SF}/documents.parquet"))
    assert not re.search("Python|Pandas|Arrow", plan_of(measured))
    assert "Exchange" not in plan_of(measured)


def test_scans_are_pruned(spark):
    sizes = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", mixing.words(mixing.F.col("text")).alias("size"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(sizes)


def test_top_rows(spark):
    df = spark.range(1, 1001).selectExpr("id", "cast(id as double) AS score")
    top, least = top_rows(df, "score", 100)
    rows = [r.id for r in top.collect()]
    assert 80 <= len(rows) <= 100 and sorted(rows) == list(range(1001 - len(rows), 1001)) and least == min(rows)
    assert top_rows(df.limit(0), "score", 10)[0].count() == 0
    assert top_rows(df, "score", 5000)[0].count() == 1000


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 52), (7, 7)]])
def test_components(spark, links):
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in links:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert found == want


def test_words_keep_their_class():
    voc = language_model.Vocabulary([(f"w{i}", 3000 - i) for i in range(1500)] + [("\n", 40)], {})
    assert voc.of("w0") == 0 and voc.of("\n") < language_model.FREQUENT
    assert voc.of("w1400") // language_model.CLASS_WORDS >= voc.own_classes + language_model.KINDS
    assert voc.of("unheard") // language_model.CLASS_WORDS == voc.own_classes + language_model.kind_of("unheard")
