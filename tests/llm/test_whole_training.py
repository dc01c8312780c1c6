"""The language model learns from every training document."""

from __future__ import annotations

from lumaframe.llm import language_model


def test_every_training_document_is_trained_on(spark, monkeypatch):
    seen = []

    def average(rows, real=language_model.average):
        mean, tokens = real(rows)
        seen.append(tokens)
        return mean, tokens

    monkeypatch.setattr(language_model, "average", average)
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 9))) for i in range(40)] + [(None, "no id here"), (3, None)]
    words = sum(len((t or "").split()) + 1 for _, t in rows)
    language_model.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), language_model.Vocabulary([(f"w{i}", 9) for i in range(23)] + [("\n", 42)], {}))
    assert sum(seen) == words
