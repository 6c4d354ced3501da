"""The pipeline's stages on nulls, empty and repeated rows, ties, empty tables and extra columns with clashing names."""

from __future__ import annotations

import corpus_pipeline as P
from conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, language string, place string, component_id long, kept boolean"
SAME = "the quick brown fox jumps over the lazy dog near the river bank and then it sleeps"
ROWS = [
    (1, SAME, "en", "a", 5, "l", "p", 1, True),
    (1, SAME, "en", "a", 5, "l", "p", 1, True),
    (1, SAME, "en", "b", 5, "l", "p", 1, True),
    (2, SAME, "en", "a", 5, None, None, None, None),
    (None, SAME, "en", "a", 5, None, None, None, None),
    (None, SAME, "en", "a", 5, None, None, None, None),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "a", 0, None, None, None, None),
    (5, "mail me at someone@example.com please, said the man to the other man", "en", None, 5, None, None, None, None),
]


def run(stage, spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = dict(P.STAGES)[stage](spark, docs, SF_SMALL)
    assert out.columns[: len(docs.columns)] == docs.columns
    return out.collect()


def test_stages_on_odd_rows(spark):
    assert all(r["text"] for r in run("language", spark, ROWS))
    left = run("near_duplicates", spark, ROWS)
    assert sorted((r["doc_id"] or 0) for r in left) == [0, 0, 1, 3, 4, 5]
    assert len(run("benchmark", spark, ROWS)) == len(ROWS)
    redacted = {r["doc_id"]: r for r in run("personal_data", spark, ROWS)}
    assert "[EMAIL]" in redacted[5]["text"] and redacted[5]["n_chars"] == len(redacted[5]["text"]) and redacted[3]["text"] is None and redacted[3]["n_chars"] is None
    assert run("mix", spark, ROWS)


def test_stages_on_an_empty_table(spark):
    for name, _ in P.STAGES:
        assert run(name, spark, []) == []
