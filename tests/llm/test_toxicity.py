"""Toxicity: features against plain Python, lexicons without the own fold, held-out accuracy, odd inputs."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vatloom.llm import toxicity as M
from vatloom.llm.common import table

LARGE = "/root/testdata/sf0.1"


def plainly(text, weights):
    """Features of one text, word by word."""
    text = text or ""
    tokens, words = text.split(), []
    for t in tokens:
        core = re.sub(r"^[\W\d_]+|[\W\d_]+$", "", t.lower())
        odd = bool(re.search(r"[^\W\d_][\W\d_]+[^\W\d_]", t.lower()))
        form = "".join(c for c in t.lower().translate(M._LEET) if c.isalpha()) if odd else core
        tail = re.split(r"[\W\d_]", core)[-1] if odd else ""
        weigh = lambda w: max([0.0, *(weights.get(w[:n], 0.0) for n in M.LENGTHS if w), weights.get(w + "$", 0.0)])  # noqa: E731, B023
        words.append((form, max(weigh(form), weigh(tail)), form in M.GIVEN or tail in M.GIVEN, odd, t == t.upper() and len(core) >= 3, len(core) == 1))
    n = max(1, sum(1 for w in words if w[0]))
    hit = [g or x >= M.LEARNED for _, x, g, *_ in words]
    strong = [g or x >= M.STRONG for _, x, g, *_ in words]
    you = [w[0] in M.SECOND_PERSON for w in words]
    places = [i for i, h in enumerate(hit) if h]
    ascii_letters = [c for c in text if c.isascii() and c.isalpha()]
    size = max(1, len(text.encode()))
    raw = text.encode().decode("latin-1")
    alpha = lambda c: c.isascii() and c.isalpha()
    return {
        "given": sum(w[2] for w in words) / n, "learned": sum(hit) / n, "strong": sum(strong) / n, "mean_weight": sum(w[1] for w in words) / n,
        "strong_count": math.log1p(sum(strong)), "strong_distinct": math.log1p(len({t for t, s in zip(tokens, strong) if s})),
        "densest": max([0.0, *(sum(hit[i : i + M.WINDOW]) / M.WINDOW for i in places)]),
        "near_second_person": sum(any(you[max(0, i - M.NEAR) : i + M.NEAR + 1]) for i in places) / n, "second_person": sum(you) / n,
        "capitals": sum(c.isupper() for c in ascii_letters) / max(1, len(ascii_letters)), "shouted": sum(w[4] for w in words) / n,
        "exclamations": text.count("!") / size, "punctuation": sum(c.isascii() and c.isprintable() and not c.isalnum() and c not in "! " for c in text) / size,
        "obfuscated": sum(w[3] for w in words) / n, "obfuscated_hits": sum(w[3] and h for w, h in zip(words, hit)) / n,
        "stretched": sum(alpha(raw[i]) and raw[i] == raw[i - 1] == raw[i - 2] for i in range(2, len(raw))) / size,
        "single_letters": sum(w[5] for w in words) / n, "words": math.log1p(sum(1 for w in words if w[0])),
    }


TEXTS = [
    None, "", " \n ", "...", "You IDIOT!!!", "i d i o t", "1d10t you m0ron st*pid", "l'idiot vous", "loweia loweischaft und dich", "soooo baaad", "a-b c_d", "é É ÉÉÉ ABC",
    "you " + "x " * 4 + "idiot " + "y " * 5 + "idiot", "scum " * 90, "idiot", "### you%%% idiot$$$", "I.D.I.O.T", "You're a fool, you fool", "ß Straße idiot",
]
WEIGHTS = {"lowei": 4.0, "bad$": 2.0, "mor": 1.5, "soo": 0.5, "baa": 2.5}


def test_features_word_by_word():
    got = M.features(pa.array(TEXTS, pa.string()), M.Lexicon(WEIGHTS))
    for text, row in zip(TEXTS, got):
        wanted = plainly(text, WEIGHTS)
        assert {k: pytest.approx(v) for k, v in wanted.items()} == dict(zip(M.FEATURES, row)), text


def test_a_block_gives_what_each_text_gives():
    lexicon = M.Lexicon(WEIGHTS)
    together = M.features(pa.array(TEXTS, pa.string()), lexicon)
    alone = np.concatenate([M.features(pa.array([t], pa.string()), lexicon) for t in TEXTS])
    assert np.allclose(together, alone)


def test_lexicons_count_documents_without_the_own_fold(spark):
    rows = [(f"zork{i % 3} zork zork plain", i % 3, 1) for i in range(12)] + [("plain words here", i % 3, 0) for i in range(12)]
    rows += [("onlyzero onlyzero", 0, 1)] * 4
    learned = M.lexicons(spark.createDataFrame(rows, "text string, fold int, toxic int"), support=3)
    have = [set(x.terms.to_pylist()) for x in learned]
    assert all({"zor", "zork", "zork$"} <= h and "plain$" not in h for h in have)
    assert "onlyzero$" not in have[0] and "onlyzero$" in have[1] and "onlyzero$" in have[3]
    all_of = dict(zip(learned[-1].terms.to_pylist(), learned[-1].weights))
    assert all_of["zork$"] == pytest.approx(math.log(12.5 / 17) - math.log(0.5 / 13))


def test_held_out_rows(spark):
    got = M.op11_toxicity(spark, LARGE)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and dict(got.dtypes)["predicted"] == "int"
    r = got.agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum(F.col("score").isNull().cast("int")).alias("nulls")).first()
    assert r.n == table(spark, LARGE, "documents").count() and 0 <= r.lo <= r.hi <= 1 and r.nulls == 0
    held = got.where("held_out").join(table(spark, LARGE, "labels").select("doc_id", "toxic"), "doc_id")
    share = {x.toxic: x.p for x in held.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert share[1] >= 0.9 and share[0] <= 0.01


def _tables(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, score string, features string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return M.op11_toxicity(spark, str(path))


@pytest.mark.parametrize(("labels", "share"), [([], 0.0), ([(i, 0) for i in range(40)], 0.0), ([(i, 1) for i in range(40)], 1.0), ([(i, None) for i in range(40)] + [(None, 1)], 0.0)])
def test_no_labels_or_one_class(spark, tmp_path, labels, share):
    got = _tables(spark, tmp_path, [(i, f"text {i}", "", "") for i in range(40)], labels)
    assert {r.score for r in got.collect()} == {share} and got.count() == 40


def test_odd_rows(spark, tmp_path):
    long_text = "plain words " * 400_000 + "idiot you idiot"
    docs = [(i, f"you {'idiot' if i % 2 else 'friend'} number {'abcdefghij'[i % 10]} {i}", "s", "f") for i in range(200)]
    docs += [(500, None, "", ""), (501, "", "", ""), (None, "you idiot", "", ""), (502, long_text, "", ""), (1, docs[1][1], "", "")]
    got = _tables(spark, tmp_path, docs, [(i, i % 2) for i in range(200)] + [(3, 0), (9999, 1), (5, None)])
    rows = got.collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert sum(by[i].predicted == i % 2 for i in range(200)) >= 190
    assert by[None].predicted == 1 and by[500].score == by[501].score


def test_empty_tables(spark, tmp_path):
    assert _tables(spark, tmp_path, [], []).count() == 0


def test_extra_columns_with_the_same_names_stay(spark):
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else f"fine text {i}", "f", "p", "r") for i in range(80)], "doc_id long, text string, features string, probability string, raw string")
    model = M.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")), trees=3)
    out = model.score(docs)
    assert out.columns == [*docs.columns, "score"] and {(r.features, r.probability, r.raw) for r in out.collect()} == {("f", "p", "r")}
