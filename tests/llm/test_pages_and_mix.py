"""Main text, preference pairs, mixing, the SQL of the operators, and the pipeline."""

from __future__ import annotations

import pytest
from conftest import SF, SF_SMALL, same_rows
from test_brute_force import base_spans, lowered, near_duplicates

from vatloom.llm import html_text, langid, mixing, preference, registry

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a> The Daily</header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-banner"><p>We use cookies.</p><button>OK</button></div>
<article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b>&nbsp;and a <a href="/x">link</a>
over lines.</p><div class="ad"><p>Buy now and save.</p></div><p>Second&#33; &lt;tag&gt; caf&eacute;.</p><ul><li>item one</li><li>item two</li></ul></article>
<aside class="sidebar"><p>Most read today in the town.</p></aside>
<section id="comments"><p>A reader wrote this comment here, at some length, about it.</p></section>
<form><label>Search</label><input></form><footer><p>Copyright 2020, all rights reserved.</p></footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph with bold and a link over lines.\nSecond! <tag> café.\nitem one\nitem two"


@pytest.mark.parametrize("page", ["", None, "<html></html>", "<nav><a href='/'>Home</a></nav>", "<script>if (a < b) {}</script>"])
def test_no_text(page):
    assert html_text.main_text(page) == ""


def test_unmarked_and_broken_pages():
    assert html_text.main_text("<p>Plain words of a page that has no marks at all.<p>And a second one that nobody closed") == "Plain words of a page that has no marks at all.\nAnd a second one that nobody closed"
    assert "words" in html_text.main_text("<div><div><p>Some words here and there " * 50)


def test_pairs(spark):
    turn = lambda i, r, t: {"turn": i, "role": r, "text": t}
    a = [turn(0, "user", "hi"), turn(1, "assistant", "good"), turn(2, "user", "more"), turn(3, "assistant", "done")]
    b = [*a[:2], turn(2, "user", "more"), turn(3, "assistant", "bad")]
    rows = [(1, a, b), (2, a, a), (3, a, a[:2]), (4, a, [])]
    kind = "array<struct<turn:long,role:string,text:string>>"
    out = {r["pair_id"]: r for r in preference.format_pairs(spark.createDataFrame(rows, f"pair_id long, chosen {kind}, rejected {kind}")).collect()}
    first = out[1]
    assert first["n_prompt_turns"] == 3 and first["prompt"].count("<|im_start|>") == 3
    start, end = map(int, first["chosen_mask"].split(":"))
    assert first["chosen"][start:end] == "done<|im_end|>" and first["rejected"][start : end - 1] == "bad<|im_end|>"
    assert not out[2]["usable"] and not out[3]["usable"] and out[4]["n_prompt_turns"] == 0


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sources: dict = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        sources.setdefault(r["source"], []).append(r)
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r["size"] for r in sources[s]) for s in order}
    open_, target, left = set(order), {}, 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        for s in over:
            target[s] = 2.0 * size[s]
        left -= sum(target[s] for s in over)
        open_ -= over
        if not over or not open_:
            break
    target |= {s: level * weight[s] for s in open_}
    for s in order:
        assert all(r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) for r in sources[s])
        assert abs(sum(r["taken"] for r in sources[s]) - target[s]) <= 2 * max(r["size"] for r in sources[s])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_operator_matches_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name]))


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stages = dict(p.STAGES)
    assert list(stages) == ["language", "near_duplicates", "benchmark", "personal_data", "mix"]

    got = stages["language"](spark, docs, SF_SMALL)
    assert got.columns == docs.columns
    told = langid.identify(docs, langid.fit(langid.training(docs))).select("doc_id", "language.*").collect()
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in told if r["lang_pred"] != "und" and r["score"] >= p.LEAST_SCORE}

    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = stages["near_duplicates"](spark, docs, SF_SMALL)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {d for d, c in near_duplicates(texts).items() if d == c}

    got = stages["benchmark"](spark, docs, SF_SMALL)
    items = [lowered(r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    clean = {d for d, t in texts.items() if not any(x and len(x & lowered(t)) >= 0.75 * len(x) for x in items)}
    assert {r["doc_id"] for r in got.collect()} == clean

    got = stages["personal_data"](spark, docs, SF_SMALL)
    assert got.columns == docs.columns
    for r in got.collect():
        before = texts[r["doc_id"]]
        if not base_spans(before) and r["text"] is not None and "[" not in r["text"]:
            assert r["text"] == before
        for a, _, e, name in base_spans(before):
            assert before[a:e] not in r["text"] or name != "email"
        assert r["text"] is None or r["n_chars"] == len(r["text"])

    got = stages["mix"](spark, docs, SF_SMALL)
    assert got.count() == mixing.mix(docs).agg({"copies": "sum"}).first()[0]


def test_pipeline_runs(spark):
    import corpus_pipeline as p

    out = p.run(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.select("doc_id", "copy").collect()
    assert rows and len(set(rows)) == len(rows)
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
