"""Texts of over a megabyte, one of them with a copy, beside short ones: every operator reads them to the end."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest

from vatloom.llm import decontaminate, fingerprint, langid, minhash, mixing, suffix_dedup, suffix_tree

WORDS = 150_000


def text(seed: int) -> str:
    """Words of which hardly any five in a row repeat."""
    out, x = [], seed
    for _ in range(WORDS):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{(x >> 8) % 3000:04d}")
    return " ".join(out)


TAIL = " the last words of this very long text stand here and are sixty bytes and more"
ROWS = [(1, text(1) + TAIL), (2, text(2)), (3, "short words" + TAIL), (4, text(1) + TAIL + " one more"), (5, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_scores(docs):
    got = by_id(suffix_tree.score(docs))
    train = Counter()
    for i, t in ROWS:
        if not got[i]["held_out"]:
            train.update((t or "").split() + ["\n"])
    n, v = sum(train.values()), len(train)
    for i, t in ROWS:
        tokens = (t or "").split() + ["\n"]
        base = math.fsum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert (got[i]["n_tokens"], got[i]["train_tokens"]) == (len(tokens), n)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and got[i]["score"] < 0


def test_repeats(docs):
    """Against a set of all 50-byte strings of the smaller documents."""
    got, seen = by_id(suffix_dedup.deduplicate(docs)), set()
    for i, t in ROWS:
        data = (t or "").encode()
        hit, here = bytearray(len(data)), set()
        for p in range(len(data) - 49):
            s = hash(data[p : p + 50])
            here.add(s)
            if s in seen:
                hit[p : p + 50] = b"\1" * 50
        seen |= here
        kept = bytes(b for b, h in zip(data, hit) if not h)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(data), sum(hit), hashlib.sha256(kept).hexdigest())


def test_near_copies_and_sizes(docs):
    got = by_id(minhash.near_duplicates(docs))
    assert [got[i]["component_id"] for i, _ in ROWS] == [1, 2, 3, 1, 5]
    for i, t in ROWS:
        w = (t or "").split()
        assert got[i]["n_shingles"] == len({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    sizes = by_id(mixing.mix(docs))
    assert [sizes[i]["size"] for i, _ in ROWS] == [len((t or "").split()) for _, t in ROWS]


def test_item_at_the_end(spark, docs):
    item = spark.createDataFrame([(1, "words of this very long text stand here and are sixty")], "item_id long, text string")
    assert sorted(by_id(decontaminate.decontaminate(docs, item))) == [2, 5]


def test_language_and_fingerprint(docs):
    found = by_id(langid.identify(docs, langid.fit(langid.training(docs))))
    assert sorted(found) == [1, 2, 3, 4, 5] and found[5]["language"]["lang_pred"] == "und"
    prints = by_id(fingerprint.fingerprints(docs))
    assert [prints[i]["n_chars"] for i, _ in ROWS] == [len(t or "") for _, t in ROWS]


def test_tied_rows_are_taken_alike(spark):
    """Rows of one id and one size but other texts, in any order of reading."""
    rows = [(i // 4, f"some text number {i}", "a" if i % 3 else "b") for i in range(400)]
    taken = []
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(1 + len(taken) * 4)
        taken.append(sorted((r["doc_id"], r["text"], r["copy"]) for r in mixing.emit(d).collect()))
    assert taken[0] == taken[1] and taken[0]
