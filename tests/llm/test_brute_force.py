"""Operators against plain Python versions on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SF, SF_SMALL

from vatloom.llm import decontaminate, fingerprint, langid, minhash, pii, suffix_dedup, suffix_tree

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def small(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r[0]: r[1] or "" for r in rows}


def shingles(text: str) -> set:
    w = SPACE.findall(text.translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(texts: dict[int, str]) -> dict[int, int]:
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def perturbed(seed: int = 3) -> dict[int, str]:
    """Groups of copies at all distances around the threshold, and chains that only links in a row hold together."""
    rng, out, n = random.Random(seed), {}, 1000
    vocabulary = [f"w{i}" for i in range(500)]
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 60, 200]))]
        for _ in range(8):
            n += 1
            out[n] = " ".join(words)
            if rng.random() < 0.8:
                words = list(words)
                for _ in range(rng.randint(1, max(1, len(words) // 25))):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return out


def test_near_duplicates(spark, small):
    texts = {**small, **perturbed()}
    out = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    expected = near_duplicates(texts)
    assert {r["doc_id"]: r["component_id"] for r in out} == expected
    assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]])) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {"path": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(40)], "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]}[shape]
    got = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: r for x, r in root.items() if x not in alone}


def removed(texts: dict[int, str]) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    data = {d: t.encode() for d, t in texts.items()}
    for d in sorted(data):
        for i in range(len(data[d]) - 49):
            first.setdefault(data[d][i : i + 50], d)
    out = {}
    for d, b in data.items():
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, small):
    texts = {d: t[:3000] for d, t in small.items()}
    line = "a passage that many of the documents share, longer than fifty bytes. "
    texts |= {5000 + i: f"{i} {line * (i % 3 + 1)}ünï {'x' * (i * 7)} end {i}" for i in range(30)}
    texts |= {6000: "a" * 49, 6001: "a" * 49, 6002: "a" * 50, 6003: "a" * 500, 6004: "ab" * 100, 6005: "b" + "ab" * 40}
    out = suffix_dedup.deduplicate(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    expected = removed(texts)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == expected
    assert any(r["n_spans"] > 1 for r in out)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind: str, hit: str) -> bool:
    digits = [int(c) for c in hit if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and luhn % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple]:
    found = [(m.start(), k, m.end(), name) for k, (name, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if valid(name, m[0])]
    return sorted(found)


def test_pii_base_spans(spark, small):
    extra = [
        "a@b.c@d.e x..%y@z.co.uk. mail@@x.y a@b. @c.d é.x@y-z.io", "1.2.3.4.5.6.7.8 256.1.1.1 1256.1.1.1 0001.002.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 41111111111111112 4111  1111 1111 1111",
        "+49 (30) 123-4567.8 +1+2 2345 678 901 ++4930123456789 +12 345 678 901 234 567 +1234567890)", "🙂🙂 +49 30 1234567 🙂 x@y.zz 🙂 8.8.8.8", "4111 1111 1111 1111 4111 1111 1111 1111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1",
        "0" * 14 + " a " + "0" * 20 + "-" + "00 " * 8, "@" * 50 + "a" * 200 + "@" + "b." * 40 + "c", "378282246310005x5555555555554444-6011111111111117",
    ]
    texts = {**small, **{10_000 + i: t for i, t in enumerate(extra)}}
    out = pii.detect(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    for r in out:
        expected = [(a, k, e) for a, k, e, _ in base_spans(texts[r["doc_id"]])]
        assert [tuple(s) for s in r["base"]] == expected, r["doc_id"]
        assert {tuple(s) for s in r["spans"]} >= set(expected)


def test_pii_adds_spans(spark):
    texts = [(i, t) for i, t in enumerate(["write to jane (at) example (dot) com please", "call 555-867-5309 today", "version 1.2.3 of part 12-34", "x"] + ["mail a@example.com"] * 20)]
    out = {r["doc_id"]: r["spans"] for r in pii.detect(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(out[0]) == 1 and out[2] == [] and out[3] == []


def test_containment(spark, small):
    rng = random.Random(5)
    items = {i: " ".join(rng.choice(list(small.values())).split()[10:60]) for i in range(12)}
    items[50], items[51] = "one two", "un seul MOT de Plus que rien du tout"
    texts = {d: t for d, t in small.items()}
    for i, (k, t) in enumerate(items.items()):
        w = t.split()
        texts[9000 + 2 * i] = "lead in words " * 200 + " ".join(w) + " and then " * 100
        if len(w) > 20:
            w[len(w) // 2] = "changed"
            w[3] = "odd"
        texts[9001 + 2 * i] = "some other start " + " ".join(w)
    sets = {i: lowered(t) for i, t in items.items()}
    docs = {d: lowered(t) for d, t in texts.items()}
    expected = {(d, i) for d, s in docs.items() for i, x in sets.items() if x and len(x & s) >= 0.75 * len(x)}
    got = decontaminate.contained(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == expected
    shuffled = decontaminate.contained(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), broadcast_rows=0)
    assert {(r["doc_id"], r["item_id"]) for r in shuffled.collect()} == expected


def lowered(text: str) -> set:
    w = SPACE.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_suffix_tree_counts(spark, small):
    out = suffix_tree.score(spark.createDataFrame(list(small.items()), "doc_id long, text string")).collect()
    counts: Counter = Counter()
    for d, t in small.items():
        if zlib.crc32(str(d).encode()) % 10:
            counts.update([*SPACE.findall(t.translate(LOWER)), None])
    total, kinds = sum(counts.values()), len(counts)
    for r in out:
        tokens = [*SPACE.findall(small[r["doc_id"]].translate(LOWER)), None]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[x] > 0 for x in tokens), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)


def test_suffix_tree_beats_the_base(spark):
    out = suffix_tree.score(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert out["s"] > out["b"]


def weights(text: str) -> Counter:
    return Counter(SPACE.findall(text.lower()))


def test_fingerprints(spark, small):
    ids = sorted(small)
    out = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(list(small.items()), "doc_id long, text string")).collect()}
    errors = []
    for d, following in zip(ids, ids[1:] + ids[:1]):
        t, r = small[d], out[d]
        q = len(t) // 4
        edited = t[: len(t) - q] + small[following][:q]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for got, a, b in ((r["near_edited"], t, edited), (r["near_next"], t, small[following])):
            x, y = weights(a), weights(b)
            true = sum((x & y).values()) / max(1, sum((x | y).values())) if x or y else 1.0
            errors.append(abs(got - true))
    assert sum(errors) / len(errors) < 0.08 and max(errors) < 0.5
    by_text = {}
    for d in ids:
        assert by_text.setdefault(small[d], out[d]["fingerprint"]) == out[d]["fingerprint"]


def test_langid_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs, langid.fit(langid.training(docs)))
    rows = found.select("doc_id", "lang", "language.lang_pred", "language.score").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_langid_backs_off():
    model = langid.Model({"en": Counter({"the": 9, "house": 3, "thing": 2}), "de": Counter({"das": 9, "haus": 3, "schule": 2})})
    import pyarrow as pa

    names, scores = model.predict(pa.array(["the thing", "schulen", "123 !", None, "häuser das"]))
    assert names == ["en", "de", "und", "und", "de"] and scores[2] == 0
