"""Added personal data spans against plain Python, given fixed weights; documents with very many spans."""

from __future__ import annotations

import math
import random

import regex

from vatloom.llm import pii

MODELS = [[-1.0, 1.5, 1.0, 0.5, 0.5, 0.5], [-0.5, 1.0, 1.0, 0.5, 0.5, 1.0], [-1.0, 1.0, 2.0, 0.5, 0.5, 0.5], [0.0, 1.0, 1.0, 0.5, 1.0, 0.5]]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, hit: str) -> bool:
    digits = [c for c in hit if c in "0123456789"]
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    return 14 <= len(digits) <= 19 and luhn("".join(digits)) if kind == "card" else 10 <= len(digits) <= 15


def spans(text: str) -> tuple[list, list]:
    base, out = [], []
    for i, kind in enumerate(pii.KINDS):
        base += [(m.start(), i, m.end()) for m in regex.finditer(pii.BASE[kind], text) if valid(kind, m[0])]
    for i, kind in enumerate(pii.KINDS):
        last = 0
        for m in regex.finditer(pii.WIDE[kind], text):
            before, hit, after = text[last : m.start()][-32:], m[0], text[m.end() : m.end() + 1]
            last = m.end()
            digits = "".join(c for c in hit if c in "0123456789")
            check = {"email": bool(regex.search(r"(?:\.|[)\]]\x20?)[A-Za-z]{2,}$", hit)), "ip": kind == "ip" and valid("ip", hit), "card": luhn(digits or "1"), "phone": 10 <= len(digits) <= 15}[kind]
            votes = (
                1 if regex.fullmatch(pii.BASE[kind], hit) and valid(kind, hit) else -1, 1 if check else -1, 1 if regex.search(pii.GAZETTEER[kind], hit) else 0,
                1 if regex.search(pii.CUES[kind], before.lower()) else 0, -1 if regex.search("[A-Za-z0-9_/=]", before[-1:] + " " + after) else 1,
            )
            w = MODELS[i]
            score = 1 / (1 + math.exp(-(w[0] + sum(a * b for a, b in zip(w[1:], votes)))))
            if score >= 0.9 and not any(k == i and a < m.end() and m.start() < e for a, k, e in base):
                out.append((m.start(), i, m.end()))
    return sorted(base), sorted(base + out)


def sample(rng: random.Random) -> str:
    parts = [
        "write to jane.doe@mail.example.com", "mail bob (at) host (dot) org now", "x (at) a.b@c.com", "e-mail: y[AT]z[DOT]de.", "call 555-867-5309 today", "phone (030) 555 1234x", "tel +49 30 1234567",
        "host 10.0.0.1", "ip 999.1.1.1", "4111 1111 1111 1111", "card 4222222222222", "visa 378282246310005", "ünï 🙂", "word", "a@b", "1.2.3.4.5.6.7.8", "key=4111111111111111", "fax 212.555.0100", "+1 (2) 3",
    ]
    return rng.choice([" ", "  ", ", "]).join(rng.choice(parts) for _ in range(rng.randint(0, 30)))


def test_added_spans(spark, monkeypatch):
    monkeypatch.setattr(pii, "learn", lambda marked: MODELS)
    rng = random.Random(8)
    texts = {i: sample(rng) for i in range(120)} | {500: " ".join(sample(rng) for _ in range(60))}
    out = pii.detect(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    for r in out:
        base, every = spans(texts[r["doc_id"]])
        assert [tuple(s) for s in r["base"]] == base, texts[r["doc_id"]]
        assert [tuple(s) for s in r["spans"]] == every, texts[r["doc_id"]]


def test_redaction_cuts_the_same_spans(spark, monkeypatch):
    monkeypatch.setattr(pii, "learn", lambda marked: MODELS)
    rng = random.Random(9)
    texts = {i: sample(rng) for i in range(60)} | {500: " ".join(sample(rng) for _ in range(60))}
    for r in pii.redact(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        text, at, want = texts[r["doc_id"]], 0, []
        for a, k, e in spans(text)[1]:
            want.append(text[at:a] if a >= at else "")
            want.append(f"[{pii.KINDS[k].upper()}]" if a >= at else "")
            at = max(at, e)
        assert r["text"] == "".join(want) + text[at:]


def test_many_spans_in_one_document(spark):
    """30,000 addresses in one text; work grows a little faster than their number, not with its square."""
    text = " ".join(f"user{i}@host{i}.example.com" for i in range(30_000))
    r = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    at, want = 0, []
    for word in text.split(" "):
        want.append((at, 0, at + len(word)))
        at += len(word) + 1
    assert [tuple(s) for s in r["spans"]] == want
