"""Language identification and suffix-tree scores against plain Python on small corpora."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from vatloom.llm import langid, suffix_tree

TEXTS = {
    "en": ["the cat sat on the mat and the dog ran", "a dog and a cat in the house", "she sells sea shells on the shore"],
    "de": ["der hund und die katze sind im haus", "die katze schläft auf dem dach", "ein hund läuft über die straße"],
    "fr": ["le chat est sur la table et le chien court", "la maison est près de la rivière", "un chien et un chat"],
}


def plain_language(counts: dict[str, Counter], text: str) -> tuple[str, float]:
    langs = sorted(counts)
    words = re.findall(r"[^\W\d_]+", text.lower())
    if not words:
        return "und", 0.0

    def table(per):
        names = set().union(*per)
        total = [sum(c.values()) + 0.1 * (len(names) + 1) for c in per]
        return {x: [math.log((c[x] + 0.1) / t) for c, t in zip(per, total)] for x in names}

    known = table([counts[x] for x in langs])
    grams = {}
    for n in (4, 3, 2, 1):
        per = []
        for x in langs:
            c: Counter = Counter()
            for w, k in counts[x].items():
                p = f" {w} " if n > 1 else w
                for i in range(len(p) - n + 1):
                    c[p[i : i + n]] += k
            per.append(c)
        grams[n] = table(per)
    sums = [0.0] * len(langs)
    for w in words:
        logs = known.get(w)
        for n in (4, 3, 2, 1) if logs is None else ():
            p = f" {w} " if n > 1 else w
            hits = [grams[n][p[i : i + n]] for i in range(len(p) - n + 1) if p[i : i + n] in grams[n]]
            if hits:
                logs = [sum(h[j] for h in hits) / len(hits) for j in range(len(langs))]
                break
        if logs is not None:
            sums = [a + b for a, b in zip(sums, logs)]
    best = max(range(len(langs)), key=lambda j: (sums[j], -j))
    sharp = [s * min(len(words), 20) / len(words) for s in sums]
    soft = [math.exp(s - max(sharp)) for s in sharp]
    return langs[best], soft[best] / sum(soft)


def test_language_of_texts():
    counts = {x: Counter(w for t in ts for w in re.findall(r"[^\W\d_]+", t.lower())) for x, ts in TEXTS.items()}
    model = langid.Model(counts)
    texts = [t for ts in TEXTS.values() for t in ts] + ["", "12 34", "katzen und hunde", "catlike dogs", "xyzzy", "chiens près rivières", "ÜBER straßen", "the " * 50, "q", None]
    names, share = model.predict(pa.array(texts, pa.string()))
    for t, name, s in zip(texts, names, share):
        want = plain_language(counts, t or "")
        assert name == want[0] and s == pytest.approx(want[1], abs=1e-9), t


def plain_scores(texts: dict[int, str], least: int, least_gain: float) -> dict[int, float]:
    depth = suffix_tree.DEPTH

    def stream(t):
        return b"\n" * depth + b" ".join([*t.encode().lower().split(), b"\n"])

    pairs: dict[bytes, Counter] = {}
    for d, t in texts.items():
        if zlib.crc32(str(d).encode()) % suffix_tree.FOLDS:
            s = stream(t)
            for i in range(depth, len(s)):
                for k in range(depth + 1):
                    pairs.setdefault(s[i - k : i], Counter())[s[i]] += 1
    nodes = {c: n for c, n in pairs.items() if not c or sum(n.values()) >= least}
    kept = set()
    for c, n in nodes.items():
        if c:
            total, up = sum(n.values()), nodes[c[1:]]
            gain = sum(k * math.log(k / total / (up[x] / sum(up.values()))) for x, k in n.items())
            if gain >= least_gain:
                kept |= {c[i:] for i in range(len(c))}
    root = nodes.get(b"", Counter())
    out = {}
    for d, t in texts.items():
        s, total = stream(t), 0.0
        for i in range(depth, len(s)):
            p = (root[s[i]] + 0.5) / (sum(root.values()) + 128)
            for k in range(1, depth + 1):
                n = nodes.get(s[i - k : i]) if s[i - k : i] in kept else None
                if n is None:
                    break
                p = (n[s[i]] + len(n) * p) / (sum(n.values()) + len(n))
            total += math.log10(p)
        out[d] = total
    return out


def test_suffix_tree_scores(spark):
    rng = random.Random(2)
    vocabulary = ["alpha", "alphabet", "beta", "Betamax", "gamma", "ünï", "a", "ab", "abc"]
    texts = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(df).collect()}
    want = plain_scores(texts, 2, suffix_tree.LEAST_GAIN)
    assert all(got[d] == pytest.approx(want[d], rel=1e-9) for d in texts)
