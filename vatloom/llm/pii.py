"""Personal data spans by weak supervision, in DataFrame expressions only.

Base spans come from four patterns (email, ip, card, phone) and always stay. A wider pattern of each
kind proposes candidates; five labelers vote on every candidate (+1, 0 for no opinion, -1):

* regex: the candidate is a base span,
* check: Luhn, octets, digit count or a letter-only top-level domain hold,
* gazetteer: known top-level domain, card issuer prefix, calling code, routable first octet,
* context: a cue word stands in the 32 characters before,
* isolation: no letter, digit, underscore, slash or equals sign touches the candidate.

Expectation-maximisation (a two-class model with a table of vote probabilities for each labeler and
kind) is fitted on the counts of vote patterns over all documents; there are at most 4 * 3^5 of these,
so that is what the driver sees, whatever the corpus. A logistic span classifier is then trained on
the same patterns with the posteriors as soft labels, and a candidate that overlaps no base span of
its kind is added where the classifier gives at least ``threshold``.

The patterns below match what the plain ones match, but each start of a run is tried once only, and
no group is matched by recursion: a very long run without blanks costs linear time and no stack.

Defined cases. Null text: empty, no spans. Null id: kept. Repeated rows: one result row each. No
candidates at all: the classifier is its starting point. Columns other than id and text are ignored by
``detect`` and kept by ``redact``; only names starting with ``_pii_`` are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

KINDS = ("email", "ip", "card", "phone")
_C, _D = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_RUN = rf"(?:\G|(?<!{_C})){_C}++"
_CHAIN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){%d,%d}+(?![\x20-]?[0-9])"
BASE = {
    "email": rf"{_RUN}@{_D}++(?:\.{_D}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": _CHAIN % (13, 18),
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"{_RUN}(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?){_D}++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?){_D}++)++",
    "ip": BASE["ip"],
    "card": _CHAIN % (12, 18),
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]|(?<![0-9A-Za-z.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CUES = {
    "email": "mail|contact|write|e-mail|correo|courriel|kontakt",
    "ip": r"\bip\b|host|server|address|addr|adresse|dirección",
    "card": "card|visa|master|amex|credit|debit|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|cell|ruf|appel|llam|móvil",
}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at|it|nl|be|ca|co|mx|ar)$",
    "ip": r"^(?!0+\.|127\.|255\.|2[4-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6)",
    "phone": r"^\+(?:1|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
}
LABELERS = ("regex", "check", "gazetteer", "context", "isolation")
#: P(vote | personal data) and P(vote | not), where EM starts; PSEUDO observations of each keep a labeler's direction.
PRIOR = {
    "regex": ({-1: 0.20, 0: 0.01, 1: 0.79}, {-1: 0.94, 0: 0.01, 1: 0.05}),
    "check": ({-1: 0.05, 0: 0.01, 1: 0.94}, {-1: 0.89, 0: 0.01, 1: 0.10}),
    "gazetteer": ({-1: 0.01, 0: 0.19, 1: 0.80}, {-1: 0.01, 0: 0.54, 1: 0.45}),
    "context": ({-1: 0.01, 0: 0.69, 1: 0.30}, {-1: 0.01, 0: 0.94, 1: 0.05}),
    "isolation": ({-1: 0.05, 0: 0.01, 1: 0.94}, {-1: 0.39, 0: 0.01, 1: 0.60}),
}
PSEUDO = 20.0
THRESHOLD = 0.9


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    return {
        "email": F.lit(True),
        "ip": hit.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"),
        "card": n.between(14, 19) & luhn(_digits(hit)),
        "phone": n.between(10, 15),
    }[kind]


_HIT = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"


def _let(value: Column, of) -> Column:
    """``of`` of a value that is computed once, however often ``of`` uses it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _fold(xs: Column, zero: Column, total, combine, empty: Column, step, context=None) -> Column:
    """All that ``step`` (accumulator of pos and out, element) puts in out over an array, in order.

    With ``context`` (block, pos at its start), ``step`` takes its value and that pos first and returns the function.

    Growing an array by one element copies it, so the array is cut in blocks of about the square root of its size:
    ``total`` and ``combine`` give the pos at which each block starts, and the blocks' results are joined once.
    """

    def cut(a: Column) -> Column:
        width = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(a))).cast("int"))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), width), lambda s: F.slice(a, s, width))

    def over(block: Column, pos: Column) -> Column:
        run = lambda f: F.aggregate(block, F.struct(pos.alias("pos"), empty.alias("out")), f, lambda acc: acc["out"])
        return run(step) if context is None else _let(context(block, pos), lambda c: run(step(c, pos)))

    def joined(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(zero), lambda acc, b: F.concat(acc, F.array(combine(F.element_at(acc, -1), total(b)))))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), over))

    return _let(xs, lambda a: _let(cut(a), joined))


#: What a text must contain for a pattern of the kind to match; looking for it is much cheaper than the pattern.
NEEDS = {"email": r"@|[(\[](?:at|AT)[)\]]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}


def _hits(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code point offsets, from what lies between the matches."""
    empty = F.array().cast(_HIT)

    def paired(p: Column) -> Column:
        gaps, hits = p["gaps"], p["hits"]
        n = F.size(hits)
        following = F.zip_with(F.slice(gaps, F.lit(2), n), F.slice(hits, F.lit(2), n), lambda g, h: F.left(F.concat(g, F.coalesce(h, F.lit(""))), F.lit(1)))
        both = F.zip_with(F.slice(gaps, F.lit(1), n), hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h"), F.right(g, F.lit(32)).alias("before")))
        return F.zip_with(both, following, lambda x, y: F.struct(x["g"].alias("g"), x["h"].alias("h"), x["before"].alias("before"), y.alias("after")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["g"]
        end = start + F.length(x["h"])
        hit = F.struct(start.alias("start"), end.alias("end"), x["h"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(hit)).alias("out"))

    length = lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["g"] + F.length(x["h"]))
    parts = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    found = _fold(_let(parts, paired), F.lit(0), length, lambda a, b: a + b, empty, step)
    return F.when(text.rlike(NEEDS[kind]) & text.rlike(pattern), found).otherwise(empty)


def base_spans(text: Column, ips: Column | None = None) -> Column:
    """Array of (start, kind number, end), by start and then kind. ``ips``: the matches of the ip pattern, if they are known."""

    def of(i: int, kind: str) -> Column:
        hits = ips if kind == "ip" and ips is not None else _hits(text, kind, BASE[kind])
        valid = F.filter(hits, lambda h: _valid(kind, h["hit"]))
        return F.transform(valid, lambda h: F.struct(h["start"].alias("start"), F.lit(i).alias("kind"), h["end"].alias("end")))

    return F.sort_array(F.concat(*[of(i, k) for i, k in enumerate(KINDS)]))


def _votes(kind: str, i: int, h: Column) -> Column:
    hit, n = h["hit"], F.length(_digits(h["hit"]))
    yes = lambda c, other: F.when(c, F.lit(1)).otherwise(F.lit(other))
    check = {"email": hit.rlike(r"(?:\.|[)\]]\x20?)[A-Za-z]{2,}$"), "ip": _valid("ip", hit), "card": luhn(_digits(hit)), "phone": n.between(10, 15)}[kind]
    touched = F.right(h["before"], F.lit(1)).rlike("[A-Za-z0-9_/=]") | h["after"].rlike("[A-Za-z0-9_/=]")
    votes = (yes(hit.rlike(f"^(?:{BASE[kind]})$") & _valid(kind, hit), -1), yes(check, -1), yes(hit.rlike(GAZETTEER[kind]), 0), yes(F.lower(h["before"]).rlike(CUES[kind]), 0), yes(~touched, -1))
    return F.struct(F.lit(i).alias("kind"), h["start"].alias("start"), h["end"].alias("end"), F.array(*votes).alias("votes"))


def candidates(text: Column, ips: Column | None = None) -> Column:
    """Array of (kind number, start, end, votes) of every match of the wide patterns. ``ips`` as in ``base_spans``."""

    def of(i: int, kind: str) -> Column:
        hits = ips if kind == "ip" and ips is not None else _hits(text, kind, WIDE[kind])
        return F.transform(hits, lambda h: _votes(kind, i, h))

    return F.concat(*[of(i, k) for i, k in enumerate(KINDS)])


def fit_reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> list[tuple[int, tuple[int, ...], int, float]]:
    """EM over counted vote patterns (kind, votes, count); returns each with its posterior of being personal data."""
    out = []
    for kind in range(len(KINDS)):
        rows = [(v, n) for k, v, n in patterns if k == kind]
        prior = 0.5
        p = [[dict(c) for c in PRIOR[j]] for j in LABELERS]
        post = [0.5] * len(rows)
        for _ in range(rounds):
            for r, (v, _n) in enumerate(rows):
                a, b = math.log(prior), math.log(1 - prior)
                for j, x in enumerate(v):
                    a, b = a + math.log(p[j][0][x]), b + math.log(p[j][1][x])
                post[r] = 1 / (1 + math.exp(min(500, b - a)))
            total = sum(n for _, n in rows)
            prior = (sum(q * n for q, (_, n) in zip(post, rows)) + 1) / (total + 2)
            for j in range(len(LABELERS)):
                for c in (0, 1):
                    mass = [(n * (q if c == 0 else 1 - q), v[j]) for q, (v, n) in zip(post, rows)]
                    whole = sum(m for m, _ in mass) + PSEUDO
                    p[j][c] = {x: (sum(m for m, y in mass if y == x) + PSEUDO * PRIOR[LABELERS[j]][c][x]) / whole for x in (-1, 0, 1)}
        out += [(kind, v, n, q) for q, (v, n) in zip(post, rows)]
    return out


def train_classifier(labelled: list[tuple[int, tuple[int, ...], int, float]], steps: int = 1500, rate: float = 0.5, penalty: float = 1e-3) -> list[list[float]]:
    """Logistic regression of the posterior on the votes, one weight vector (intercept first) a kind.

    A pattern weighs as the logarithm of its count, so that rare combinations of votes are learned too.
    """
    models = []
    for kind in range(len(KINDS)):
        rows = [(v, math.log1p(n), q) for k, v, n, q in labelled if k == kind]
        w = [-1.0, 1.0, 1.0, 0.5, 0.5, 0.5]
        total = sum(n for _, n, _ in rows)
        for _ in range(steps if total else 0):
            g = [penalty * x for x in w]
            for v, n, q in rows:
                e = (1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + sum(a * b for a, b in zip(w[1:], v)))))) - q) * n / total
                for j, x in enumerate((1, *v)):
                    g[j] += e * x
            w = [a - rate * b for a, b in zip(w, g)]
        models.append(w)
    return models


def _score(c: Column, models: list[list[float]]) -> Column:
    """The classifier's probability of a candidate."""
    w = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in models]), c["kind"] + 1)
    z = F.element_at(w, 1)
    for j in range(len(LABELERS)):
        z = z + F.element_at(w, j + 2) * F.element_at(c["votes"], j + 1)
    return F.lit(1.0) / (F.exp(-z) + 1)


def _all_spans(base: Column, cands: Column, models: list[list[float]], threshold: float) -> Column:
    """The base spans and the candidates that the classifier adds. Base spans are looked through in blocks, so that a candidate costs the square root of their number."""

    def blocks(b: Column) -> Column:
        width = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(b))).cast("int"))
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1)), width), lambda s: F.slice(b, s, width))
        low, high = (lambda x: F.array_min(F.transform(x, lambda y: y["start"]))), (lambda x: F.array_max(F.transform(x, lambda y: y["end"])))
        return F.transform(cut, lambda x: F.struct(low(x).alias("start"), high(x).alias("end"), x.alias("spans")))

    def meets(x: Column, c: Column) -> Column:
        return (x["start"] < c["end"]) & (c["start"] < x["end"])

    def new(c: Column, cut: Column) -> Column:
        clash = F.exists(cut, lambda x: F.coalesce(meets(x, c), F.lit(False)) & F.exists(x["spans"], lambda y: (y["kind"] == c["kind"]) & meets(y, c)))
        return (_score(c, models) >= threshold) & ~clash

    more = _let(blocks(base), lambda cut: F.filter(cands, lambda c: new(c, cut)))
    return F.sort_array(F.concat(base, F.transform(more, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))))


def _marked(docs: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    """``docs`` (of which only the id is kept if ``id_col`` is given) with base spans and candidates, in a table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(id_col).alias("_pii_id")] if id_col else [F.col(c) for c in docs.columns]
    with_ips = docs.select(*kept, text.alias("_pii_text"), _hits(text, "ip", BASE["ip"]).alias("_pii_ips"))
    ips = F.col("_pii_ips")
    marks = with_ips.withColumns({"_pii_base": base_spans(F.col("_pii_text"), ips), "_pii_cands": candidates(F.col("_pii_text"), ips)})
    return staged(marks.drop("_pii_text", "_pii_ips"), "pii-marks")


def learn(marked: DataFrame) -> list[list[float]]:
    """Fit EM and the classifier on the vote patterns of all candidates."""
    got = marked.select(F.explode("_pii_cands").alias("c")).groupBy("c.kind", "c.votes").count().collect()
    return train_classifier(fit_reliabilities(sorted((r[0], tuple(r[1]), r[2]) for r in got)))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind number, end), before and after the classifier's additions."""
    marked = _marked(docs, id_col, text_col)
    models = learn(marked)
    return marked.select(F.col("_pii_id").alias("doc_id"), F.col("_pii_base").alias("base"), _all_spans(F.col("_pii_base"), F.col("_pii_cands"), models, threshold).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in square brackets; other columns as they are. A null text stays null."""
    marked = _marked(docs, None, text_col)
    models = learn(marked)
    text = F.col(text_col)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    last = lambda b: F.array_max(F.transform(b, lambda s: s["end"]))

    # what a block of spans covers is cut from the text once, and the gaps from that
    def covered(block: Column, pos: Column) -> Column:
        return F.substr(text, pos + 1, F.greatest(last(block) - pos, F.lit(0)))

    def step(piece: Column, pos: Column):
        def one(acc: Column, s: Column) -> Column:
            gap = F.substr(piece, acc["pos"] - pos + 1, F.greatest(s["start"] - acc["pos"], F.lit(0)))
            mark = F.when(s["start"] >= acc["pos"], F.element_at(names, s["kind"] + 1)).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], F.array(gap, mark)).alias("out"))

        return one

    empty = F.array().cast("array<string>")
    front = _fold(F.col("_pii_spans"), F.lit(0), last, lambda a, b: F.greatest(a, b), empty, step, covered)
    clean = F.concat(F.array_join(front, ""), F.substr(text, last(F.col("_pii_spans")) + 1, F.length(text)))
    spans = marked.withColumn("_pii_spans", _all_spans(F.col("_pii_base"), F.col("_pii_cands"), models, threshold))
    out = spans.withColumn(text_col, F.when(F.size("_pii_spans") > 0, clean).otherwise(text))
    return out.select(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))
