"""Fill-in-the-middle: texts cut in three and reordered around sentinels, by one byte automaton.

A unit is a run of ASCII letters or any other single code point. A table-driven automaton reads the UTF-8
bytes: its states know whether a letter run or a sentinel is under way, its transitions say where a unit
starts, where a code point starts and where a sentinel ends, and those are counted. Its state depends on the
last two bytes alone, so one scan runs it over a whole block of texts at once. A second pass looks up the
bytes at which the drawn units start and cuts there.

Cuts, form and order are drawn from the SHA-256 of seed and id, so reruns agree.

Defined cases. Null text: as empty. Empty text, or one that holds a sentinel: form ``plain``, the text as it
is. Text of one unit: cut before or after it. Null id: counts as the empty text where draws are made. Repeated
rows: each is transformed, equal ids and texts alike. Very long texts are whole; blocks are cut between texts.
Extra columns stay; the result is one struct column whose name is made free of clashes by the caller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textvec import pieces, raw

RESULT = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"
PLAIN_FROM, SPM_BELOW = 90, 20

_OTHER, _LETTER, _NAME, _OPENING, _CLOSING, _LEAD, _TAIL, _EDGE = range(8)
_OUT, _WORD, _OPENED, _NAMED = range(4)
UNIT, POINT, SENTINEL = 1, 2, 4


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of a byte, next state by (state, class), and what a transition emits."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[65:91] = kind[97:123] = _LETTER
    kind[[ord(c) for c in "PSM"]] = _NAME
    kind[ord("<")], kind[ord(">")] = _OPENING, _CLOSING
    kind[0x80:0xC0], kind[0xC0:] = _TAIL, _LEAD
    after = np.full((4, 8), _OUT, np.uint8)
    after[:, [_LETTER, _NAME]] = _WORD
    after[:, _OPENING] = _OPENED
    after[_OPENED, _NAME] = _NAMED
    emit = np.full((4, 8), UNIT | POINT, np.uint8)
    emit[:, _TAIL] = emit[:, _EDGE] = 0
    for state in (_WORD, _NAMED):
        emit[state, [_LETTER, _NAME]] = POINT
    emit[_NAMED, _CLOSING] |= SENTINEL
    return kind, after, emit


KIND, NEXT, EMIT = _tables()


def scan(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """What the automaton emits at each byte of a block of texts; it starts anew at every text."""
    kind = KIND[data]
    state = np.full(len(data), _OUT, np.uint8)
    for lag in (2, 1):
        before = np.full(len(data), _EDGE, np.uint8)
        before[lag:] = kind[: max(len(data) - lag, 0)]
        for k in range(lag):  # bytes of the text before don't count
            at = offsets[:-1] + k
            before[at[at < offsets[1:]]] = _EDGE
        state = NEXT[state, before]
    return EMIT[state, kind]


def _cut(texts: pa.Array, draws: np.ndarray, spm_below: int, plain_from: int) -> pa.StructArray:
    """A block of texts and the four draws of each, transformed."""
    offsets, data = raw(texts)
    emitted = scan(offsets, data)
    starts = np.flatnonzero(emitted & UNIT)
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    sentinels = np.diff(np.searchsorted(np.flatnonzero(emitted & SENTINEL), offsets))
    points = np.concatenate([[0], np.cumsum((emitted & POINT) > 0)])
    plain = (n == 0) | (sentinels > 0) | (draws[2] % 100 >= plain_from)
    form = np.where(plain, "plain", np.where(draws[3] % 100 < spm_below, "spm", "psm"))
    cuts = np.sort(draws[:2] % (n + 1), axis=0)
    ends = np.append(starts, 0)
    a, b = (np.where(c == n, offsets[1:], ends[np.minimum(first[:-1] + c, len(starts))]) for c in cuts)
    whole, out = data.tobytes(), []
    for kind, lo, i, j, hi in zip(form.tolist(), offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist()):
        if kind == "plain":
            out.append(whole[lo:hi])
        elif kind == "psm":
            out.append(b"".join((b"<P>", whole[lo:i], b"<S>", whole[j:hi], b"<M>", whole[i:j])))
        else:
            out.append(b"".join((b"<S>", whole[j:hi], b"<P>", whole[lo:i], b"<M>", whole[i:j])))
    count = lambda x, y: pa.array(points[y] - points[x], pa.int64(), mask=plain)
    columns = [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), count(offsets[:-1], a), count(a, b), pa.array(out, pa.binary()).cast(pa.string())]
    return pa.StructArray.from_arrays(columns, names=["n", "form", "prefix_chars", "middle_chars", "output"])


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit integers of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", out: str = "fim", *, seed: int = 1, spm_below: int = SPM_BELOW, plain_from: int = PLAIN_FROM) -> DataFrame:
    """``docs`` and a struct column ``out``: n, form, prefix_chars, middle_chars, output.

    ``plain_from`` of 100 texts are transformed, ``spm_below`` of 100 of these with the suffix first.
    """

    @F.arrow_udf(RESULT)
    def cut(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        drawn = np.stack([h.to_numpy(zero_copy_only=False) for h in (h1, h2, h3, h4)])
        done = [_cut(p, drawn[:, at : at + len(p)], spm_below, plain_from) for at, p in pieces(texts)]
        return pa.concat_arrays(done) if done else _cut(texts, drawn, spm_below, plain_from)

    return docs.withColumn(out, cut(F.col(text_col), *draws(F.col(id_col), seed)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda *order: F.concat(*[F.get(parts, F.lit(i)) for i in order])
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = F.col("fim")
    digest = lambda c: F.sha2(c, 256)
    return done.select("doc_id", x["n"].alias("n"), x["form"].alias("form"), x["prefix_chars"].alias("prefix_chars"), x["middle_chars"].alias("middle_chars"), digest(x["output"]).alias("output_sha256"), digest(restored(x["output"], x["form"])).alias("restored_sha256"))


OP13_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
