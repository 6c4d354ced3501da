"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features (``FEATURES``) are densities of a given and of a learned lexicon, the densest passage, hits near
second-person words, capitals, punctuation and obfuscation rates. The learned lexicon holds words and word
beginnings by the log odds of their document frequency in toxic and clean labelled texts, so inflected forms
of an insult count as one. Features of labelled rows come from lexicons learned without their fold, so the
trees don't see a lexicon that knows its own row. Trees and calibration are fitted on different rows.

What is learned from is bounded: at most about ``per_class`` labelled rows of each class, those whose id
hashes lowest, weighted by what they stand for; equal texts count once. The lexicon is bounded by ``terms``.
Both are parameters, and they bound what is collected and sent out. Every text is scored, whole.

Defined cases. Null or empty text: scored, all features 0. Null labels and labels without a document: not
learned from; several labels of one id: toxic if any is. Null id: counts as the empty text where folds are
dealt, and never has a label. No labelled rows, or one class only: the score is the share of toxic rows (0 if
none). Too few rows of a class to calibrate: the trees' probability. Repeated rows: each is scored. Extra
columns: ``Model.score`` only adds a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, staged, table, unused
from .textvec import pieces, raw

PER_CLASS, TERMS, FOLDS, SUPPORT = 30_000, 2_000, 3, 3
LENGTHS = range(3, 9)
GIVEN = (
    "idiot", "moron", "stupid", "loser", "clown", "scum", "trash", "pathetic", "worthless", "disgusting", "dumb", "jerk", "fool", "bastard", "bitch", "asshole",
    "idiotin", "dumm", "blöd", "trottel", "arschloch", "abschaum", "versager", "depp", "widerlich", "dummkopf",
    "imbécile", "connard", "crétin", "ordure", "minable", "débile", "salaud", "abruti",
    "estúpido", "imbécil", "tonto", "basura", "inútil", "asqueroso", "perdedor", "cabrón",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos",
    "tú", "ti", "usted", "ustedes", "vosotros",
)
FEATURES = (
    "given", "learned", "strong", "mean_weight", "strong_count", "strong_distinct", "densest", "near_second_person", "second_person", "capitals", "shouted", "exclamations",
    "punctuation", "obfuscated", "obfuscated_hits", "stretched", "single_letters", "words",
)
LEARNED, STRONG, NEAR, WINDOW = float(np.log(4)), 3.0, 5, 40

_LEET = str.maketrans("0134578@$!", "oieastbasi")
_UPPER, _ALPHA, _PUNCT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _ALPHA[65:91] = _ALPHA[97:123] = True
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "!"]] = True


@dataclass
class Words:
    """Tokens of a block of texts: first token (n + 1) of each row, the code of each, and by code its letters, tail, and flags."""

    rows: np.ndarray
    codes: np.ndarray
    forms: pa.Array
    tails: pa.Array
    odd: np.ndarray
    shouted: np.ndarray
    single: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        lists = pc.utf8_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
        coded = lists.flatten().dictionary_encode()
        seen = coded.dictionary
        lower = pc.utf8_lower(seen)
        core = pc.replace_substring_regex(lower, pattern=r"^\PL+|\PL+$", replacement="")
        odd = pc.match_substring_regex(lower, pattern=r"\pL\PL+\pL").to_numpy(zero_copy_only=False)
        forms, tails = core, pa.array([""] * len(core), pa.string())
        if odd.any():
            mask = pa.array(odd)
            plain = pa.array(["".join(c for c in w.translate(_LEET) if c.isalpha()) for w in lower.filter(mask).to_pylist()], pa.string())
            forms = pc.replace_with_mask(core, mask, plain)
            tails = pc.replace_with_mask(tails, mask, pc.replace_substring_regex(core.filter(mask), pattern=r"^.*\PL", replacement=""))
        letters = pc.utf8_length(core).to_numpy(zero_copy_only=False)
        shouted = pc.equal(pc.utf8_upper(seen), seen).to_numpy(zero_copy_only=False) & (letters >= 3)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        return cls(np.concatenate([[0], np.cumsum(n)]), coded.indices.to_numpy(zero_copy_only=False), forms, tails, odd, shouted, letters == 1)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def terms(self) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """(code of the term of each word by its code, -1 for none; the terms), for each length of beginnings and for whole words."""
        length = pc.utf8_length(self.forms).to_numpy(zero_copy_only=False)
        for n in (*LENGTHS, 0):
            term = pc.utf8_slice_codeunits(self.forms, 0, n) if n else pc.binary_join_element_wise(self.forms, "$", "")
            coded = term.dictionary_encode()
            yield np.where(length >= max(n, 1), coded.indices.to_numpy(zero_copy_only=False), -1), coded.dictionary


class Lexicon:
    """Weights of words and word beginnings."""

    def __init__(self, weights: dict[str, float]):
        self.terms = pa.array(list(weights), pa.string())
        self.weights = np.append(np.fromiter(weights.values(), float, len(weights)), 0.0)

    def weigh(self, words: pa.Array) -> np.ndarray:
        """The highest weight of any term that a word is or begins with."""
        best = np.zeros(len(words))
        for n in (*LENGTHS, 0):
            term = pc.utf8_slice_codeunits(words, 0, n) if n else pc.binary_join_element_wise(words, "$", "")
            at = pc.fill_null(pc.index_in(term, value_set=self.terms), len(self.terms)).to_numpy(zero_copy_only=False)
            best = np.maximum(best, self.weights[at])
        return best


_GIVEN, _SECOND = pa.array(GIVEN, pa.string()), pa.array(SECOND_PERSON, pa.string())


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` a text."""
    w, rows = Words.of(texts), len(texts)
    row, out = w.row_of(), np.zeros((rows, len(FEATURES)))
    isin = lambda words, values: pc.is_in(words, value_set=values).to_numpy(zero_copy_only=False)
    real = pc.not_equal(w.forms, "").to_numpy(zero_copy_only=False)
    weight = np.maximum(lexicon.weigh(w.forms), lexicon.weigh(w.tails))
    given = isin(w.forms, _GIVEN) | isin(w.tails, _GIVEN)
    hit = given | (weight >= LEARNED)
    strong = given | (weight >= STRONG)
    second = isin(w.forms, _SECOND)
    tally = lambda flags: np.bincount(row, weights=flags[w.codes], minlength=rows)
    n = np.maximum(tally(real), 1)
    total = {name: tally(x) for name, x in (("given", given), ("learned", hit), ("strong", strong), ("mean_weight", weight), ("second_person", second), ("shouted", w.shouted), ("obfuscated", w.odd), ("obfuscated_hits", w.odd & hit), ("single_letters", w.single))}

    at = np.flatnonzero(hit[w.codes])  # places of hits
    # The densest passage: hits within WINDOW words of a hit, from it on, in its own text.
    until = np.minimum(at + WINDOW, w.rows[1:][row[at]])
    np.maximum.at(out[:, FEATURES.index("densest")], row[at], (np.searchsorted(at, until) - np.arange(len(at))) / WINDOW)
    you = np.flatnonzero(second[w.codes])
    low, high = np.maximum(at - NEAR, w.rows[:-1][row[at]]), np.minimum(at + NEAR + 1, w.rows[1:][row[at]])
    near = np.searchsorted(you, high) > np.searchsorted(you, low)
    total["near_second_person"] = np.bincount(row[at], weights=near, minlength=rows)
    for name, x in total.items():
        out[:, FEATURES.index(name)] = x / n
    key = np.unique(row[at].astype(np.int64) * max(len(w.forms), 1) + w.codes[at]) if len(at) else np.zeros(0, np.int64)
    key = key[strong[key % max(len(w.forms), 1)]]
    out[:, FEATURES.index("strong_distinct")] = np.log1p(np.bincount(key // max(len(w.forms), 1), minlength=rows))
    out[:, FEATURES.index("strong_count")] = np.log1p(total["strong"])
    out[:, FEATURES.index("words")] = np.log1p(tally(real))

    offsets, data = raw(texts)
    size = np.maximum(np.diff(offsets), 1)
    each = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    alpha = _ALPHA[data]
    out[:, FEATURES.index("capitals")] = each(_UPPER[data]) / np.maximum(each(alpha), 1)
    out[:, FEATURES.index("exclamations")] = each(data == ord("!")) / size
    out[:, FEATURES.index("punctuation")] = each(_PUNCT[data]) / size
    same = np.zeros(len(data), bool)
    same[2:] = alpha[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    out[:, FEATURES.index("stretched")] = each(same) / size
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by term, fold and class."""
    for b in batches:
        group = (b.column("fold").to_numpy() * 2 + b.column("toxic").to_numpy()).astype(np.int64)
        for start, piece in pieces(b.column("text")):
            w = Words.of(piece)
            row, mine = w.row_of(), group[start : start + len(piece)]
            for by_code, names in w.terms():
                term = by_code[w.codes].astype(np.int64)
                key = np.unique(row[term >= 0].astype(np.int64) * max(len(names), 1) + term[term >= 0])
                cell, docs = np.unique(key % max(len(names), 1) * (2 * FOLDS) + mine[key // max(len(names), 1)], return_counts=True)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(cell // (2 * FOLDS))), pa.array(cell % (2 * FOLDS), pa.int64()), pa.array(docs, pa.int64())], names=["term", "cell", "docs"])


def lexicons(sample: DataFrame, *, terms: int = TERMS, support: int = SUPPORT) -> list[Lexicon]:
    """Of ``sample`` (text, fold, toxic): one lexicon without each fold, then that of all folds."""
    sizes = np.zeros(2 * FOLDS)
    for r in sample.groupBy("fold", "toxic").count().collect():
        sizes[r["fold"] * 2 + r["toxic"]] = r["count"]
    cells = [F.sum(F.when(F.col("cell") == i, F.col("docs")).otherwise(0)).alias(f"c{i}") for i in range(2 * FOLDS)]
    counted = sample.select("text", "fold", "toxic").mapInArrow(_count_terms, "term string, cell long, docs long").groupBy("term").agg(*cells)
    counted = staged(counted.where(sum(F.col(f"c{2 * i + 1}") for i in range(FOLDS)) >= support), "terms")
    out = []
    for left_out in (*range(FOLDS), None):
        folds = [i for i in range(FOLDS) if i != left_out]
        toxic, clean = (sum(F.col(f"c{2 * i + c}") for i in folds) for c in (1, 0))
        n_toxic, n_clean = (sum(sizes[2 * i + c] for i in folds) for c in (1, 0))
        odds = F.log((toxic + 0.5) / F.lit(n_toxic + 1.0)) - F.log((clean + 0.5) / F.lit(n_clean + 1.0))
        rated = counted.select("term", odds.alias("odds"), toxic.alias("toxic")).where((F.col("toxic") >= support) & (F.col("odds") >= LEARNED))
        top = rated.orderBy((F.col("odds") * F.col("toxic")).desc(), "term").limit(terms).collect()
        out.append(Lexicon({r["term"]: r["odds"] for r in top}))
    return out


def sampled(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> DataFrame:
    """text, toxic, weight, fold, calibrates: labelled texts, equal ones once, at most about ``per_class`` of a class."""
    each = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in each.groupBy("toxic").count().collect()}
    share = {c: min(1.0, per_class / max(sizes.get(c, 0), 1)) for c in (0, 1)}
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)
    of_class = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    chosen = each.where(unit < of_class).withColumn("weight", 1.0 / of_class)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about two times per_class rows at most
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    once = found.select("text", "toxic", "weight", h.alias("h")).dropDuplicates(["h", "toxic"])
    return once.select("text", "toxic", "weight", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), (F.pmod(F.shiftright("h", 16), F.lit(4)) == 0).alias("calibrates"))


@dataclass
class Model:
    """A lexicon, trees (None: the constant share) and calibration (None: the trees' probability)."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    share: float

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        if self.trees is None:
            return docs.withColumn(out, F.lit(self.share))
        sent = docs.sparkSession.sparkContext.broadcast(self.lexicon)

        @F.arrow_udf("array<double>")
        def dense(texts: pa.Array) -> pa.Array:
            done = [features(p, sent.value) for _, p in pieces(texts)]
            flat = np.concatenate(done) if done else np.zeros((0, len(FEATURES)))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(FEATURES), pa.int32()), pa.array(flat.ravel(), pa.float64()))

        x = unused(docs, "features")
        return self.calibrated(docs.withColumn(x, array_to_vector(dense(F.col(text_col)))), x, out).drop(x)

    def calibrated(self, rows: DataFrame, x: str, out: str) -> DataFrame:
        """The score of feature vectors."""
        p, q = unused(rows, "probability"), unused(rows, "raw")
        each = self.trees.copy().setFeaturesCol(x).setProbabilityCol(p).setRawPredictionCol(q).setPredictionCol("").transform(rows)
        each = each.withColumn(p, vector_to_array(p)[1]).drop(q)
        if self.curve is None:
            return each.withColumnRenamed(p, out)
        return self.curve.copy().setFeaturesCol(p).setPredictionCol(out).transform(each).drop(p)


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, terms: int = TERMS, trees: int = 40) -> Model:
    """Fit on labelled documents (doc_id, text; doc_id, toxic)."""
    sample = staged(sampled(docs, labels, per_class=per_class), "labelled", rows=2 * per_class)
    counts = {(r["toxic"], r["calibrates"]): r["count"] for r in sample.groupBy("toxic", "calibrates").count().collect()}
    n = [sum(c for (t, _), c in counts.items() if t == k) for k in (0, 1)]
    if not all(counts.get((t, False)) for t in (0, 1)):
        return Model(Lexicon({}), None, None, n[1] / max(sum(n), 1))
    learned = lexicons(sample, terms=terms)
    sent = sample.sparkSession.sparkContext.broadcast(learned)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column("fold").to_numpy()
            for k in range(FOLDS):
                mine = b.filter(pa.array(fold == k))
                for at, piece in pieces(mine.column("text")):
                    x = features(piece, sent.value[k])
                    rows = mine.slice(at, len(piece))
                    yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), *[rows.column(c) for c in ("toxic", "weight", "calibrates")]], names=["x", "toxic", "weight", "calibrates"])

    made = staged(sample.mapInArrow(dense, "x array<double>, toxic int, weight double, calibrates boolean"), "features", rows=2 * per_class)
    rows = made.select(array_to_vector("x").alias("x"), F.col("toxic").cast("double").alias("toxic"), "weight", "calibrates")
    grown = GBTClassifier(featuresCol="x", labelCol="toxic", weightCol="weight", maxIter=trees, maxDepth=3, stepSize=0.2, minInstancesPerNode=4, maxBins=64, seed=11).fit(rows.where("NOT calibrates"))
    model = Model(learned[-1], grown, None, n[1] / sum(n))
    if all(counts.get((t, True), 0) >= 5 for t in (0, 1)):
        held = model.calibrated(rows.where("calibrates"), "x", "p").select("p", "toxic", "weight")
        model.curve = IsotonicRegression(featuresCol="p", labelCol="toxic", weightCol="weight").fit(held)
    return model


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold: Column = id_bucket(F.col("doc_id"), 4)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold != 2)
    model = fit(docs.where(fold != 2), labels)
    scored = model.score(docs)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
