"""Language identification by known words first, then progressively shorter character n-grams.

A document's words (runs of letters, lower-cased) are scored one by one. A word the model knows adds
its log frequency in each language. An unseen word adds the mean log frequency of its known character
n-grams of the longest order that has any (4, 3, 2, 1; the word is padded with a blank on both sides);
if it has none it adds nothing. The language with the largest sum wins, ties going to the first by
name. ``score`` is the winner's share in a softmax of the mean per word, sharpened by up to 20 words.

The model is fitted on a bounded sample: about ``per_lang`` training documents of each language, those
whose id hashes lowest. Its words and n-grams are what is broadcast, so that is bounded by the sample.

Defined cases. Null text or text without a letter: ``und``, score 0. Null lang: never learned from.
No training document at all: every prediction is ``und``. Null id: counts as the empty text where
folds are dealt. Repeated rows: each is predicted. Extra columns: ``identify`` only adds a column.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, table

PER_LANG, ORDERS, PIECE_BYTES = 400, (4, 3, 2, 1), 4 << 20
RESULT = "struct<lang_pred:string,score:double>"


def letter_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row offsets and the flat array of lower-cased words of texts; null counts as empty."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=r"\PL+", replacement=" ")
    lists = pc.split_pattern(pc.utf8_trim(plain, characters=" "), " ")
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(counts)), counts)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    per_row = np.bincount(rows[real], minlength=len(counts))
    return np.concatenate([[0], np.cumsum(per_row)]), flat.filter(pa.array(real))


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Slices of whole texts of about ``most`` bytes, one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + most, side="right")))
        yield texts.slice(start, end - start)
        start = end


def ngrams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        both = [counts[x] for x in self.langs]
        self.words, self.word_logs = self._table(both)
        self.grams = {}
        for n in ORDERS:
            grams = []
            for c in both:
                total: Counter = Counter()
                for w, k in c.items():
                    for g in ngrams(w, n):
                        total[g] += k
                grams.append(total)
            names, logs = self._table(grams)
            self.grams[n] = ({g: i for i, g in enumerate(names.to_pylist())}, logs)
        self.seen: dict[str, np.ndarray] = {}

    @staticmethod
    def _table(counts: list[Counter]) -> tuple[pa.Array, np.ndarray]:
        names = sorted(set().union(*counts))
        each = np.array([[c[x] for c in counts] for x in names], dtype=float).reshape(len(names), len(counts))
        logs = np.log((each + 0.1) / (each.sum(axis=0) + 0.1 * (len(names) + 1)))
        return pa.array(names, pa.string()), logs

    def unseen(self, word: str) -> np.ndarray:
        got = self.seen.get(word)
        if got is None:
            got = np.zeros(len(self.langs))
            for n in ORDERS:
                known, logs = self.grams[n]
                rows = [i for g in ngrams(word, n) if (i := known.get(g)) is not None]
                if rows:
                    got = logs[rows].mean(axis=0)
                    break
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = got
        return got

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        offsets, flat = letter_words(texts)
        n, names, share = len(texts), ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs or not len(flat):
            return names, share
        coded = flat.dictionary_encode()
        unique = coded.dictionary
        at = pc.fill_null(pc.index_in(unique, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        logs = self.word_logs[np.maximum(at, 0)]
        for i in np.flatnonzero(at < 0):
            logs[i] = self.unseen(unique[int(i)].as_py())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(n), np.diff(offsets))
        sums = np.stack([np.bincount(rows, weights=logs[codes, j], minlength=n) for j in range(len(self.langs))], axis=1)
        words = np.diff(offsets)
        best = sums.argmax(axis=1)
        sharp = sums * (np.minimum(words, 20) / np.maximum(words, 1))[:, None]
        soft = np.exp(sharp - sharp.max(axis=1, keepdims=True))
        top = (soft / soft.sum(axis=1, keepdims=True))[np.arange(n), best]
        for i in np.flatnonzero(words):
            names[i], share[i] = self.langs[best[i]], top[i]
        return names, share


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for b in batches:
        offsets, flat = letter_words(b.column("text"))
        langs = np.repeat(np.array(b.column("lang").to_pylist(), dtype=object), np.diff(offsets))
        total.update(zip(langs.tolist(), flat.to_pylist()))
    if total:
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "word", "n"])


def fit(train: DataFrame, *, per_lang: int = PER_LANG) -> Model:
    """Fit on ``train`` (doc_id, text, lang): about ``per_lang`` documents a language, those whose id hashes lowest."""
    train = train.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = train.groupBy("lang").count().collect()
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.length("text")), 11).cast("double") / float(1 << 53)
    keep = F.lit(False)
    for r in sizes:
        keep = keep | ((F.col("lang") == r["lang"]) & (unit < per_lang / r["count"]))
    counted = train.where(keep).select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {r["lang"]: Counter() for r in sizes}
    for r in counted.toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    return Model({k: c for k, c in counts.items() if c})


def predictor(spark: SparkSession, model: Model):
    """A column function: text to (lang_pred, score)."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for piece in pieces(texts):
            n, s = sent.value.predict(piece)
            names += n
            scores.append(s)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["lang_pred", "score"])

    return predict


def training(docs: DataFrame) -> DataFrame:
    return docs.where(id_bucket(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang")


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` and a struct column ``out`` of lang_pred and score."""
    return docs.withColumn(out, predictor(docs.sparkSession, model)(F.col(text_col)))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(training(docs)))
    held: Column = id_bucket(F.col("doc_id"), 3) == 1
    return found.select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score")
