"""Language-model scoring with a probabilistic suffix tree over the bytes of a document's words.

Text is lower-cased (A-Z), cut in words at ASCII white space, and read as bytes: each word and a blank,
a line feed as the end. The tree predicts every byte from what precedes it; before the text stands a
run of line feeds. So a token is a word with its blank, or the end, and has the probability of its bytes.

Learning. All strings of six bytes of the training documents are counted; five bytes of context and
the next one. Shorter contexts follow by adding up. A context stays in the tree if it makes up at least
``least_share`` of all places and passes a divergence test: its count times the Kullback-Leibler
divergence of its next-byte distribution from that of its parent (the context without its first byte)
reaches ``least_gain`` nats; parents of what stays, stay. So a depth has at most 1 / least_share contexts,
which bounds what is broadcast whatever the corpus.

Scoring. Each byte is predicted by the longest context in the tree that is a suffix of its past, with
Witten-Bell smoothing: (n(x) + kinds * P_parent(x)) / (n + kinds), down to the single bytes, which are
smoothed by 0.5 over 256 values. ``score`` is the sum of the log10 probabilities of all bytes; the
distribution over token sequences is proper.

The unigram base score needs every training word's count. Chunks of documents send their distinct word
hashes with counts, dealt out by hash; each gets the totals back in the same order. A word in a third of
all documents is one entry a chunk.

Defined cases. Null text: empty, one end token. Null id: held out if crc32 of the empty text says so
(it does). No training documents: N and V are 0, every byte has probability 1/256. Repeated rows: one
result row each. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, staged, table
from .textvec import pieces, word_hashes

DEPTH, LEAST_SHARE, LEAST_GAIN, FOLDS = 5, 1e-6, 3.0, 10
CHUNK_BYTES = 4 << 20
END = np.uint64(0x0E4D0E4D0E4D0E4D)
_PAD = b"\n" * DEPTH


def streams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The six-byte strings (packed in integers) of all places of the texts, and the first place (n + 1) of each."""
    parts = [_PAD + b" ".join([*(t or "").encode().lower().split(), b"\n"]) for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    size = np.array([len(p) for p in parts], np.int64)
    n = len(data) - DEPTH
    key = np.zeros(max(n, 0), np.uint64)
    for j in range(DEPTH + 1):
        key = (key << np.uint64(8)) | data[j : n + j]
    ends = np.cumsum(size)
    inside = np.ones(len(data), bool)
    for j in range(DEPTH):
        inside[ends - 1 - j] = False  # a string that starts here runs into the next text
    return key[inside[:n]], np.concatenate([[0], np.cumsum(size - DEPTH)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merged(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        return k[start], np.add.reduceat(n, start) if len(start) else n

    for b in batches:
        for _, piece in pieces(b.column("text"), CHUNK_BYTES):
            k = np.sort(streams(piece.to_pylist())[0])
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            keys, counts = merged(np.concatenate([keys, k[start]]), np.concatenate([counts, np.diff(np.append(start, len(k)))]))
            if len(keys) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])


class Tree:
    """Contexts and next bytes by depth, as sorted arrays."""

    def __init__(self, rows: np.ndarray):
        """rows: depth, packed context and byte, count, count of the context, kinds of next bytes."""
        self.root = np.full(256, 1 / 256)
        self.levels = []
        for d in range(DEPTH + 1):
            r = rows[rows[:, 0] == d]
            r = r[np.argsort(r[:, 1])]
            if d == 0:
                n = np.zeros(256)
                n[r[:, 1]] = r[:, 2]
                self.root = (n + 0.5) / (n.sum() + 128)
            else:
                context = r[:, 1] >> 8
                first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(r) else np.zeros(0, np.int64)
                self.levels.append((context[first], r[first, 3], r[first, 4], r[:, 1].copy(), r[:, 2].copy()))
        self.table_key = None

    def _exact(self, key: np.ndarray) -> np.ndarray:
        key = key.astype(np.int64)
        p = self.root[key & 255]
        alive = np.arange(len(key))
        for d, (contexts, total, kinds, pairs, counts) in enumerate(self.levels, 1):
            if not len(contexts) or not len(alive):
                break
            pair = key[alive] & ((1 << 8 * (d + 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, pair >> 8), len(contexts) - 1)
            known = contexts[at] == pair >> 8
            alive, pair, at = alive[known], pair[known], at[known]
            spot = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            n = np.where(pairs[spot] == pair, counts[spot], 0)
            p[alive] = (n + kinds[at] * p[alive]) / (total[at] + kinds[at])
        return np.log10(p)

    def logs(self, key: np.ndarray, bits: int = 20) -> np.ndarray:
        """log10 probabilities; a table of recently seen strings saves most searches."""
        if self.table_key is None:
            self.table_key, self.table_log = np.full(1 << bits, np.uint64(1 << 63)), np.zeros(1 << bits)
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        out = self.table_log[slot]
        miss = np.flatnonzero(self.table_key[slot] != key)
        if len(miss):
            some, back = np.unique(key[miss], return_inverse=True)
            found = self._exact(some)
            out[miss] = found[back]
            at = ((some * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
            self.table_key[at], self.table_log[at] = some, found
            # where two strings fell in one slot the last one written has both
            self.table_log[at] = np.where(self.table_key[at] == some, found, self.table_log[at])
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        key, first = streams(texts)
        return np.add.reduceat(self.logs(key), first[:-1]) if len(texts) else np.zeros(0)

    def __getstate__(self):
        return {"root": self.root, "levels": self.levels, "table_key": None}


def learn(train: DataFrame, *, least_share: float = LEAST_SHARE, least_gain: float = LEAST_GAIN) -> Tree:
    """Fit the tree on all texts of ``train``."""
    grams = train.select("text").mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    cut = [F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("pair")) for d in range(DEPTH + 1)]
    pairs = grams.select("n", F.explode(F.array(*cut)).alias("x")).groupBy("x.d", "x.pair").agg(F.sum("n").alias("n"))
    pairs = staged(pairs.withColumn("context", F.shiftright("pair", 8)), "pst-pairs")
    places = pairs.where("d = 0").agg(F.sum("n")).first()[0] or 0
    nodes = pairs.groupBy("d", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where((F.col("d") == 0) | (F.col("total") >= max(2.0, least_share * places)))
    nodes = staged(nodes, "pst-nodes")
    frequent = staged(pairs.join(nodes, ["d", "context"]), "pst-frequent")
    parent = frequent.select((F.col("d") + 1).alias("d"), F.col("pair").alias("tail"), (F.col("n") / F.col("total")).alias("q"))
    tail = F.expr("pair & (shiftleft(1L, 8 * d) - 1)")
    p = F.col("n") / F.col("total")
    gains = frequent.where("d > 0").withColumn("tail", tail).join(parent, ["d", "tail"]).groupBy("d", "context").agg(F.sum(F.col("n") * F.ln(p / F.col("q"))).alias("gain"))
    kept = gains.where(F.col("gain") >= least_gain).select("d", "context")
    closed = kept.select(F.explode(F.sequence(F.lit(1), F.col("d"))).alias("d"), "context").select("d", F.expr("context & (shiftleft(1L, 8 * d) - 1)").alias("context"))
    closed = closed.union(kept.sparkSession.range(1).select(F.lit(0).alias("d"), F.lit(0).cast("long").alias("context"))).distinct()
    rows = frequent.join(closed, ["d", "context"]).select(F.col("d").cast("long").alias("d"), "pair", "n", "total", "kinds").toArrow()
    return Tree(np.stack([c.to_numpy() for c in rows.columns], axis=1) if rows.num_rows else np.zeros((0, 5), np.int64))


def _held(doc) -> bool:
    return zlib.crc32(str(doc).encode() if doc is not None else b"") % FOLDS == 0


def _words(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the chunk's documents in their order: first token (n + 1), hashes (ends included), and whether each is for training."""
    rows, h = word_hashes(docs.column("text").combine_chunks())
    n = np.diff(rows)
    first = rows + np.arange(len(rows))
    out = np.empty(first[-1], np.uint64)
    ends = first[1:] - 1
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = h, END
    train = np.repeat([not _held(d) for d in docs.column("doc_id").to_pylist()], n + 1)
    return first, out, train


def _distinct(docs: pa.Table, buckets: int):
    """Distinct hashes grouped by bucket, with counts in training documents: (hashes, counts, bucket cuts)."""
    first, h, train = _words(docs)
    u, back = np.unique(h, return_inverse=True)
    counts = np.bincount(back, weights=train, minlength=len(u)).astype(np.int64)
    bucket = (u % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(u) else np.zeros(0, np.int64)
    return first, back, u[order], counts[order], bucket[order], cut, order


def _send(buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        _, _, u, counts, bucket, cut, _ = _distinct(docs, buckets)
        ends = np.append(cut[1:], len(u))
        data = [u[a:b].tobytes() for a, b in zip(cut, ends)]
        n = [counts[a:b].astype(np.int32).tobytes() for a, b in zip(cut, ends)]
        key = docs.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array(bucket[cut], pa.int64()), "chunk": pa.array([key] * len(cut), pa.int64()), "data": pa.array(data, pa.binary()), "n": pa.array(n, pa.binary())})

    return run


def _total(rows: pa.Table) -> pa.Table:
    """Each sender's hashes' totals, in the order sent; the first row carries the bucket's N and V."""
    data = [np.frombuffer(x, np.uint64) for x in rows.column("data").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in rows.column("n").to_pylist()])
    u, back = np.unique(np.concatenate(data), return_inverse=True)
    total = np.bincount(back, weights=counts, minlength=len(u)).astype(np.int64)
    sent = total[back]
    cut = np.cumsum([0, *map(len, data)])
    k = len(data)
    return pa.table({
        "chunk": rows.column("chunk").combine_chunks().cast(pa.int64()), "bucket": rows.column("bucket").combine_chunks().cast(pa.int64()),
        "data": pa.array([sent[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
        "tokens": pa.array([int(total.sum())] + [0] * (k - 1), pa.int64()), "kinds": pa.array([int((total > 0).sum())] + [0] * (k - 1), pa.int64()),
    })


def _score(buckets: int, tree, tokens: int, kinds: int):
    share = np.log10(tokens + 0.1 * (kinds + 1))

    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        ids = docs.column("doc_id").to_pylist()
        if not ids:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        first, back, u, _, _, _, order = _distinct(docs, buckets)
        pairs = sorted(zip(notes.column("bucket").to_pylist(), notes.column("data").to_pylist()))
        c = np.empty(len(u), np.int64)
        c[order] = np.concatenate([np.frombuffer(x, np.int64) for _, x in pairs])
        logs, known = np.log10(c + 0.1) - share, c > 0
        base = np.add.reduceat(logs[back], first[:-1])
        n_known = np.add.reduceat(known[back].astype(np.int64), first[:-1])
        texts = docs.column("text").combine_chunks()
        score = np.concatenate([tree.value.score(p.to_pylist()) for _, p in pieces(texts, 1 << 20)])
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([_held(d) for d in ids], pa.bool_()), "n_tokens": pa.array(np.diff(first)), "n_known": pa.array(n_known),
            "train_tokens": pa.array([tokens] * len(ids), pa.int64()), "base_score": pa.array(base), "score": pa.array(score),
        })

    return run


def score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, learning from documents that aren't held out."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tree = spark.sparkContext.broadcast(learn(docs.where(id_bucket(F.col("doc_id"), FOLDS) != 0)))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_chunks = max(1, -(-total // CHUNK_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n_chunks, 20_000))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks)).alias("chunk"), "doc_id", "text").repartition(parts, "chunk")
    sent = dealt.groupBy("chunk").applyInArrow(_send(n_chunks), "bucket long, chunk long, data binary, n binary")
    back = staged(sent.groupBy("bucket").applyInArrow(_total, "chunk long, bucket long, data binary, tokens long, kinds long"), "pst-words")
    tokens, kinds = back.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(back.select("chunk", "bucket", "data").repartition(parts, "chunk").groupBy("chunk")).applyInArrow(_score(n_chunks, tree, tokens, kinds), schema)


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
