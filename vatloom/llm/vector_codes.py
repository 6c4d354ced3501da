"""Compressed vectors: a code of one byte a part, with codebooks learned by integer k-means.

Vectors become integers (floor of the scaled component) and are cut into equal parts. Each part position has
a codebook. Nearest entries are found in a vantage-point tree of the codebook: a node keeps an entry and the
range of distances from it on either side; a part first goes down to one leaf, then visits every node whose
lower bound is not above its best distance. Radii and bounds are rounded outwards and the comparison is not
strict, so no entry that could be nearest, or tie, is passed over; distances at leaves are exact integers, and
of equal ones the lower index wins. A round sums parts by entry in every task; only those sums, one row an
entry and component, reach the driver, and codebooks (entries times dimensions) are what it sends out.

Defined cases. Dropped: null vectors, null or non-finite components, vectors whose length differs from that of
the smallest kept id, and lengths that ``parts`` doesn't divide. Nothing kept: no rows. Fewer vectors than
entries: a codebook has as many entries as there are vectors. Repeated ids: each row is a vector; ties for the
first entries go by the vector. Null ids come last. Components beyond ``bound`` (for 64 dimensions about 185
million after scaling) count as the bound, so that every distance fits a long; a sum over labels that doesn't
fit is null. Null labels are one label. Extra columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

PARTS, ENTRIES, ROUNDS, SCALE, LEAF, BLOCK, SENT_LABELS = 4, 256, 4, 1024, 16, 4096, 100_000
RESULT = "struct<code:string,error:long>"
_SLACK = 2.0**-48  # far above the rounding of a square root or a difference


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries: in doubles where every term is an exact integer there, else in longs."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(points.shape[1], 1) < 1 << 53:
        p, e = points.astype(float), entries.astype(float)
        return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)).astype(np.int64)
    out = np.zeros((len(points), len(entries)), np.int64)
    for j in range(points.shape[1]):
        gap = points[:, j, None] - entries[None, :, j]
        out += gap * gap
    return out


def _up(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x) * (1 + _SLACK)


def _down(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x) * (1 - _SLACK)


@dataclass
class Node:
    """A leaf of entry numbers, or a vantage entry and two sides with the least and largest distance of each."""

    leaf: np.ndarray | None = None
    vantage: np.ndarray | None = None
    sides: list = field(default_factory=list)


class Tree:
    """The entries of one part position."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.size = entries, leaf
        self.root = self._build(np.arange(len(entries)))

    def _build(self, at: np.ndarray) -> Node:
        if len(at) <= self.size:
            return Node(leaf=np.sort(at))
        here = self.entries[at]
        vantage = here[squares(here, here[:1])[:, 0].argmax()]
        far = squares(here, vantage[None])[:, 0]
        order = np.argsort(far, kind="stable")
        sides = [(self._build(at[o]), _down(far[o].min()), _up(far[o].max())) for o in (order[: len(at) // 2], order[len(at) // 2 :])]
        return Node(vantage=vantage, sides=sides)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every point, the lower index of equal ones, and the squared distance."""
        which, best = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
        for start in range(0, len(points), BLOCK):
            block = slice(start, start + BLOCK)
            self._search(points[block], which[block], best[block])
        return which, best

    def _search(self, points: np.ndarray, which: np.ndarray, best: np.ndarray) -> None:
        seen = np.full(len(points), -1)  # the leaf that a point went down to

        def look(node: Node, rows: np.ndarray) -> None:
            dist = squares(points[rows], self.entries[node.leaf])
            k = dist.argmin(axis=1)
            dist, entry = dist[np.arange(len(rows)), k], node.leaf[k]
            better = (dist < best[rows]) | (dist == best[rows]) & (entry < which[rows])
            best[rows[better]], which[rows[better]] = dist[better], entry[better]

        def descend(node: Node, rows: np.ndarray) -> None:
            if node.leaf is not None:
                look(node, rows)
                seen[rows] = node.leaf[0]
                return
            near = np.sqrt(squares(points[rows], node.vantage[None])[:, 0]) <= node.sides[1][1]
            for (side, _, _), chosen in zip(node.sides, (near, ~near)):
                if chosen.any():
                    descend(side, rows[chosen])

        def visit(node: Node, rows: np.ndarray) -> None:
            if node.leaf is not None:
                look(node, rows[seen[rows] != node.leaf[0]])
                return
            far = squares(points[rows], node.vantage[None])[:, 0]
            low, high = _down(far), _up(far)
            for side, least, most in node.sides:
                open_ = np.maximum(least - high, low - most) <= _up(best[rows])
                if open_.any():
                    visit(side, rows[open_])

        every = np.arange(len(points))
        descend(self.root, every)
        visit(self.root, every)


@dataclass
class Codebooks:
    """Entries by part, entry and position; the scale and bound of components."""

    entries: np.ndarray
    scale: int
    bound: int

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[Tree]:
        return [Tree(e) for e in self.entries]


def integers(vectors: pa.Array, dims: int, scale: int, bound: int) -> np.ndarray:
    """Rows of integer components."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * scale), -bound, bound).astype(np.int64)


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector has components, all of them finite."""
    return vectors.where((F.size(vec_col) > 0) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def _sums(trees_of, dims: int, parts: int, scale: int, bound: int):
    """Sums by part and entry of all that a task reads; position 0 counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = trees_of.value.trees()
        k, w = len(trees[0].entries), dims // parts
        total = np.zeros((parts, k, w + 1), np.int64)
        for b in batches:
            x = integers(b.column(0), dims, scale, bound)
            for p, tree in enumerate(trees):
                part = x[:, p * w : (p + 1) * w]
                which, _ = tree.nearest(part)
                order = np.argsort(which, kind="stable")
                used, first = np.unique(which[order], return_index=True)
                if len(used):
                    total[p, used, 1:] += np.add.reduceat(part[order], first, axis=0)
                    total[p, used, 0] += np.diff(np.append(first, len(order)))
        p, e = np.nonzero(total[:, :, 0])
        each = [np.repeat(p, w + 1), np.repeat(e, w + 1), np.tile(np.arange(w + 1), len(p)), total[p, e].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in each], names=["part", "entry", "position", "total"])

    return add


def train(vectors: DataFrame, id_col: str, vec_col: str, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds, from the parts of the ``entries`` (256 at most) smallest ids; None without a vector."""
    spark, kept = vectors.sparkSession, usable(vectors, vec_col).where(F.size(vec_col) % parts == 0)
    first = kept.select(id_col, vec_col).orderBy(F.col(id_col).asc_nulls_last(), vec_col)
    head = first.limit(1).collect()
    if not head:
        return None
    dims = len(head[0][1])
    bound, width = isqrt((1 << 61) // dims), dims // parts
    kept = kept.where(F.size(vec_col) == dims).select(vec_col)
    start = first.where(F.size(vec_col) == dims).limit(min(entries, 256)).select(vec_col).toArrow().column(0).combine_chunks()
    books = Codebooks(integers(start, dims, scale, bound).reshape(-1, parts, width).swapaxes(0, 1), scale, bound)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        sums = kept.mapInArrow(_sums(sent, dims, parts, scale, bound), "part long, entry long, position long, total long").groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).toArrow()
        p, e, j, t = (sums.column(c).to_numpy() for c in ("part", "entry", "position", "total"))
        total = np.zeros((*books.entries.shape[:2], width + 1), np.int64)
        total[p, e, j] = t
        used = total[:, :, :1] > 0
        books = Codebooks(np.where(used, total[:, :, 1:] // np.maximum(total[:, :, :1], 1), books.entries), scale, bound)
    return books


def encoder(spark: SparkSession, books: Codebooks):
    """A column function: vector to (code, error)."""
    sent, kept = spark.sparkContext.broadcast(books), {}
    digits = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)

    @F.arrow_udf(RESULT)
    def encode(vectors: pa.Array) -> pa.Array:
        b = sent.value
        trees = kept.get("trees") or kept.setdefault("trees", b.trees())
        x, w = integers(vectors, b.dims, b.scale, b.bound), b.entries.shape[2]
        found = [t.nearest(x[:, p * w : (p + 1) * w]) for p, t in enumerate(trees)]
        text = digits[np.stack([f[0] for f in found], axis=1)].tobytes()
        ends = np.arange(len(x) + 1, dtype=np.int32) * (2 * len(trees))
        code = pa.Array.from_buffers(pa.string(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(text)])
        return pa.StructArray.from_arrays([code, pa.array(sum(f[1] for f in found), pa.int64())], names=["code", "error"])

    return encode


def compress(vectors: DataFrame, books: Codebooks, vec_col: str, out: str = "compressed") -> DataFrame:
    """The rows whose vector the codebooks fit, and a struct column ``out`` of code and error."""
    kept = usable(vectors, vec_col).where(F.size(vec_col) == books.dims)
    return kept.withColumn(out, encoder(vectors.sparkSession, books)(F.col(vec_col)))


def summed_over(coded: DataFrame, label: str, error: str, out: str) -> DataFrame:
    """``coded`` and the sum of ``error`` over its label: sent to all tasks if there are few labels, else joined, where hot labels are split."""
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.try_sum(error).alias(out))
    few = sums.limit(SENT_LABELS + 1).count() <= SENT_LABELS
    same: Column = coded[label].eqNullSafe(F.col("_label"))
    return coded.join(F.broadcast(sums) if few else sums, same).drop("_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = train(vectors, "vec_id", "embedding")
    if books is None:
        return vectors.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    coded = staged(compress(vectors, books, "embedding").select("vec_id", "label", "compressed.code", "compressed.error"), "codes")
    return summed_over(coded, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """k-means in SQL: squared distances of integers below 2^53 are exact in doubles."""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "p AS MATERIALIZED (SELECT vec_id, label, q, x[q * (len(x) // 4) + 1:(q + 1) * (len(x) // 4)] AS x FROM v, (SELECT unnest([0, 1, 2, 3]) AS q))",
        "c0 AS MATERIALIZED (SELECT q, e, x FROM (SELECT q, x, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS e FROM p) WHERE e < 256)",
    ]
    for r in range(5):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p.q, min(CAST(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT) * 256 + c.e) AS k FROM p JOIN c{r} c ON c.q = p.q GROUP BY vec_id, p.q)")
        if r < 4:
            steps.append(f"s{r} AS MATERIALIZED (SELECT q, e, list(floor(t / n) ORDER BY i) AS x FROM (SELECT q, e, i, sum(y) AS t, count(*) AS n FROM (SELECT p.q, a.k % 256 AS e, unnest(p.x) AS y, unnest(range(1, len(p.x) + 1)) AS i FROM p JOIN a{r} a ON a.vec_id = p.vec_id AND a.q = p.q) GROUP BY q, e, i) GROUP BY q, e)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.q, c.e, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN s{r} s ON s.q = c.q AND s.e = c.e)")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY q, e)) AS h FROM c4)")
    steps.append("r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', k % 256), '' ORDER BY a4.q) AS code, CAST(sum(k // 256) AS BIGINT) AS error FROM a4 JOIN p USING (vec_id, q) GROUP BY vec_id)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM r, h"


OP12_SQL = _sql()
