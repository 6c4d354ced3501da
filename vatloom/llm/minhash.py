"""Near duplicates: universal hash minima, banding, signature check, exact check, large-star and small-star.

1. Each text becomes its set of distinct five-word shingles and 128 minima of multiply-add hashes, of
   which a signature keeps 8 bits each. Texts with equal sets are one class from here on; its
   representative is its smallest id.
2. 32 bands of 4 minima put representatives in buckets. A pair at the threshold of 0.75 shares no
   bucket with probability (1 - 0.75^4)^32, 5.2e-6.
3. First round: every member of a bucket is compared with the bucket's smallest member. Signatures
   that agree in less than ``SCREEN`` of the minima (71 of 128) are dropped, the others are compared on
   their full sets. A pair at the threshold is dropped with probability 4.8e-7 at most (binomial; minima
   that differ may agree in 8 bits, which only lowers it), a tenth of what banding loses, so a link is
   missed with 5.7e-6 at most. Confirmed links give components.
4. Second round: in buckets that still hold two or more components, members of different components
   whose signatures pass the screen are joined to clusters. In a cluster of two or more components,
   ``CENTRES`` of its members are compared with all of it on full sets, which joins what is joined by
   many links; then all members of different components are, without a screen.
5. Components over all confirmed links, by alternating large-star and small-star with both steps
   written to the shared folder.

Comparisons run as jobs: a left and a right block of bounded weight. A bucket or cluster is cut in
blocks, and a component of half a block or more has blocks of its own, which don't meet each other. So
thousands of copies cost a comparison each, and a few strangers among them cost their number times the
copies; only members near the threshold without a link are compared all with all, at 8 bytes a shingle
and a copy for every 260,000 shingles of their cluster. Texts travel once for each block they meet.

Links do not depend on order, and a component is what the links reach, whichever were tested.

Defined cases. Null, empty or blank text: no shingles, linked with nothing, kept. Fewer than five
words: one shingle, the whole sequence. Null id: linked with nothing, component_id null, kept. Repeated
rows: one result row each, same component. Rows that share an id but no text: each counts for the id.
Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, staged, table
from .textvec import mix, pieces, shingle_hashes, shingle_sets

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
PERCENT, SCREEN, CENTRES = 75, 0.55, 16
#: Weight of a block and of a task's group of pairs: shingles (texts are compared) or rows (signatures are).
BLOCK_SHINGLES, GROUP_SHINGLES, BLOCK_ROWS, GROUP_ROWS = 1 << 18, 1 << 18, 2048, 1 << 14
_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_C = mix(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64))
SKETCH = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>, signature binary"


def minima(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(documents, HASHES) minima of the universal hashes; rows must not be empty."""
    out = np.empty((len(rows) - 1, HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat((h * _A[j] + _C[j]) >> np.uint64(32), rows[:-1])
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id")
        for start, piece in pieces(b.column("text")):
            rows, h = shingle_hashes(piece)
            sets = [np.unique(h[x:y]) for x, y in zip(rows[:-1], rows[1:])]
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            key_a, key_b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            bands: list = [None] * len(n)
            signs: list = [None] * len(n)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                first = np.concatenate([[0], np.cumsum(n[some])])
                low = minima(first, flat)
                key_a[some], key_b[some] = np.add.reduceat(mix(flat + np.uint64(7)), first[:-1]), np.add.reduceat(mix(flat ^ np.uint64(0x5BD1E995)), first[:-1])
                value = np.zeros((len(some), BANDS), np.uint64)
                for r in range(ROWS):
                    value = mix(value * np.uint64(31) + low[:, r::ROWS].astype(np.uint64))
                value = mix(value + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                short = low.astype(np.uint8)
                for x, i in enumerate(some):
                    bands[i], signs[i] = value[x], short[x].tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, len(piece)), pa.array(n), pa.array(key_a.view(np.int64)), pa.array(key_b.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                names=["doc_id", "n_shingles", "key_a", "key_b", "bands", "signature"],
            )


@F.arrow_udf(T.DoubleType())
def agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of equal minima of two signatures."""
    if not len(a):
        return pa.array([], pa.float64())
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, HASHES) for v in (a, b))
    return pa.array((x == y).mean(axis=1))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, tag: str = "cc", rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of undirected links (a, b), by alternating large-star and small-star."""
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-edges")
    before = _mark(edges)
    for _ in range(rounds if before[0] else 0):
        n = before[0]
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-large-min", n)
        # large-star: neighbours above u point to the smallest of u and its neighbours
        large = staged(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), f"{tag}-large", n)
        spent = [edges, low]
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-small-min", n)
        # small-star: u and its neighbours below point to the smallest of these
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
        edges = staged(large.join(low, "u").select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct(), f"{tag}-small", n)
        discard(*spent, large, low)
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    below = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = staged(below.union(roots), f"{tag}-nodes", before[0])
    discard(edges)
    return out


def _pairs_of_blocks(rows: DataFrame, key: str, most: int, tag: str) -> DataFrame:
    """Jobs (pair, side, doc_id, component, weight) that bring every two rows of a key and of different components together.

    ``rows``: key, doc_id, component, weight. The rows of a key are cut in blocks of about ``most`` weight. A component
    of at least half a block has blocks of its own, which are not paired with each other: many copies that are joined
    already and some that aren't cost in proportion to their product, not to the square of their sum.
    """
    sizes = rows.groupBy(key, "component").agg(F.sum("weight").alias("w"))
    part = F.when(F.col("w") * 2 >= most, F.col("component"))
    parts = staged(sizes.withColumn("part", part), f"{tag}-parts")
    per = parts.groupBy(key, "part").agg(F.ceil(F.sum("w") / most).alias("n"))
    block = F.xxhash64(key, "part", "salt").alias("block")
    blocks = staged(per.select(key, "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("salt")).select(key, "part", block), f"{tag}-blocks")
    x, y = blocks.select(key, F.col("part").alias("p"), F.col("block").alias("x")), blocks.select(key, F.col("part").alias("q"), F.col("block").alias("y"))
    index = x.join(y, key).where("x <= y AND (p IS NULL OR q IS NULL OR p <> q)")
    ends = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("block"), F.lit(2).alias("side")))).otherwise(
        F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y").alias("block"), F.lit(1).alias("side")))
    )
    index = index.select(F.xxhash64(key, "x", "y").alias("pair"), F.explode(ends).alias("e")).select("pair", "e.block", "e.side")
    n_of = parts.drop("w").alias("l").join(per.alias("r"), F.expr(f"l.{key} = r.{key} AND l.part <=> r.part")).select(f"l.{key}", "component", "l.part", "n")
    placed = rows.join(n_of, [key, "component"]).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("n"))).withColumn("block", block)
    jobs = staged(placed.join(index, "block").select("pair", "side", "doc_id", "component", "weight"), f"{tag}-jobs")
    discard(parts, blocks)
    return jobs


def _crossing(payload: str):
    """Links (a, b) between the left and right rows of each pair of a group that join components; ``payload``: compare text (full sets) or signature (the screen)."""
    least = int(np.ceil(SCREEN * HASHES))

    def run(rows: pa.Table) -> pa.Table:
        pair, side, ids, comp = (rows.column(c).to_numpy() for c in ("pair", "side", "doc_id", "component"))
        if payload == "text":
            coded = rows.column("text").combine_chunks().dictionary_encode()
            sets, of = shingle_sets(coded.dictionary), coded.indices.to_numpy()
        else:
            sign = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(-1, HASHES)
        order = np.argsort(pair, kind="stable")
        found: tuple[list[int], list[int]] = ([], [])
        for group in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1) if len(order) else ():
            left, right = group[side[group] != 1], group[side[group] != 0]
            # the components of this pair, relabelled as they are joined
            _, code = np.unique(comp[group], return_inverse=True)
            label = np.arange(code.max() + 1)
            code_of = dict(zip(group.tolist(), code.tolist()))
            theirs = np.array([code_of[r] for r in right.tolist()], np.int64)
            if not len(left) or not len(right):
                continue
            if payload == "text":
                each = [sets[of[r]] for r in right]
                sizes = np.array([len(s) for s in each], np.int64)
                values, back = np.unique(np.concatenate(each), return_inverse=True)
                starts, mark = np.concatenate([[0], np.cumsum(sizes)])[:-1], np.zeros(len(values), np.int32)
            else:
                rights = sign[right]
            for i in left.tolist():
                mine = code_of[i]
                open_ = label[theirs] != label[mine]
                if not open_.any():
                    continue
                if payload == "text":
                    s = sets[of[i]]
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    at = at[values[at] == s]
                    mark[at] = 1
                    both = np.add.reduceat(mark[back], starts)
                    mark[at] = 0
                    alike = open_ & (both > 0) & (100 * both >= PERCENT * (len(s) + sizes - both))
                else:
                    alike = open_.copy()
                    alike[open_] = (rights[open_] == sign[i]).sum(axis=1) >= least
                for j in np.flatnonzero(alike).tolist():
                    if label[theirs[j]] != label[mine]:
                        label[label == label[theirs[j]]] = label[mine]
                        found[0].append(int(ids[i]))
                        found[1].append(int(ids[right[j]]))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


def _run_jobs(jobs: DataFrame, source: DataFrame, payload: str, tag: str) -> DataFrame:
    """Links found by jobs (pair, side, doc_id, component, weight); ``source`` has doc_id and the payload."""
    target = GROUP_SHINGLES if payload == "text" else GROUP_ROWS
    total = jobs.agg(F.sum("weight")).first()[0] or 0
    groups = max(1, -(-int(total) // target))
    given = jobs.withColumn("group", F.pmod(F.xxhash64("pair"), F.lit(groups))).join(source, "doc_id")
    links = given.select("group", "pair", "side", "doc_id", "component", payload).groupBy("group").applyInArrow(_crossing(payload), "a long, b long")
    links = staged(links.distinct(), tag)
    discard(jobs)
    return links


def _open(rows: DataFrame, key: str) -> DataFrame:
    """The rows of those keys that hold two or more components."""
    keys = rows.groupBy(key).agg(F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x <> _y").select(key)
    return rows.join(keys, key)


def _placed(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = staged(docs.mapInArrow(_sketches, SKETCH), "nd-sketch")
    slim = staged(sketch.select("doc_id", "n_shingles", "key_a", "key_b"), "nd-keys")
    key = ["key_a", "key_b", "n_shingles"]
    usable = slim.where("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = staged(usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "nd-copies")
    usable = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = usable.join(copies, key, "left").where("rep IS NULL OR rep = doc_id")
    reps = staged(reps.select("doc_id", (F.col("n_shingles") + HASHES).alias("weight"), "bands", "signature"), "nd-reps")
    discard(sketch)
    members = staged(reps.select("doc_id", F.explode("bands").alias("bucket")), "nd-members")
    buckets = members.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    inside = staged(members.join(buckets, "bucket"), "nd-inside")
    discard(members)
    signs, weights = reps.select("doc_id", "signature"), reps.select("doc_id", "weight")

    # first round: members against the smallest of their bucket
    star = inside.where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    screened = (
        star.join(signs.select(F.col("doc_id").alias("a"), F.col("signature").alias("sign_a")), "a")
        .join(reps.select(F.col("doc_id").alias("b"), F.col("signature").alias("sign_b"), "weight"), "b")
        .where(agreement("sign_a", "sign_b") >= SCREEN)
        .select("a", "b", "weight")
    )
    screened = staged(screened, "nd-screened")
    per = screened.groupBy("a").agg(F.ceil(F.sum("weight") / BLOCK_SHINGLES).alias("n"))
    rights = screened.join(per, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("n"))).alias("pair"), "a", "b", "weight")
    lefts = rights.select("pair", F.col("a").alias("doc_id")).distinct().join(weights, "doc_id")
    jobs = rights.select("pair", F.lit(1).alias("side"), F.col("b").alias("doc_id"), "weight").unionByName(lefts.withColumn("side", F.lit(0)))
    jobs = staged(jobs.withColumn("component", F.col("doc_id")), "nd-first-jobs")
    needed = staged(jobs.select("doc_id").distinct(), "nd-needed")
    texts = staged(docs.join(needed, "doc_id", "left_semi"), "nd-texts")
    discard(screened, needed)
    links = _run_jobs(jobs, texts, "text", "nd-first")
    discard(texts)
    comp = components(links, "nd-cc1")

    # second round: clusters of members whose signatures agree, from buckets that are not one component yet
    rows = staged(_open(_placed(inside.select("bucket", "doc_id"), comp), "bucket").withColumn("weight", F.lit(1)), "nd-open")
    discard(inside)
    alike = _run_jobs(_pairs_of_blocks(rows, "bucket", BLOCK_ROWS, "nd-buckets"), signs, "signature", "nd-alike")
    discard(rows)
    if alike.isEmpty():
        return _result(slim, copies, key, comp)
    joined = components(alike.union(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))), "nd-cluster")
    cluster = joined.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    rows = staged(_open(_placed(cluster, comp), "cluster").join(weights, "doc_id"), "nd-clusters")
    texts = staged(docs.join(rows.select("doc_id"), "doc_id", "left_semi"), "nd-texts")
    discard(joined, alike)

    # some members of each cluster against all of it, in proportion to its size
    rank = F.row_number().over(Window.partitionBy("cluster", "salt").orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(64)))
    some = salted.withColumn("_r", rank).where(F.col("_r") <= CENTRES).drop("_r").withColumn("salt", F.lit(0))
    some = some.withColumn("_r", rank).where(F.col("_r") <= CENTRES).select("cluster", "doc_id", "component", "weight")
    per = rows.groupBy("cluster").agg(F.ceil(F.sum("weight") / BLOCK_SHINGLES).alias("n"))
    rights = rows.join(per, "cluster").select(F.xxhash64("cluster", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("n"))).alias("pair"), F.lit(1).alias("side"), "doc_id", "component", "weight")
    lefts = some.join(per, "cluster").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    lefts = lefts.select(F.xxhash64("cluster", "salt").alias("pair"), F.lit(0).alias("side"), "doc_id", "component", "weight")
    more = _run_jobs(staged(rights.unionByName(lefts), "nd-star-jobs"), texts, "text", "nd-star")
    if not more.isEmpty():
        links = staged(links.union(more), "nd-links")
        comp, before = components(links, "nd-cc2"), rows
        rows = staged(_open(_placed(rows.drop("component"), comp), "cluster"), "nd-clusters")
        discard(before)

    # what is left: every two members of a cluster that are not joined yet
    rest = _run_jobs(_pairs_of_blocks(rows, "cluster", BLOCK_SHINGLES, "nd-rest"), texts, "text", "nd-rest")
    discard(rows, texts)
    if not rest.isEmpty():
        comp = components(links.union(rest), "nd-cc3")
    return _result(slim, copies, key, comp)


def _result(slim: DataFrame, copies: DataFrame, key: list[str], comp: DataFrame) -> DataFrame:
    placed = slim.join(copies, key, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    out = placed.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
