"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is contained in a document when at least 75 % of its distinct five-word shingles occur there.

Search. Items are partitioned by size (powers of two of their shingle count), and the partition sets
how many universal hash functions its items get: up to 32 shingles as many as there are shingles
(so every shingle is a probe), above that 32. The shingle at each function's minimum is a probe. One
minimum is a shingle of the item drawn at random, so the chance that a document holds it is the
containment itself, however long the document: Jaccard similarity, which a long document dilutes, is
not needed. A document is a candidate for an item when it holds at least 35 % of the item's probes; a
containment of 75 % falls below that with probability under one in a million.

Verification. Candidates are compared on the words of their shingles, over whole documents.

The probes are broadcast while there are no more than ``broadcast_rows`` of them, and the items' shingles
while they have no more than ``broadcast_bytes`` together; both are counted first. Beyond that the join shuffles.

Defined cases. Case is ignored. Null, empty or blank document: contains nothing. Fewer than five words
(item or document): one shingle, the whole sequence. Item without words: contained nowhere. Rows that
repeat an item_id are one item. Null doc_id: never flagged. Repeated documents: one row each. Empty
benchmark: nothing flagged. Extra columns are not read by ``contained`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, words

K, CONTAINMENT, FUNCTIONS, SCREEN = 5, 0.75, 32, 0.35
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def _windows(w: Column, of) -> Column:
    """``of`` of the first position of every shingle; one for a sequence of fewer than K words, none for none."""
    last = F.greatest(F.size(w) - K, F.lit(0))
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last), of)).otherwise(F.array())


def shingle_hashes(w: Column) -> Column:
    """64-bit hashes of the shingles of a word array (get() gives null past the end, which adds nothing)."""
    return _windows(w, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]))


def shingle_texts(w: Column) -> Column:
    return _windows(w, lambda i: F.array_join(F.slice(w, i + 1, F.lit(K)), " "))


def _worded(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).alias(name), words(F.lower(F.col(text_col))).alias("w"))


def probes(items: DataFrame) -> DataFrame:
    """item_id, n_probes, probe: the shingle hashes at the minima of as many hash functions as the item's size partition has."""
    each = _worded(items, "item_id", "text", "item_id").select("item_id", F.explode(F.array_distinct(shingle_hashes(F.col("w")))).alias("h")).distinct()
    sized = each.groupBy("item_id").agg(F.collect_set("h").alias("hs")).withColumn("n", F.size("hs"))
    partition = F.ceil(F.log2(F.col("n"))).cast("int")
    hashed = sized.withColumn("functions", F.when(partition <= 5, F.lit(0)).otherwise(F.lit(FUNCTIONS)))
    picked = F.transform(
        F.sequence(F.lit(1), F.lit(FUNCTIONS)),
        lambda f: F.array_min(F.transform("hs", lambda h: F.struct(F.xxhash64(h, f).alias("rank"), h.alias("h"))))["h"],
    )
    chosen = F.when(F.col("functions") == 0, F.col("hs")).otherwise(F.array_distinct(picked))
    return hashed.withColumn("p", chosen).select("item_id", F.size("p").alias("n_probes"), F.explode("p").alias("probe"))


def contained(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, containment: float = CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Verified pairs: doc_id, item_id, containment."""
    small = probes(benchmark.where("item_id IS NOT NULL"))
    small = staged(small, "dc-probes")
    fits = small.count() <= broadcast_rows
    sent = F.broadcast(small) if fits else small
    docs = documents.where(F.col(id_col).isNotNull())
    hashed = _worded(docs, id_col, text_col, "doc_id").select("doc_id", F.explode(shingle_hashes(F.col("w"))).alias("probe"))
    hits = hashed.join(sent, "probe").groupBy("doc_id", "item_id", "n_probes").agg(F.countDistinct("probe").alias("hits"))
    pairs = staged(hits.where(F.col("hits") >= F.col("n_probes") * SCREEN).select("doc_id", "item_id"), "dc-pairs")

    texts = _worded(benchmark.where("item_id IS NOT NULL"), "item_id", "text", "item_id").select("item_id", F.explode(shingle_texts(F.col("w"))).alias("shingle")).distinct()
    texts = staged(texts, "dc-shingles")
    bytes_ = texts.agg(F.sum(F.octet_length("shingle") + 32)).first()[0] or 0
    sizes = texts.groupBy("item_id").agg(F.count("*").alias("n"))
    wanted = pairs.select("doc_id").distinct()
    inside = (
        _worded(docs.join(wanted.select(F.col("doc_id").alias(id_col)), id_col, "left_semi"), id_col, text_col, "doc_id")
        .select("doc_id", F.explode(F.array_distinct(shingle_texts(F.col("w")))).alias("shingle"))
        .join(F.broadcast(texts) if bytes_ <= broadcast_bytes else texts, "shingle")
        .groupBy("doc_id", "item_id")
        .agg(F.countDistinct("shingle").alias("shared"))
    )
    found = pairs.join(inside, ["doc_id", "item_id"]).join(sizes, "item_id")
    return found.select("doc_id", "item_id", (F.col("shared") / F.col("n")).alias("containment")).where(F.col("shared") >= F.col("n") * containment)


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` without those that contain an item."""
    flagged = staged(contained(documents, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct(), "dc-flagged")
    return documents.join(flagged, id_col, "left_anti").select(*documents.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = staged(contained(docs, table(spark, sf_dir, "benchmark")), "dc-found")
    by_doc = found.groupBy("doc_id").agg(
        F.count("*").alias("n_items"),
        F.max("containment").alias("best"),
        F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda i: i.cast("string")), ",").alias("items"),
    )
    out = docs.select("doc_id").join(by_doc, "doc_id", "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("items", F.lit("")).alias("items"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda p: array_to_string(w[p:p + 4], ' '))) AS s FROM d WHERE len(w) > 0),
isx AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda p: array_to_string(w[p:p + 4], ' '))) AS s FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM isx GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN isx USING (s) GROUP BY doc_id, item_id),
ok AS (SELECT doc_id, item_id, shared / CAST(n AS DOUBLE) AS c FROM hit JOIN n USING (item_id) WHERE shared >= n * 0.75),
g AS (SELECT doc_id, count(*) AS n_items, max(c) AS best, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM ok GROUP BY doc_id)
SELECT d.doc_id, g.n_items IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(best, CAST(0 AS DOUBLE)) AS best, coalesce(items, '') AS items
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
