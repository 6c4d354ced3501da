"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A document is a bag of lower-cased words weighted by their counts. A word of count w stands for the pairs (word, 1) to (word, w);
each of 64 samples hashes every pair and takes the pair of the smallest hash. So a sample is drawn evenly from the pairs below the
weights, and a pair that is smallest among more pairs is so among fewer: it is consistent. Two documents agree in a sample with
probability equal to their generalised Jaccard similarity, sum of minima over sum of maxima of the counts, so the share of equal
samples estimates it (standard error 0.0625 at most). Counts are whole, so no logarithms are needed, which took nine tenths of the
time; a document costs its tokens, not more, as words are counted before they are dealt into pairs.

A sample is kept as one int, the 32 bits of its pair's hash: one hash of 64 bits gives two samples. Different pairs share them once
in 4 billion. Taking the smallest is a plain ``min`` of ints. Texts are dealt out by document once; words, counts and samples
are then made where the text is.

``successors`` orders ids in ranges: each range finds its followers, and only the ranges' first ids
meet in one task.

Defined cases. Null text: empty. Text without words: empty fingerprint, likeness 1 to another such, 0
to any other. Null id: follows nothing and has no next document, so its last quarter is only cut off
and near_next is 0. Repeated rows: one result row each; rows that share an id are one document for
their predecessor (the smallest text counts). One document only: it is its own next. Extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged, table

CHUNKS, LANES = 8, 4  # a lane's hash of 64 bits gives two samples
SAMPLES = CHUNKS * LANES * 2


def successors(ids: DataFrame) -> DataFrame:
    """doc_id, next_id over the distinct non-null ids of ``ids``; the last one's next is the first."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.where("doc_id IS NOT NULL").select("doc_id").distinct().repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "fp-ranges")
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    over = Window.orderBy("part")
    follow = firsts.select("part", F.coalesce(F.lead("first").over(over), F.min("first").over(over)).alias("follow"))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return staged(ranged.withColumn("_next", inside).join(follow, "part").select("doc_id", F.coalesce("_next", "follow").alias("next_id")), "fp-successors")


def _halves(h: Column) -> list[Column]:
    """The upper and the lower 32 bits of a hash, as ints."""
    return [F.shiftright(h, 32).cast("int"), F.shiftright(F.shiftleft(h, 32), 32).cast("int")]


def sample_bags(texts: DataFrame, key: list[str], sides: list[str]) -> DataFrame:
    """``key`` and, for every text column in ``sides``, an array of samples (ints) of that name (nulls for a text without words).

    ``texts`` should be dealt out by (part of) ``key`` already; nothing is shuffled then. Rows that share a key must be equal.
    """
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(s).alias("text")) for i, s in enumerate(sides)]))
    rows = texts.withColumn("_row", F.monotonically_increasing_id()).select(*key, "_row", one.alias("s"))
    terms = rows.select(*key, "_row", "s.side", F.explode_outer(F.regexp_extract_all(F.lower("s.text"), F.lit(WORD), F.lit(0))).alias("term"))
    group = [*key, "_row"]
    counted = terms.select(*group, F.xxhash64("term").alias("h"), *[F.when((F.col("side") == i) & F.col("term").isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias(f"n{i}") for i in range(len(sides))])
    counted = counted.groupBy(*group, "h").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(sides))])
    most = F.greatest(F.lit(1), *[F.col(f"n{i}") for i in range(len(sides))])
    pairs = counted.select(*group, "h", *[F.col(f"n{i}") for i in range(len(sides))], F.explode(F.sequence(F.lit(1).cast("long"), most.cast("long"))).alias("copy"))
    pairs = pairs.select(*group, F.xxhash64("h", "copy").alias("pair"), *[(F.col("copy") <= F.col(f"n{i}")).alias(f"in{i}") for i in range(len(sides))], F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))).alias("chunk"))
    pairs = pairs.select(*group, "chunk", *[f"in{i}" for i in range(len(sides))], *[F.xxhash64("pair", F.col("chunk") * LANES + lane).alias(f"x{lane}") for lane in range(LANES)])
    lowest = [F.min(F.when(F.col(f"in{i}"), half)).alias(f"s{i}_{2 * lane + n}") for lane in range(LANES) for n, half in enumerate(_halves(F.col(f"x{lane}"))) for i in range(len(sides))]
    low = pairs.groupBy(*group, "chunk").agg(*lowest)
    packed = low.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("chunk", *[F.array(*[F.col(f"s{i}_{x}") for x in range(2 * LANES)]).alias(f"a{i}") for i in range(len(sides))]))).alias("c"))
    return packed.select(*key, *[F.flatten(F.col("c")[f"a{i}"]).alias(s) for i, s in enumerate(sides)]).distinct()


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two empty fingerprints are alike."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return F.coalesce(same / F.size(a), F.lit(0.0))


def shown(a: Column) -> Column:
    """A fingerprint as text; empty for a text without words."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    # one exchange deals the texts out by (k, nul); everything that needs a text reads that exchange
    # rows without an id are spread by their text
    ident = F.col(id_col)
    docs = documents.select(F.coalesce(ident, F.xxhash64(text_col)).alias("k"), ident.isNull().alias("nul"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = staged(docs.where("NOT nul").groupBy(F.col("k").alias("doc_id")).agg(F.max(F.length("text")).alias("most")), "fp-sizes")
    after = successors(sizes)
    wanted = after.join(sizes, "doc_id").select(F.col("next_id").alias("k"), F.lit(False).alias("nul"), F.col("doc_id").alias("previous"), F.floor(F.col("most") / 4).cast("int").alias("q"))
    heads = docs.join(staged(wanted, "fp-wanted"), ["k", "nul"]).select(F.col("previous").alias("k"), "nul", F.substr(F.col("text"), F.lit(1), F.col("q")).alias("head"))
    heads = heads.groupBy("k", "nul").agg(F.min("head").alias("head"))
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - q), F.substr(F.coalesce("head", F.lit("")), F.lit(1), q))
    full = docs.join(heads, ["k", "nul"], "left").select("k", "nul", F.xxhash64("text").alias("th"), "text", edited.alias("edited"))
    bags = sample_bags(full.withColumnRenamed("text", "fingerprint").withColumnRenamed("edited", "edited_fingerprint"), ["k", "nul", "th"], ["fingerprint", "edited_fingerprint"])
    info = full.select("k", "nul", "th", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    # the hashes are compared beside the join keys, so that either side stays as it is dealt out
    same = F.expr("info.k = bags.k AND info.nul = bags.nul AND (info.th ^ bags.th) = 0")
    known = info.alias("info").join(bags.alias("bags"), same).select(F.expr("IF(info.nul, NULL, info.k)").alias("doc_id"), "info.th", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")
    known = staged(known, "fp-known")
    following = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by("fingerprint", "th").alias("next_fp")).withColumnRenamed("doc_id", "next_id")
    out = known.join(after.join(following, "next_id").select("doc_id", "next_fp"), "doc_id", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("fingerprint")).alias("fingerprint"), shown(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
    )


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
