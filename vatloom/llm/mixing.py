"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, rate = target / source size.
Documents of a source are put in a fixed order, their expected copies are prefix-summed, one offset
u in [0, 1) is added for the source, and a document is emitted once for each integer its interval
crosses: floor(k * rate + u) - floor((k - 1) * rate + u) for the k-th document.

The order goes by size class first (number of digits and two leading digits of the size), so that a
source's taken words differ from its target by little more than one large document. The class, with
256 salts drawn from the document id, also cuts a source in blocks: row numbers are counted inside
blocks, and only the blocks' row counts are prefix-summed over a source, so a source with a third of
all rows is no hot key.

Targets are a water filling: min(cap * source size, level * weight), where the level is what brings
the sum to ``share`` times all words. That is where repeated resharing of the excess ends.

Defined cases. Null text: size 0. Null source: a source of its own, last. Null id: kept, salt of the
empty text. A source of size 0: target 0, no copies. Repeated rows: each is a document of its own. Rows of one
id and size but other texts: ``emit`` orders them by a hash of the row, so that reruns take the same. Empty
table: empty result. Extra columns are carried only by ``emit``; they may have any names but
those starting with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged, table

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a source: _mix_source, source_size, target. The windows run over sources, not documents."""
    per = sized.groupBy("_mix_source").agg(F.sum("_mix_size").alias("source_size"))
    names = Window.orderBy(F.col("_mix_source").isNull(), "_mix_source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = per.withColumn("_rank", F.row_number().over(names)).withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
        .withColumn("_fits", F.col("_level") <= F.col("_cap") / F.col("_w"))
        .withColumn("_level", F.min_by("_level", F.when(F.col("_fits"), F.col("_full"))).over(everything))
    )
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return levels.select("_mix_source", "source_size", target.alias("target"))


def _blocks(sized: DataFrame) -> DataFrame:
    """Adds the block (class, salt) of each document."""
    digits = F.col("_mix_size").cast("string")
    return sized.withColumn("_mix_class", F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 2))).withColumn(
        "_mix_salt", F.substring(F.md5(F.coalesce(F.col("_mix_id").cast("string"), F.lit(""))), 1, 2)
    )


def _copies(sized: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Adds source_size, target and copies to ``sized`` (columns _mix_id, _mix_source, _mix_size and any others)."""
    sized = _blocks(sized)
    key = ["_mix_source", "_mix_class", "_mix_salt"]
    counts = sized.groupBy(*key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_mix_source").orderBy("_mix_class", "_mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    t = targets.withColumn("_u", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("_mix_source", F.lit("\x00")))), 1, 8), 16, 10).cast("double") / 4294967296.0)
    o, t = offsets.alias("o"), t.alias("t")
    offsets = o.join(t, F.col("o._mix_source").eqNullSafe(F.col("t._mix_source"))).select("o._mix_source", "_mix_class", "_mix_salt", "_before", "source_size", "target", "_u")
    d, o = sized.alias("d"), offsets.alias("o")
    joined = d.join(o, F.expr("d._mix_source <=> o._mix_source AND d._mix_class = o._mix_class AND d._mix_salt = o._mix_salt")).drop(*[F.col(f"o.{k}") for k in key])
    ties = ["_mix_tie"] if "_mix_tie" in sized.columns else []
    inside = Window.partitionBy(*key).orderBy("_mix_size", "_mix_id", *ties)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    k = F.col("_mix_k").cast("double")
    return (
        joined.withColumn("_mix_k", F.col("_before") + F.row_number().over(inside))
        .withColumn("copies", (F.floor(k * rate + F.col("_u")) - F.floor((k - 1) * rate + F.col("_u"))).cast("long"))
        .drop(*key[1:], *ties, "_before", "_u", "_mix_k")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """Plan of the mix, one row a document: doc_id, size, source_size, target, copies, taken."""
    sized = staged(docs.select(F.col(id_col).alias("_mix_id"), F.col(source_col).alias("_mix_source"), n_words(F.col(text_col)).alias("_mix_size")), "mix-sizes")
    out = _copies(sized, source_targets(sized, weights, share, cap), seed)
    return out.select(F.col("_mix_id").alias("doc_id"), F.col("_mix_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_mix_size")).alias("taken"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every column of ``docs``, a row for each copy taken, and ``copy`` (1 for the first)."""
    sized = docs.withColumns({"_mix_id": F.col(id_col), "_mix_source": F.col(source_col), "_mix_size": n_words(F.col(text_col))})
    sizes = staged(sized.select("_mix_id", "_mix_source", "_mix_size"), "mix-sizes")
    plain = [F.col(f"row.{c}").alias(c) for c in docs.columns]
    hashed = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    packed = sized.select("_mix_id", "_mix_source", "_mix_size", F.xxhash64(F.col(text_col), *hashed).alias("_mix_tie"), F.struct(*docs.columns).alias("row"))
    out = _copies(packed, source_targets(sizes, weights, share, cap), seed)
    name = "copy" if "copy" not in docs.columns else "_mix_copy"
    return out.where("copies > 0").select(*plain, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM per),
weighted AS (SELECT *, CAST(CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, source_size * CAST(2.0 AS DOUBLE) AS cap FROM ranked),
filled AS (
  SELECT *, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_
  FROM weighted),
level AS (SELECT arg_min((total - full_) / open_, full_) AS lv FROM filled WHERE (total - full_) / open_ <= cap / w),
targets AS (SELECT source, source_size, CASE WHEN lv IS NULL THEN cap ELSE least(cap, lv * w) END AS target,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(source, chr(0))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM filled LEFT JOIN level ON true),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY source
    ORDER BY lpad(CAST(length(CAST(size AS VARCHAR)) AS VARCHAR), 2, '0') || substr(CAST(size AS VARCHAR), 1, 2),
      substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2), size, doc_id) AS k FROM sized),
counted AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE CAST(0 AS DOUBLE) END AS rate, CAST(k AS DOUBLE) AS k, u
  FROM ordered JOIN targets ON ordered.source IS NOT DISTINCT FROM targets.source),
copied AS (SELECT *, CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) AS copies FROM counted)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM copied
"""
