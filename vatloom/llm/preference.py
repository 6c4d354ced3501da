"""Preference formatting, in DataFrame expressions only.

A pair is a chosen and a rejected conversation. Their longest common turn prefix (equal role and text)
is rendered once as the prompt; what follows is rendered on either side as a completion with its mask:
the [start, end) character spans of the completion that count for the loss, which are the assistant
turns' texts with their end mark. Turns are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``.

``with_rejected`` makes pairs from plain conversations: the rejected side has its last assistant turn
replaced by the last assistant turn of the next conversation (ascending id, the first after the last)
that has one.

A pair is one training example and one row, so a conversation may be as long as a row can be; rows are
gathered by a map-side combined list.

Defined cases. Null text: empty. Null role: rendered as ``unknown``, never trained on. Rows of a null
conv_id belong to no conversation and are left out. Turns are ordered by turn (null first), role, text,
so repeated rows are repeated turns. No assistant turn, or equal sides: the whole conversation is the
prompt, completions and masks are empty, ``usable`` is false. Empty table: empty result. Extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .fingerprint import successors
from .pii import _fold

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>"
TRAINED = "assistant"


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order: array of (turn, role, text)."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE + "\n"))), "")


def _mask(turns: Column) -> Column:
    """Spans of trained text in the rendered turns, as start:end joined by commas; folded in blocks, so the work is about linear in turns."""
    extra = len(OPEN) + len(MIDDLE)
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + extra + len(CLOSE) + 1

    def step(acc: Column, t: Column) -> Column:
        start = acc["pos"] + F.length(t["role"]) + extra
        span = F.concat_ws(":", start.cast("string"), (acc["pos"] + size(t) - 1).cast("string"))
        return F.struct((acc["pos"] + size(t)).alias("pos"), F.when(t["role"] == TRAINED, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    spans = _fold(turns, F.lit(0), lambda block: F.aggregate(block, F.lit(0), lambda n, t: n + size(t)), lambda a, b: a + b, F.array().cast("array<string>"), step)
    return F.array_join(spans, ",")


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two turn arrays; turn numbers don't count."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, n_turns, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, usable of (pair_id, chosen, rejected) turn arrays."""
    cut = pairs.withColumn("n", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    parts = cut.select("pair_id", F.size("chosen").cast("long").alias("n_turns"), F.col("n").cast("long").alias("n_prompt_turns"), F.slice("chosen", F.lit(1), F.col("n")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select(
        "pair_id", "n_turns", "n_prompt_turns", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"),
        _rendered(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"), ((F.size("c") > 0) & (F.size("r") > 0)).alias("usable"),
    )


def with_rejected(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) of plain conversations (conv_id, turn, role, text)."""
    convs = gathered(conversations)
    last = F.aggregate(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i + 1).otherwise(0)), F.lit(0), lambda acc, x: F.greatest(acc, x))
    convs = staged(convs.withColumn("last", last), "pf-conversations")
    replies = convs.where("last > 0").select("conv_id", F.element_at("turns", F.col("last"))["text"].alias("reply"))
    after = successors(replies.withColumnRenamed("conv_id", "doc_id")).withColumnRenamed("doc_id", "conv_id")
    donors = after.join(replies.withColumnRenamed("conv_id", "next_id"), "next_id").select("conv_id", "reply")
    other = F.transform("turns", lambda t, i: F.when(i + 1 == F.col("last"), t.withField("text", F.col("reply"))).otherwise(t))
    paired = convs.join(donors, "conv_id", "left")
    return paired.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.when(F.col("last") > 0, other).otherwise(F.col("turns")).alias("rejected"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(with_rejected(table(spark, sf_dir, "conversations")))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(CASE WHEN role = 'assistant' THEN p END), 0) AS last FROM t GROUP BY conv_id),
reply AS (SELECT conv_id, text FROM t JOIN c USING (conv_id) WHERE p = last),
donor AS (SELECT conv_id, coalesce(lead(text) OVER (ORDER BY conv_id), first_value(text) OVER (ORDER BY conv_id)) AS other FROM reply),
s AS (
  SELECT t.*, n, last, CASE WHEN last = 0 OR reply.text = other THEN n ELSE last - 1 END AS k, other
  FROM t JOIN c USING (conv_id) LEFT JOIN reply USING (conv_id) LEFT JOIN donor USING (conv_id)),
x AS (
  SELECT conv_id, any_value(n) AS n, any_value(k) AS k,
    coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY p) FILTER (p <= k), '') AS prompt,
    coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY p) FILTER (p > k), '') AS chosen,
    coalesce(string_agg('<|im_start|>' || role || chr(10) || CASE WHEN p = last THEN other ELSE text END || '<|im_end|>' || chr(10), '' ORDER BY p) FILTER (p > k), '') AS rejected,
    coalesce(max(22 + length(text) + 10) FILTER (p > k AND p = last), 0) AS chosen_end, coalesce(max(22 + length(other) + 10) FILTER (p > k AND p = last), 0) AS rejected_end
  FROM s GROUP BY conv_id)
SELECT conv_id AS pair_id, CAST(n AS BIGINT) AS n_turns, CAST(k AS BIGINT) AS n_prompt_turns, prompt, chosen,
  CASE WHEN chosen_end > 0 THEN '22:' || chosen_end ELSE '' END AS chosen_mask, rejected,
  CASE WHEN rejected_end > 0 THEN '22:' || rejected_end ELSE '' END AS rejected_mask, k < n AS usable
FROM x
"""
