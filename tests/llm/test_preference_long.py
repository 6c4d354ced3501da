"""Masks of a conversation of very many turns, against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from vatloom.llm import preference as M


def test_masks_of_many_turns(spark):
    made = {i: [("assistant" if (i + t) % 3 else "user", "wörd " * (t % 7)) for t in range(n)] for i, n in enumerate((0, 1, 2, 33, 20_000))}
    kind = "array<struct<turn:long,role:string,text:string>>"
    df = spark.createDataFrame([(i, [(t, r, x) for t, (r, x) in enumerate(turns)]) for i, turns in made.items()], f"i int, turns {kind}")
    for r in df.select("i", M._rendered(F.col("turns")).alias("text"), M._mask(F.col("turns")).alias("mask")).collect():
        spans = [tuple(map(int, s.split(":"))) for s in r["mask"].split(",") if s]
        assert [r["text"][a:b] for a, b in spans] == [x + M.CLOSE for role, x in made[r["i"]] if role == "assistant"]
