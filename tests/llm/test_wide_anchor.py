"""An anchor that stands in many different surroundings."""

import random

from test_brute_force import removed

from vatloom.llm import suffix_dedup


def test_wide_anchors_are_not_held(spark):
    rng, rule = random.Random(8), "=-" * 12 + "#" * 12
    some = ["".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(12)]
    texts = {i: "".join(rng.choice(some) + rule + rng.choice(some)[: rng.randrange(5, 40)] for _ in range(rng.randrange(1, 5))) for i in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = removed(texts)
    for bound in (0, 300, 3000, 1 << 30):
        out = suffix_dedup.deduplicate(docs, group_bytes=bound).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == expected


def test_settle_holds_a_bounded_group():
    import pyarrow as pa

    def batches():
        for k in range(40):
            texts = [f"{k:08}{i:08}".encode() + b"x" * 50 for i in range(100)]
            yield pa.RecordBatch.from_arrays([pa.array([5] * 100), pa.array([0] * 100), pa.array(range(100)), pa.array(texts, pa.binary()), pa.array([k * 100 + i for i in range(100)]), pa.array([False] * 100)], names=["h", "chunk", "idx", "context", "doc", "several"])
            seen.append(k)

    seen: list[int] = []
    next(suffix_dedup._settle(10_000)(batches()))
    assert len(seen) < 5
