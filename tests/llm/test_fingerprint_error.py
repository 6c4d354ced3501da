"""The error of likeness on pairs of known likeness."""

from vatloom.llm import fingerprint


def test_likeness_of_known_pairs(spark):
    """150 pairs at 0.75: 60 of 80 words in common."""
    rows = []
    for p in range(150):
        common = " ".join(f"p{p}c{i}" for i in range(60))
        rows += [(2 * p + s, common + "".join(f" p{p}s{s}x{i}" for i in range(10))) for s in (0, 1)]
    out = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 0").select("near_next").collect()
    errors = [r[0] - 0.75 for r in out]
    assert len(errors) == 150
    assert (sum(e * e for e in errors) / 150) ** 0.5 < 0.07 and max(map(abs, errors)) < 0.2 and abs(sum(errors)) / 150 < 0.02
