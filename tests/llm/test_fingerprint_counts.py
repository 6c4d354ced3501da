"""Likeness of words with counts, without logarithms: a sample is the 32 bits of a pair's hash."""

from vatloom.llm import fingerprint


def test_likeness_of_counted_words(spark):
    """150 pairs at 0.5: counts 3 against 1 of twenty words, 2 against 2 of ten others."""
    rows = []
    for p in range(150):
        for s, often in ((0, 3), (1, 1)):
            rows.append((2 * p + s, " ".join([f"p{p}a{i}" for i in range(20)] * often + [f"p{p}b{i}" for i in range(10)] * 2)))
    df = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    out = df.where("doc_id % 2 = 0").select("near_next", "fingerprint").collect()
    errors = [r[0] - (20 + 20) / (60 + 20) for r in out]
    assert all(len(r[1]) == 64 * 8 for r in out)
    assert (sum(e * e for e in errors) / 150) ** 0.5 < 0.075 and max(map(abs, errors)) < 0.25 and abs(sum(errors)) / 150 < 0.02


def test_no_words_and_one_word(spark):
    out = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame([(1, ""), (2, " \n"), (3, None), (4, "a")], "doc_id long, text string")).collect()}
    assert [out[d]["fingerprint"] for d in (1, 2, 3)] == ["", "", ""] and len(out[4]["fingerprint"]) == 512
    assert [out[d]["near_next"] for d in (1, 2, 3, 4)] == [1.0, 1.0, 0.0, 0.0]
