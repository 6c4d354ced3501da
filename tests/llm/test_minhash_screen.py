"""Links at the threshold whose signatures agree in few minima."""

import random

import pytest

from vatloom.llm import minhash


@pytest.mark.parametrize("seed", [4221, 1747, 4692])
def test_links_at_the_threshold(spark, seed):
    """Sets of 210 shingles that share 180 of 240; their signatures agree in 75, 78 and 79 of 128 minima."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(214)]
    other = ["changed" if i in (20, 50, 80, 110, 140, 170) else w for i, w in enumerate(words)]
    out = minhash.near_duplicates(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in out} == {1: (1, True), 2: (1, False)}


def test_cluster_near_the_threshold(spark):
    """Many texts with one stem, most of them a little under the threshold from each other: every link counts, and only links."""
    from test_brute_force import near_duplicates

    rng = random.Random(5)
    stem = [f"s{i}" for i in range(100)]
    texts = {}
    for n in range(400):
        words = list(stem)
        for at in rng.sample(range(0, 100, 7), rng.choice([2, 2, 3, 1])):
            words[at] = f"x{rng.randrange(40)}"
        texts[n] = " ".join(words)
    out = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == near_duplicates(texts)


def test_blocks_bring_all_together(spark, monkeypatch):
    """With blocks of a few rows, every two rows of a key and of different components still meet in a job."""
    rows = [("k", i, 1 if i < 30 else i, 1) for i in range(60)] + [("m", 100 + i, 100 + i, 1) for i in range(5)]
    jobs = minhash._pairs_of_blocks(spark.createDataFrame(rows, "key string, doc_id long, component long, weight long"), "key", 8, "t").collect()
    met = set()
    by_pair: dict = {}
    for r in jobs:
        by_pair.setdefault(r["pair"], ([], []))
        if r["side"] != 1:
            by_pair[r["pair"]][0].append(r["doc_id"])
        if r["side"] != 0:
            by_pair[r["pair"]][1].append(r["doc_id"])
    for left, right in by_pair.values():
        met |= {frozenset((a, b)) for a in left for b in right}
    component = {r[1]: r[2] for r in rows}
    for k in ("k", "m"):
        ids = [r[1] for r in rows if r[0] == k]
        assert all(frozenset((a, b)) in met for a in ids for b in ids if component[a] != component[b])
    assert frozenset((3, 103)) not in met
