"""Compressed vectors against plain integer k-means, and the tree against all distances."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import SF, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from vatloom.llm import vector_codes as M


def nearest(points, entries):
    """By Python integers."""
    out = []
    for p in points.tolist():
        d = [sum((x - y) ** 2 for x, y in zip(p, e)) for e in entries.tolist()]
        out.append((d.index(min(d)), min(d)))
    return [o[0] for o in out], [o[1] for o in out]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 40), st.integers(1, 5), st.sampled_from([2, 5, 1000, 1 << 26]), st.integers(0, 10_000))
def test_tree_against_all_distances(k, n, width, most, seed):
    rng = np.random.default_rng(seed)
    entries, points = rng.integers(-most, most + 1, (k, width)), rng.integers(-most, most + 1, (n, width))
    which, best = M.Tree(entries, leaf=3).nearest(points)
    assert (which.tolist(), best.tolist()) == nearest(points, entries)


def test_tree_is_a_search_not_a_scan(monkeypatch):
    """On clustered entries most leaves are passed over."""
    rng = np.random.default_rng(1)
    entries = (rng.integers(-9000, 9000, (16, 1, 4)) + rng.integers(-20, 20, (16, 16, 4))).reshape(-1, 4)
    looked, real = [], M.squares
    monkeypatch.setattr(M, "squares", lambda p, e: looked.append(len(p) * len(e)) or real(p, e))
    tree = M.Tree(entries)
    looked.clear()
    points = entries[rng.integers(0, 256, 2000)] + rng.integers(-20, 20, (2000, 4))
    which, best = tree.nearest(points)
    assert (which.tolist(), best.tolist()) == nearest(points, entries)
    assert sum(looked) < 0.25 * 2000 * 256


def plainly(rows, entries=256, rounds=4):
    """(vec_id, code, error) rows, and codebooks, by the contract."""
    dims = None
    kept = []
    for i, v, label in sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        dims = dims or len(v) if len(v) % 4 == 0 else dims
        if len(v) == dims:
            kept.append((i, [math.floor(1024 * x) for x in v], label))
    w = dims // 4
    cut = [np.array([v[p * w : p * w + w] for _, v, _ in kept]) for p in range(4)]
    books = [c[:entries].copy() for c in cut]
    for _ in range(rounds):
        for p in range(4):
            which, _ = nearest(cut[p], books[p])
            for e in set(which):
                mine = cut[p][[i for i, x in enumerate(which) if x == e]]
                books[p][e] = [sum(c) // len(mine) for c in mine.T.tolist()]
    found = [nearest(cut[p], books[p]) for p in range(4)]
    return [(i, "".join(f"{f[0][n]:02x}" for f in found), sum(f[1][n] for f in found), label) for n, (i, _, label) in enumerate(kept)], books


def rows_of(n, dims, seed):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in rng.normal(size=dims)], int(i % 3) if i % 5 else None) for i in rng.permutation(n)]


@pytest.mark.parametrize("entries", [256, 9])
def test_whole_operator_against_plain(spark, entries):
    rows = rows_of(120, 8, entries)
    rows += [(5, rows[3][1], 1), (None, rows[4][1], 1), (6, rows[3][1], 1), (300, None, 1), (301, [1.0] * 7 + [None], 1), (302, [1.0] * 7 + [float("nan")], 1), (303, [float("inf")] * 8, 1), (304, [], 2), (305, [1.0] * 4, 2), (-7, [1.0] * 3, 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(5)
    books = M.train(df, "vec_id", "embedding", entries=entries)
    wanted, plain = plainly(rows, entries)
    assert [b.tolist() for b in plain] == [b.tolist() for b in books.entries]
    got = M.compress(df, books, "embedding").select("vec_id", "compressed.code", "compressed.error", "label")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:3])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(wanted, key=key)
    sums = {}
    for r in wanted:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    for few in (100_000, 0):
        M.SENT_LABELS, before = few, M.SENT_LABELS
        try:
            assert {(r.label, r.s) for r in M.summed_over(got, "label", "error", "s").collect()} == set(sums.items())
        finally:
            M.SENT_LABELS = before


def test_large_components_and_none(spark):
    df = spark.createDataFrame([(1, [1e300] * 8), (2, [-1e300] * 8), (3, [0.0] * 8)], "vec_id long, embedding array<double>")
    books = M.train(df, "vec_id", "embedding")
    assert books.entries.max() == books.bound and {r.error for r in M.compress(df, books, "embedding").select("compressed.error").collect()} == {0}
    assert M.train(df.where("vec_id > 5"), "vec_id", "embedding") is None


def test_no_vectors_give_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = M.op12_vector_codes(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_query_matches_sql(spark, duck):
    same_rows(M.op12_vector_codes(spark, SF), duck.sql(M.OP12_SQL))
