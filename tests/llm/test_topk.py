from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import topk


def brute(rows, query_ids, k):
    """In Python's whole numbers."""
    out = []
    for q in query_ids:
        query = [int(x) for x in next(r[1] for r in rows if r[0] == q)]
        scores = sorted((-sum(int(x) * y for x, y in zip(v, query)), i) for i, v in rows if i != q)
        out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores[:k])]
    return out


@given(st.integers(1, 60), st.integers(1, 4), st.integers(1, 8), st.integers(0, 10**6))
def test_tree(n, width, leaf, seed):
    rng = np.random.default_rng(seed)
    vectors, ids = rng.integers(-3, 4, (n, width)).astype(float), rng.permutation(n)
    tree = topk.KDTree(vectors, ids, leaf)
    query = rng.integers(-3, 4, width).astype(float)
    own = int(ids[0])
    got = tree.search(query, own, 5, tree.bounds(query[None])[0], -np.inf)
    scores = vectors @ query
    assert got == [(int(scores[i]), int(ids[i])) for i in np.lexsort((ids, -scores)) if ids[i] != own][:5]


@pytest.mark.parametrize("size", [2**20, 2**24, 2**29, 2**40])
@pytest.mark.parametrize("shard", [16384, 40])
def test_large_components(spark, monkeypatch, size, shard):
    """Sums beyond 2**53, and beyond a long."""
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    rng = np.random.default_rng(size)
    rows = [(i, [float(x) for x in rng.integers(-size, size, 12)]) for i in range(150)] + [(200 + i, [float(size - 1)] * 11 + [float(i % 3)]) for i in range(9)]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = [tuple(r) for r in topk.top_k(table, table.filter("vec_id % 10 = 0")).collect()]
    want = brute(rows, [i for i, _ in rows if i % 10 == 0], 5)
    if size < 2**40:
        assert sorted(got) == sorted(want)
    else:
        assert [(q, r, s) for q, r, _, s in sorted(got)] == [(q, r, s) for q, r, _, s in sorted(want)]


def test_scaling(spark):
    huge = 1.7e308
    values = [1e9, -1e9, 2.0**45 + 0.25, 0.3, -0.3, huge, -huge, 5e-324, -5e-324]
    table = spark.createDataFrame([(1, values)], "vec_id long, embedding array<double>")
    got = topk._usable(table).first().vector
    assert [int(x) for x in got[:5]] == [256 * 10**9, -256 * 10**9, 2**53 + 64, 76, -77] and got[5] == -got[6] == 1.7976931348623157e308 and got[7:] == [0.0, -1.0]
    both = spark.createDataFrame([(0, [1e9, 0.5]), (1, [1e9, 0.25]), (2, [huge, 0.0])], "vec_id long, embedding array<double>")
    usable = topk._usable(both)
    assert sorted(map(tuple, topk.top_k(usable, usable.filter("vec_id = 0")).collect())) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1)]


@pytest.mark.parametrize(("shard", "block"), [(16384, 2048), (50, 7), (3, 100)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    rng = np.random.default_rng(20)
    rows = [(i, (rng.integers(-100, 100, 8) if i % 3 else np.full(8, 7)).astype(float).tolist()) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = [tuple(r) for r in topk.top_k(table, table.filter("vec_id % 10 = 0")).collect()]
    assert sorted(got) == sorted(brute(rows, range(0, 400, 10), 5))


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.1, -0.1]), (50, [1.0, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, vector string")
    usable = topk._usable(table)
    assert sorted(r.vec_id for r in usable.collect()) == [0, 5, 7, 8, 50]
    got = [tuple(r) for r in topk.top_k(usable, usable.filter("vec_id % 50 = 0")).collect()]
    assert sorted(got)[:4] == [(0, 1, 50, 65536), (0, 2, 7, 32768), (0, 3, 8, 0), (0, 4, 5, 128 * 25 - 128 * 26)]
    empty = usable.filter("false")
    assert topk.top_k(empty, empty).count() == 0
    twice = usable.filter("vec_id = 0").unionByName(usable.filter("vec_id = 0")).unionByName(usable.filter("vec_id = 50"))
    assert [(r.query_id, r["rank"], r.vec_id) for r in topk.top_k(twice, twice.filter("vec_id = 0")).collect()] == [(0, 1, 50)]
