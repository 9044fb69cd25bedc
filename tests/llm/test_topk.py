import math
import random

import numpy as np
import pytest
from helpers import check_query

from kvstrata.llm import catalog, topk


def test_matches_sql(spark, sf_dir):
    check_query(spark, sf_dir, catalog.op2_topk, catalog.OP2_SQL)


def brute(rows, k, every):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in good if i % every == 0}):
        own = min(v for i, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in good if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed, monkeypatch):
    r = random.Random(seed)
    scale = [1, 5, 0.05][seed]
    rows = [(i, [float(np.float32(r.gauss(0, scale * (1 + 3 * (j < 2))))) for j in range(8)]) for i in range(400)]
    rows += [(1000 + i, list(rows[7][1])) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (2005, [0.5] * 3), (None, [1.0] * 8), (40, rows[40][1]), (3000, [0.0] * 8)]
    frame = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, norm double")
    monkeypatch.setattr(topk, "SAMPLE", 50)
    monkeypatch.setattr(topk, "LONGEST", 20)
    got = topk.search(frame, k=6, every=20, block_rows=64).collect()
    assert {tuple(x) for x in got} == brute(rows, 6, 20) and len(got) == len(set(got))


def test_fewer_than_k_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(frame).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.search(frame.limit(0)).collect() == []


def test_scores_beyond_a_double_are_exact(spark):
    q = np.array([[2.0**30 + 1, 3.0], [2.0**31 - 1, -1.0]])
    expected = [[int(a[0]) * int(b[0]) + int(a[1]) * int(b[1]) for b in q] for a in q]
    assert topk._scores(q, q).tolist() == expected and topk._pair_scores(q, q[::-1]).tolist() == [expected[0][1], expected[1][0]]
    with pytest.raises(OverflowError):
        topk._scores(q * 2.0**10, q)
    big = [(i, [float(2**24 - i % 7), float(2**23 + i), -float(i % 5)]) for i in range(120)]
    frame = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = topk.search(frame, k=7, every=20, block_rows=16).collect()
    assert {tuple(x) for x in got} == brute(big, 7, 20)
    with pytest.raises(Exception, match="beyond a long"):
        topk.search(spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, 1.0])], "vec_id long, embedding array<double>")).collect()


def test_heads_and_lengths_prune(spark, monkeypatch):
    """Lengths that differ keep queries from most blocks, and partial sums keep most pairs from being scored."""
    r = np.random.default_rng(3)
    monkeypatch.setattr(topk, "SAMPLE", 200)
    monkeypatch.setattr(topk, "LONGEST", 100)
    rows = [(i, (r.normal(size=16) * r.lognormal(0, 1) * np.linspace(3, 0.2, 16)).tolist()) for i in range(2000)]
    counts = {}
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=100, counts=counts).collect()
    assert {tuple(x) for x in got} == brute(rows, 20, 20)
    assert counts["queries"].value == 100 and counts["sent"].value < 0.7 * 100 * 20
    assert counts["scored"].value < 0.3 * 100 * 2000
