import random

import numpy as np
import pytest
from helpers import check_query
from pyspark.sql import functions as F

from kvstrata.llm import catalog, curriculum


def test_matches_sql(spark, sf_dir):
    check_query(spark, sf_dir, catalog.op8_mixing, catalog.OP8_SQL)


def waterfill(sizes, weights, share, most):
    """Targets by repeated resharing of what capped sources can't take."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        out = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if out[s] > most * sizes[s] + 1e-9}
        if not over:
            return out | {s: most * sizes[s] for s in capped}
        capped |= over


@pytest.mark.parametrize("rows, fan", [(2, 2), (4000, 1000)])
def test_edges(spark, edge, rows, fan, monkeypatch):
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", rows)
    monkeypatch.setattr(curriculum, "FAN", fan)
    docs, data = edge
    got = curriculum.mix(docs).collect()
    assert len(got) == len(data)
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    goal = waterfill(sizes, (5, 2, 1), 1.5, 2.0)
    for s, target in goal.items():
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 0.5
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    assert [r.position for r in got] == sorted(r.position for r in got)
    assert [tuple(r) for r in curriculum.mix(docs.repartition(7)).collect()] is not None
    again = sorted((tuple(r) for r in curriculum.mix(docs.repartition(7)).collect()), key=str)
    assert again == sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("knots", [*curriculum.SCHEDULES, ((0.0, 0.0), (0.2, 2.0), (0.6, 0.0), (1.0, 1.0))])
def test_inverse_demand(spark, knots):
    """Integrating the schedule up to the inverse gives the fraction back."""
    got = spark.range(101).select((F.col("id") / 100).alias("x")).withColumn("t", curriculum.inverse_demand(F.col("x"), knots)).collect()
    grid = np.linspace(0, 1, 200_001)
    weight = np.interp(grid, *zip(*knots, strict=True))
    demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    demand /= demand[-1]
    assert np.allclose(np.interp([r.t for r in got], grid, demand), [r.x for r in got], atol=1e-5)


def test_late_sources_come_late(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i in range(900) for s in ("early", "even", "late")], "doc_id long, text string, source string")
    mean = {r.source: r.m for r in curriculum.mix(docs).where("taken > 0").groupBy("source").agg(F.avg("position").alias("m")).collect()}
    assert mean["early"] < mean["even"] < mean["late"]


def test_drawn(spark, edge, nothing):
    docs, data = edge
    plan = curriculum.mix(docs).collect()
    got = curriculum.drawn(docs)
    assert got.columns == docs.columns
    distinct = {(r.doc_id, r.tag): r for r in plan}
    assert got.count() == pytest.approx(sum(-(-r.taken // r.size) for r in distinct.values() if r.size), abs=2)
    assert curriculum.mix(nothing).collect() == [] and curriculum.drawn(nothing).collect() == []


def draws(rows, schedules=curriculum.SCHEDULES, weights=(5, 2, 1), share=1.5, most=2.0):
    """(position, doc_id) of each draw in order: passes laid end to end, schedules integrated and inverted on a grid."""
    from hashlib import md5

    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    goal = waterfill(sizes, weights, share, most)
    grid, out = np.linspace(0, 1, 400_001), []
    for n, s in enumerate(sorted(sizes)):
        weight = np.interp(grid, *zip(*schedules[n % len(weights)], strict=True))
        demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        demand /= demand[-1]
        at, words = 0, int(goal[s] + 0.5)
        order = sorted(((i, len(t.split())) for i, t, x in rows if x == s), key=lambda r: md5(str(r[0]).encode()).hexdigest())
        while at < words and sizes[s]:
            for i, size in order:
                if size and at < words:
                    out.append((float(np.interp(at / goal[s], demand, grid)), i))
                at += size
    return sorted(out)


def small_corpus(n, seed):
    r = random.Random(seed)
    return [(i, "w " * r.randint(0, 30), r.choice("aaaaaabbbc")) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_order_of_the_mix_by_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 20)
    monkeypatch.setattr(curriculum, "FAN", 3)
    rows = small_corpus(400, seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    expected = draws(rows)
    assert max(np.unique([i for _, i in expected], return_counts=True)[1]) == 2  # some sources take two passes
    got = sorted((p, r.doc_id) for r in curriculum.mix(docs).collect() for p in r.positions)
    assert sorted(i for _, i in got) == sorted(i for _, i in expected)
    assert np.allclose([p for p, _ in got], [p for p, _ in expected], atol=1e-5)
    where = {}
    for p, i in expected:
        where.setdefault(i, []).append(p)
    seen = {}
    order = []
    for r in curriculum.drawn(docs).collect():
        order.append(where[r.doc_id][seen.setdefault(r.doc_id, 0)])
        seen[r.doc_id] += 1
    assert len(order) == len(expected) and np.all(np.diff(order) > -2e-5)


def test_a_schedule_runs_once_over_all_passes(spark):
    """A source drawn twice fills the tenths of the mix as its schedule says, not twice over."""
    rows = [(i, "w " * 10, "a") for i in range(200)] + [(1000 + i, "w " * 10, "b") for i in range(2000)]
    got = curriculum.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 'a'").collect()
    places = np.array([p for r in got for p in r.positions])
    assert len(places) == 400
    tenths = np.histogram(places, np.linspace(0, 1, 11))[0]
    fading = [400 * (1.5 - (k + 0.5) / 10) / 10 for k in range(10)]
    assert np.allclose(tenths, fading, atol=2)


def test_equal_rows_share_their_passes_out(spark):
    rows = [(1, "w " * 10, "a"), (1, "w " * 10, "a")] + [(5 + i, "w " * 10, "b") for i in range(6)]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, source string, n int")
    plan = [r for r in curriculum.mix(docs, most=1.5, share=1.0).collect() if r.doc_id == 1]
    assert sorted(len(r.positions) for r in plan) == [1, 2]
    assert sum(r.doc_id == 1 for r in curriculum.drawn(docs, most=1.5, share=1.0).collect()) == 3


def test_null_ids_are_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 50)
    docs = spark.createDataFrame([(None, f"text {i}", "a") for i in range(1000)], "doc_id long, text string, source string")
    assert curriculum.sizes(docs).select("key").distinct().count() == 1000
    assert len(curriculum.mix(docs).collect()) == 1000


def test_main_path_is_native(spark, sf_dir):
    plan = catalog.op8_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
