from hashlib import sha256

import pytest
from cases import lower
from helpers import check_query
from pyspark.sql import functions as F

from kvstrata.llm import catalog, exact_dedup


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(lower(t), []).append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(((i, keep[lower(t)], len(groups[lower(t)]), i == keep[lower(t)], sha256(lower(t).encode()).hexdigest()) for i, t, _ in rows), key=str)


def test_matches_sql(spark, sf_dir):
    check_query(spark, sf_dir, catalog.op3_exact_dedup, catalog.OP3_SQL)


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("files", [None, 1])
def test_brute_force(spark, edge, weak, files):
    """A weak digest of three values stands for many texts: full bytes tell them apart."""
    docs, rows = edge
    digest = (lambda c: F.lpad((F.crc32(c) % 3).cast("string"), 4, "0")) if weak else exact_dedup.sha256
    got = exact_dedup.deduplicate(docs, digest, files).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_second_delivery_meets_the_state_of_the_first(spark, edge, tmp_path):
    docs, rows = edge
    for i in range(3):
        docs.where(F.pmod(F.xxhash64("text"), F.lit(3)) <= i).write.parquet(str(tmp_path / f"in{i}"))
    seen = []
    for i in range(3):
        part = spark.read.parquet(str(tmp_path / f"in{i}"))
        own = [(r.doc_id, r.text, r.source) for r in part.collect()]
        seen += own
        expected = brute(seen)
        got = sorted(map(tuple, exact_dedup.deduplicate(part, state=str(tmp_path / "state")).collect()), key=str)
        assert len(got) == len(own) and set(got) <= set(expected)


def test_one_hot_text(spark, monkeypatch):
    from kvstrata.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 3)
    monkeypatch.setattr(common, "HOT", 10)
    rows = [(i, "Hot" if i % 3 else f"own {i}", "s") for i in range(90)] + [(200, "own 0", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert sorted(map(tuple, exact_dedup.deduplicate(docs).collect()), key=str) == brute(rows)


def test_survivors(spark, edge):
    docs, rows = edge
    got = exact_dedup.survivors(docs)
    assert got.columns == docs.columns
    expected = sorted({(lower(t), keep) for (i, t, _), (_, keep, *_) in zip(rows, [next(b for b in brute(rows) if b[0] == i and b[4] == sha256(lower(t).encode()).hexdigest()) for i, t, _ in rows], strict=True)}, key=str)
    assert sorted(((lower(r.text), r.doc_id) for r in got.collect()), key=str) == expected


def test_empty(nothing):
    assert exact_dedup.deduplicate(nothing).collect() == [] and exact_dedup.survivors(nothing).collect() == []


def test_main_path_is_native(spark, sf_dir):
    plan = catalog.op3_exact_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
