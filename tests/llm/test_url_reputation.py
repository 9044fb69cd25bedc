import numpy as np
import pytest
from helpers import check_query
from pyspark.sql import functions as F

from kvstrata.llm import catalog
from kvstrata.llm import url_reputation as U


def test_matches_sql(spark, sf_dir):
    check_query(spark, sf_dir, catalog.op1_url_filters, catalog.OP1_SQL)


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://ORG/a", "org", "/a", "org/", "allow"),
        ("http://Sub.Example.ORG/es/1?x", "sub.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
        ("http://example.org/en/27#f", "example.org", "/en/27", "org/", "allow"),
        ("http://example.org", "example.org", "", None, "allow"),
        ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        ("x://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        ("x://a.com/de/?q", "a.com", "/de/", "com/de/", "block"),
        ("x://a.com?/de/", "a.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://a://b/c", "a:", "//b/c", None, "allow"),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x")], "page_id long, url string, salt string")
    outcomes = spark.createDataFrame([], "page_id long, bad int")
    got = U.judge(pages, outcomes).select("host", "path", "rule", "verdict").collect()
    assert [tuple(r) for r in got] == [(host, path, rule, verdict)]


def test_reputation_blocks_bad_hosts_and_shrinks_small_ones(spark):
    pages = [(i, f"http://bad.spam.net/{i}") for i in range(60)] + [(100 + i, f"http://good.fine.net/{i}") for i in range(60)]
    pages += [(200, "http://new.spam.net/a"), (201, "http://lone.else.net/a"), (None, "http://good.fine.net/n"), (202, "http://lone.else.net/a")]
    outcomes = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(201, 1), (None, 1), (5, None), (999, 1)]
    pages = spark.createDataFrame(pages, "page_id long, url string")
    outcomes = spark.createDataFrame(outcomes, "page_id long, bad int")
    got = {r.page_id: r for r in U.judge(pages, outcomes, rules=()).collect()}
    assert len(got) == 124 - 0 and got[0].verdict == "block" and got[100].verdict == "allow"
    assert got[201].verdict == "allow"  # one bad outcome of an unknown domain isn't enough
    assert got[200].post_bound > got[201].post_bound  # a new host inherits its domain's record
    assert all(r.rule is None for r in got.values())


def test_domains(spark):
    rows = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("com",), ("x.y.b.com:80",), ("",), ("co.uk",)], "h string")
    d, s = U.domain_and_suffix(rows.h)
    assert [tuple(r) for r in rows.select(d, s).collect()] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("b.com", "com"), ("", ""), ("co.uk", "co.uk")]


def test_addresses_and_ports(spark):
    rows = spark.createDataFrame([("10.1.3.4",), ("10.1.3.4:8080",), ("localhost:80",), ("localhost",), ("[::1]:80",), ("1.2.3.4.com",)], "h string")
    d, s = U.domain_and_suffix(rows.h)
    assert [tuple(r) for r in rows.select(d, s).collect()] == [("10.1.3.4",) * 2, ("10.1.3.4",) * 2, ("localhost",) * 2, ("localhost",) * 2, ("[::1]",) * 2, ("4.com", "com")]


@pytest.mark.parametrize("strength", [4.0, 40.0])
def test_moments_find_the_strength_that_made_the_rates(spark, strength):
    """Hosts whose bad rates are drawn from a beta distribution give its strength back, and bounds hold the rates."""
    r = np.random.default_rng(int(strength))
    rates = r.beta(0.3 * strength, 0.7 * strength, 4000)
    bad = r.binomial(40, rates)
    hosts = [(f"h{i}.site.com", 40, int(b)) for i, b in enumerate(bad)]
    frame = spark.createDataFrame(hosts, "host string, n long, bad long")
    level = frame.select("n", "bad", F.lit(float(bad.sum()) / (40 * 4000)).alias("mean"))
    assert level.agg(U._strength()).first()[0] == pytest.approx(strength, rel=0.15)
    got = {x.host: x for x in U.reputation(frame).collect()}
    expected = (0.3 * strength + bad) / (strength + 40)  # the posterior under the true prior
    assert np.allclose([got[h].post_mean for h, _, _ in hosts], expected, atol=0.03)
    under = np.mean(rates > [got[h].post_bound for h, _, _ in hosts])
    assert 0.92 < under < 0.98  # a one-sided bound of 95 %


def test_very_long_urls_and_a_hot_suffix(spark, monkeypatch):
    from kvstrata.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 5)
    monkeypatch.setattr(common, "HOT", 20)
    pages = [(i, f"http://s{i}.blog.com/{'x' * (100_000 if i == 3 else 5)}") for i in range(60)] + [(100, "http://a.net/")]
    pages = spark.createDataFrame(pages, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(60)], "page_id long, bad int")
    hot = sorted(map(tuple, U.judge(pages, outcomes).collect()), key=str)
    monkeypatch.setattr(common, "LEAST_HOT", 10**6)
    assert hot == sorted(map(tuple, U.judge(pages, outcomes).collect()), key=str) and len(hot) == 61


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).collect() == []
