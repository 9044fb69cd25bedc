"""Operator 1: URL rules, and an empirical-Bayes reputation of hosts where no rule fits.

Labelled page outcomes are counted for hosts. Bad rates are shrunk from the top down: a suffix towards all outcomes,
a registered domain towards its suffix, a host towards its domain. A group's beta-binomial prior has the mean of its
parent, taken without the group's own outcomes. Its strength (pseudo-outcomes) is found by the method of moments from
the groups of that level, and limited by what supports the parent's mean: the variances of both add up. A host is
blocked when the lower bound of its posterior bad rate, z standard deviations under the mean, exceeds a limit. A host
without outcomes has its prior only, so it is blocked on strong evidence about its domain alone.

Sizes: outcomes are summed per host before any shuffle of groups; the final join takes narrow pages rows salted by
page_id, so that one host with a third of all pages is dealt to many tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, spread_join, written

#: Suffixes of two names, under which domains are registered (fixed values; pass more where needed).
TWO_NAME_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
Z, LIMIT = 1.645, 0.5
#: Bounds of a prior's strength.
WEAKEST, STRONGEST = 1.0, 1000.0
SALTS = 16
#: An IPv4 address, or an IPv6 one in brackets.
ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$"


class Rule(NamedTuple):
    """A rule fits its host and all subdomains where the url's path starts with path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].translate(str.maketrans(UPPER, LOWER))

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: The production rules (fixed values).
RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (length, rule, verdict) of the longest fitting rule, or null. The rules are a short list, part of the plan."""
    fitting = [
        F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in rules
    ]
    return F.array_max(F.array(*fitting)) if rules else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def domain_and_suffix(host: Column, suffixes: tuple[str, ...] = TWO_NAME_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, without its port; an address or a host of one name is both itself."""
    bare = F.regexp_replace(host, r":\d*$", "")
    names = F.split(bare, r"\.")
    two = F.concat_ws(".", F.slice(names, -2, 2))
    long_suffix = two.isin(*suffixes)
    single = (F.size(names) < 2) | bare.rlike(ADDRESS)
    domain = F.when(single, bare).when(long_suffix & (F.size(names) > 2), F.concat_ws(".", F.slice(names, -3, 3))).otherwise(two)
    suffix = F.when(single, bare).when(long_suffix, two).otherwise(F.element_at(names, -1))
    return domain, suffix


def _strength() -> Column:
    """Pseudo-outcomes of the prior of groups (n, bad, mean) about their means, by the method of moments."""
    noise = F.sum(F.col("mean") * (1 - F.col("mean")))
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2))
    within = F.sum(F.col("n") * F.col("mean") * (1 - F.col("mean")))
    # E[spread] = noise + (within - noise) / (strength + 1)
    excess = (spread - noise) / F.nullif(within - noise, F.lit(0.0))
    found = F.when(excess > 0, 1 / excess - 1).otherwise(STRONGEST)
    return F.coalesce(F.least(F.greatest(found, F.lit(WEAKEST)), F.lit(STRONGEST)), F.lit(STRONGEST))


def _level(groups: DataFrame) -> DataFrame:
    """groups (n, bad, and their parent's p_n, p_bad, p_mean, p_size) with their priors: mean and size."""
    support = F.col("p_size") + F.col("p_n") - F.col("n")
    groups = groups.withColumn("support", support).withColumn("mean", (F.col("p_size") * F.col("p_mean") + F.col("p_bad") - F.col("bad")) / F.col("support"))
    strength = groups.where("n > 0").agg(_strength().alias("strength"))
    return groups.withColumn("size", 1 / (1 / strength.scalar() + 1 / F.col("support"))).drop("support", "p_n", "p_bad", "p_mean", "p_size")


def _under(rows: DataFrame, parents: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of their parent group; a suffix or domain may hold most of them."""
    parents = parents.select(key, "hosts", F.col("n").alias("p_n"), F.col("bad").alias("p_bad"), F.col("mean").alias("p_mean"), F.col("size").alias("p_size"))
    return spread_join(rows, written(parents, key), [key], "hosts", total).drop("hosts")


def reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """host, n, bad, post_mean, post_bound from one row a host with its outcomes (host, n, bad).

    post_bound is the lower bound of the posterior bad rate. At the root the prior is one pseudo-outcome of mean 0.5.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.select("host", F.col("n").cast("double").alias("n"), F.col("bad").cast("double").alias("bad"), domain.alias("domain"), suffix.alias("suffix"))
    count, sums = hosts.count(), (F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("hosts"))
    total = hosts.agg(F.struct(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")).alias("all")).scalar()
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("p", total)
    suffixes = _level(suffixes.select("suffix", "n", "bad", "hosts", F.col("p.n").alias("p_n"), F.col("p.bad").alias("p_bad"), F.lit(0.5).alias("p_mean"), F.lit(1.0).alias("p_size")))
    domains = hosts.groupBy("suffix", "domain").agg(*sums).withColumnRenamed("hosts", "own")
    domains = _level(_under(domains, suffixes, "suffix", count)).withColumnRenamed("own", "hosts")
    found = _level(_under(hosts, domains, "domain", count))
    mean = (F.col("size") * F.col("mean") + F.col("bad")) / (F.col("size") + F.col("n"))
    found = found.withColumn("post_mean", mean)
    spread = F.sqrt(F.greatest(F.col("post_mean") * (1 - F.col("post_mean")), F.lit(0.0)) / (F.col("size") + F.col("n") + 1))
    return found.select("host", "n", "bad", "post_mean", (F.col("post_mean") - z * spread).alias("post_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, post_bound of every row of pages (page_id, url).

    outcomes: (page_id, bad 0/1); repeated rows count as further outcomes, nulls in either column as none. A null
    url or one without :// has an empty host, which is a host like any other; a long one is read whole. Rules of equal
    length that fit are the same rule, so there are no ties. Rows that repeat are judged alike and all returned; an
    empty table gives no rows. Columns of other names are ignored.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    counts = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = pages.join(counts, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    bounds = reputation(written(hosts, "hosts"), z).select("host", "post_bound", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = pages.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"), F.lit(0)))
    best = longest_rule(F.col("host"), F.col("path"), rules)
    judged = salted.join(bounds, ["host", "salt"]).withColumn("best", best)
    method = F.when(F.col("post_bound") > limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", method).alias("verdict"), "post_bound")
