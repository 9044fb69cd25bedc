"""Counts, sizes, sparse indexes and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bloom
from ..plans.snapshot import latest, live

#: Keys that a Bloom filter is made for at least where they are counted.
LEAST_EXPECTED = 10_000


def approximate_count(log: DataFrame) -> DataFrame:
    """approximate_count: distinct keys of each generation, summed, so overwritten and deleted entries count too."""
    return log.select("gen", "key").distinct().agg(F.count("*").alias("approximate_count"))


def exact_count(log: DataFrame) -> DataFrame:
    return live(log).agg(F.count("*").alias("exact_count"))


def generation_stats(log: DataFrame) -> DataFrame:
    """gen, entries, tombstones of each generation after its own overwrites."""
    newest = Window.partitionBy("gen", "key").orderBy(F.desc("seq"))
    own = log.withColumn("__nth", F.row_number().over(newest)).where("__nth = 1")
    return own.groupBy("gen").agg(F.count("*").alias("entries"), F.count_if(F.col("op") == "delete").alias("tombstones"))


def box_stats(log: DataFrame) -> DataFrame:
    """collection, newest_gen_entries, segment_count, approximate_count, exact_count of each collection of a log."""
    per_gen = log.groupBy("collection", "gen").agg(F.count_distinct("key").alias("entries"))
    whole = per_gen.groupBy("collection").agg(F.max_by("entries", "gen").alias("newest_gen_entries"), F.count("*").alias("segment_count"), F.sum("entries").alias("approximate_count"))
    exact = live(log).groupBy("collection").agg(F.count("*").alias("exact_count"))
    return whole.join(exact, "collection", "left").select("collection", "newest_gen_entries", "segment_count", "approximate_count", F.coalesce("exact_count", F.lit(0)).alias("exact_count"))


def size_bytes(log: DataFrame) -> DataFrame:
    """bytes: keys and values of the newest mutations; a tombstone has its key only."""
    value = F.coalesce(F.octet_length("value"), F.lit(0))
    return latest(log).agg(F.sum(F.octet_length("key") + value).cast("long").alias("bytes"))


def sparse_index(log: DataFrame, every: int = 64) -> DataFrame:
    """key, gen, place: each every-th key of a generation in key order, and its place; a newer generation's place wins."""
    if every < 1:
        raise ValueError("every is 1 or more")
    keys = log.select("gen", "key").distinct()
    placed = keys.withColumn("place", F.row_number().over(Window.partitionBy("gen").orderBy("key")) - 1).where(F.col("place") % every == 0)
    return placed.groupBy("key").agg(F.max(F.struct("gen", "place")).alias("e")).select("key", "e.gen", F.col("e.place").cast("long").alias("place"))


def semi(probe: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of probe whose key has an entry; exact."""
    return probe.join(entries.select("key"), "key", "left_semi")


def bloom_semi(probe: DataFrame, entries: DataFrame, expected: int | None = None, p: float = 0.01) -> DataFrame:
    """Rows of probe whose key may have an entry: all that have one, and others at a rate of about p.

    expected: the entries that the filter is made for; None counts them (LEAST_EXPECTED at least, as the rate of very
    small filters varies), so that the rate holds at any size up to some 10^7 keys, for filters have 16 MiB at most. With
    more entries than expected, or than that, more rows pass.
    """
    if expected is None:
        bits, hashes = bloom.size_for(max(LEAST_EXPECTED, entries.where("key IS NOT NULL").count()), p)
        bits = min(bits, bloom.MOST_BITS)
    else:
        bits, hashes = bloom.size_for(expected, p)
    words = bloom.build(entries, "key", bits, hashes).scalar()
    return probe.where(bloom.might_contain(words, F.col("key"), bits, hashes))
