"""Point and multi-key reads, and read-modify-write folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import text
from ..plans.snapshot import live


def _key(frame: DataFrame, key: str | bytes) -> Column:
    if dict(frame.dtypes)["key"] == "binary":
        return F.lit(key.encode("utf-8") if isinstance(key, str) else bytes(key))
    return F.lit(key if isinstance(key, str) else key.decode("utf-8"))


def get(entries: DataFrame, key: str | bytes) -> DataFrame:
    """The entry of a key: one row or none. The equality reaches the scan."""
    return entries.where(F.col("key") == _key(entries, key)).limit(1)


def get_all(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """key and value (or null) for each distinct key of keys. Spark broadcasts either side if it is small enough."""
    return keys.select("key").distinct().join(entries.select("key", "value"), "key", "left")


def get_or_default(entries: DataFrame, keys: DataFrame, default: Column) -> DataFrame:
    """As get_all, with default where there is no entry."""
    found = entries.select("key", "value", F.lit(True).alias("found"))
    out = keys.select("key").distinct().join(found, "key", "left")
    return out.select("key", F.when(F.col("found"), F.col("value")).otherwise(default).alias("value"))


def exists(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """key and found for each distinct key of keys."""
    found = entries.select("key", F.lit(True).alias("found"))
    return keys.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


def remove(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """The entries whose keys are not in keys."""
    return entries.join(keys.select("key").distinct(), "key", "left_anti")


def search(entries: DataFrame, needle: str) -> DataFrame:
    """Entries whose key or value holds the trimmed needle, whatever its case."""
    q = F.lit(needle.strip().lower())
    return entries.where(F.contains(F.lower("key"), q) | F.contains(F.lower("value"), q))


def fold(log: DataFrame, **folds: Column) -> DataFrame:
    """Aggregates of all puts of a key: counters, sums and the like, as updates that read before they write."""
    return log.where("op = 'put'").groupBy("key").agg(*[c.alias(n) for n, c in folds.items()])


def fold_ordered(log: DataFrame, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """key and value: step applied to the puts of each key in order of seq, from start.

    The updater is a function of columns, folded natively. A key's puts are gathered in one row: use fold() where an
    aggregate does, as its partial sums don't grow with the puts of a key.
    """
    history = F.array_sort(F.collect_list(F.struct("seq", "value")))
    rows = log.where("op = 'put'").groupBy("key").agg(history.alias("history"))
    return rows.select("key", F.aggregate("history", start, lambda s, x: step(s, x["value"])).alias("value"))


def json_field(entries: DataFrame, path: str, as_type: str, name: str) -> DataFrame:
    """key and one field of JSON values."""
    return entries.select("key", F.get_json_object(text(F.col("value")), path).cast(as_type).alias(name))


def key_join(left: DataFrame, right_log: DataFrame, key: str) -> DataFrame:
    """Multi-get of a column's keys into another box: left with value, null where that box has no entry."""
    right = live(right_log).select(F.col("key").alias(key), "value")
    return left.join(right, key, "left")


def union_boxes(boxes: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """The logs of several boxes as one, with the column collection."""
    named = [log.withColumn("collection", F.lit(name)) for name, log in boxes]
    out = named[0]
    for log in named[1:]:
        out = out.unionByName(log)
    return out
