"""Mutation logs as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DELETE, PUT


class Batch:
    """An ordered list of puts and deletes that is written as one generation, so all of it is visible or nothing."""

    def __init__(self, operations: Iterable[tuple[str, str | bytes, str | bytes | None]] = ()):
        self._operations = list(operations)

    def put(self, key: str | bytes, value: str | bytes) -> Batch:
        return Batch([*self._operations, (PUT, key, value)])

    def delete(self, key: str | bytes) -> Batch:
        return Batch([*self._operations, (DELETE, key, None)])

    def put_all(self, entries: dict | Iterable[tuple]) -> Batch:
        pairs = entries.items() if isinstance(entries, dict) else entries
        return Batch([*self._operations, *[(PUT, k, v) for k, v in pairs]])

    def __len__(self) -> int:
        return len(self._operations)

    @property
    def is_empty(self) -> bool:
        return not self._operations

    @property
    def operations(self) -> list[tuple]:
        return list(self._operations)

    def to_df(self, spark: SparkSession, base: int = 0) -> DataFrame:
        """key, op, value, seq: positions from base give the order, so the last of equal keys wins."""
        as_bytes = lambda x: None if x is None else bytearray(x.encode("utf-8") if isinstance(x, str) else x)
        rows = [(as_bytes(k), op, as_bytes(v), base + i) for i, (op, k, v) in enumerate(self._operations)]
        return spark.createDataFrame(rows, "key binary, op string, value binary, seq long")


def puts(rows: DataFrame, key: Column, value: Column, seq: Column) -> DataFrame:
    """A log of puts from any frame; seq must order them totally."""
    return rows.select(key.alias("key"), F.lit(PUT).alias("op"), value.alias("value"), seq.cast("long").alias("seq"))


def deletes(rows: DataFrame, key: Column, seq: Column, value_type: str = "string") -> DataFrame:
    """A log of tombstones, written whether or not the keys exist."""
    return rows.select(key.alias("key"), F.lit(DELETE).alias("op"), F.lit(None).cast(value_type).alias("value"), seq.cast("long").alias("seq"))


def replay(log: DataFrame, bad: Column) -> DataFrame:
    """The valid prefix of a log: everything before the first bad record by seq."""
    first = log.where(bad).agg(F.coalesce(F.min("seq"), F.lit(2**63 - 1)).alias("first"))
    return log.where(F.col("seq") < first.scalar())
