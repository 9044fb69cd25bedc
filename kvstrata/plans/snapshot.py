"""Snapshots of mutation logs: last writer wins.

The newest row of a key is found by row_number() = 1, which Spark plans with a group limit below the shuffle: each
task sends one row a key at most, so that a key with a third of all mutations doesn't make a hot task. Filters on
key may stand above or below; filters on op or value must stand above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PUT


def _by(log: DataFrame) -> list[str]:
    return [c for c in ("collection", "key") if c in log.columns]


def latest(log: DataFrame) -> DataFrame:
    """The newest mutation of each key, tombstones included."""
    newest = Window.partitionBy(*_by(log)).orderBy(F.desc("seq"))
    return log.withColumn("__nth", F.row_number().over(newest)).where("__nth = 1").drop("__nth")


def live(log: DataFrame, unique: bool = False) -> DataFrame:
    """The live entries: newest mutations that are puts. unique: the log has one row a key (one compacted generation)."""
    return (log if unique else latest(log)).where(F.col("op") == PUT)


def as_of(log: DataFrame, seq: int | Column) -> DataFrame:
    """The live entries as they were after the mutation seq."""
    return live(log.where(F.col("seq") <= seq))


def merge(*runs: DataFrame) -> DataFrame:
    """Newest-wins merge of runs, live entries only."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return live(out)


def compacted(log: DataFrame, below: int) -> DataFrame:
    """Generations under below merged to live entries, newer ones as they are."""
    old = live(log.where(F.col("gen") < below))
    return old.unionByName(log.where(F.col("gen") >= below))
