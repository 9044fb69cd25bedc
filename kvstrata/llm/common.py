"""Helpers that the training-data operators share: tables, the shared folder, cutting lineage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom
from ..sources.files import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java regular expression of one white-space character as the contracts define it.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts of a column, for numbers of partitions that follow the input."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(column).cast("string"))), F.lit(0))).first()[0]


def text_tag(docs: DataFrame) -> Column:
    """A hash of the text, null as empty: with doc_id it names a row even where rows repeat a doc_id."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("tag")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs that gone (doc_id, tag) doesn't name, with the columns of docs."""
    names = gone.select(F.col("doc_id").cast("long").alias("__gone_id"), F.col("tag").alias("__gone_tag"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone_id")) & (F.col("__tag") == F.col("__gone_tag"))
    return docs.withColumn("__tag", text_tag(docs)).join(names, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


#: Keys that are broadcast at most, and rows up to which no key is.
HOT, LEAST_HOT = 2_000, 10_000


def spread_join(rows: DataFrame, per_key: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with per_key (one row a key, whose rows are counted in a column of it), whatever share of rows a key has.

    Keys of more than total / HOT rows are HOT at most: they are broadcast, so that their rows stay where they are. Those
    of the others are shuffled. how: inner, or left for rows without a key in per_key too. Keys are never null.
    """
    many = F.col(count) > max(LEAST_HOT, total // HOT)
    hot = per_key.where(many)
    of_hot = rows.join(F.broadcast(hot), on)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(per_key.where(~many), on, how)
    return of_hot.unionByName(others)


#: Paths that scratch() has given.
_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """The number of scratch paths so far, for sweep()."""
    return len(_made)


def sweep(spark: SparkSession, since: int, *keep: str) -> None:
    """Delete the scratch tables made since then but those to keep; for when what was computed from them is written."""
    discard(spark, *[p for p in _made[since:] if p not in keep])
    _made[since:] = [p for p in _made[since:] if p in keep]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    with cleaning(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """The rows of df as written() gives them; all other scratch tables made since then are deleted, so only df may need them."""
    out = written(df, name)
    sweep(df.sparkSession, since, _made[-1])
    return out


def discard(spark: SparkSession, *frames_or_paths: DataFrame | str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for x in frames_or_paths:
        paths = [x] if isinstance(x, str) else {f.rsplit("/", 1)[0] for f in x.inputFiles()}
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def maybe_among(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose column may be among the keys (a written table): all that are, and one in a hundred of the others.

    A Bloom filter of bounded size decides where the rows lie, before anything is shuffled; beyond some 10^7 keys it lets
    more rows through, which changes the time and not the result of a join with the keys.
    """
    bits, hashes = bloom.size_for(keys.count())
    bits = min(bits, bloom.MOST_BITS)
    words = written(bloom.build(keys, key, bits, hashes), "filter").scalar()
    return rows.where(bloom.might_contain(words, F.col(column), bits, hashes))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for the actions inside."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cleaning(spark: SparkSession):
    """Actions inside delete their shuffle files when they end, as nothing reads those again."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def batches_of(spark: SparkSession, rows: int):
    """Actions inside send Python that many rows at once, at most: for whole texts, of which 10,000 take much memory twice."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows))


def release() -> None:
    """Give freed memory back at the end of a task, as workers live on for tasks of other kinds."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # no such function on this system
        ctypes.CDLL(None).malloc_trim(0)
