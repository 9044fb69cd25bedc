"""Operator 3: stateful streaming deduplication by DataFrame functions only.

A fingerprint log (document id, digest of the normalised text, content locator) is written to the shared folder and
streamed through an aggregation whose keyed state lies on disk (RocksDB) and never expires: for each digest the stable
identifier of the document that stays, its locator, and the number of documents. The state is read back as a table.

A digest seen more than once is a hit. Hits are checked on full bytes: a Bloom filter of their digests (bounded size)
picks their documents, which are grouped by digest and whole text; map-side aggregation reduces a group of copies to
one row a task before the shuffle. A digest that turns out to stand for several texts is split by text. Only rows that
the filter lets through are joined with the state, those of a digest with very many rows without moving.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom
from .common import ascii_lower, discard, made, scratch, settled, spread_join, written

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(docs: DataFrame) -> Column:
    """The compared text: A-Z lower-cased, null as empty."""
    return ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))


def run_state(spark: SparkSession, log: str, schema, state: str, files_per_trigger: int | None = None) -> None:
    """Stream the log at that path into the keyed state under the checkpoint path state; returns when all is in."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    keyed = reader.parquet(log).groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("stays"), F.count("*").alias("n"))
    was = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """digest, keep_id, locator, group_size of every key in the state."""
    rows = spark.read.format("statestore").load(state)
    value = rows.schema["value"].dataType.names
    return rows.select(F.col("key.digest").alias("digest"), F.col(f"value.`{value[0]}`.doc_id").alias("keep_id"), F.col(f"value.`{value[0]}`.locator").alias("locator"), F.col(f"value.`{value[1]}`").alias("group_size"))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_trigger: int | None = None, state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs.

    Of equal texts the largest doc_id stays; a null doc_id is smaller than any. Null and empty texts are equal, long ones
    are compared whole. Rows with the same doc_id and text are copies of one document: each is counted and returned, and
    all have the same verdict. An empty table gives no rows. Other columns are ignored. digest may be any function of a
    text to a column; equal texts are found exactly, whatever its collisions.

    state: a path where the state is kept, in a shared folder. Texts are then compared with those of all earlier calls
    with that path too, which must have come from Parquet files (with doc_id and text) that are still there, as their
    locators say: those that hold a hit are read for the check on full bytes.
    """
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    base = state or scratch(spark, "dedup-state")
    path, call = f"{base}/log", uuid.uuid4().hex
    fresh = docs.select(doc_id, normalised(docs).alias("norm"), F.input_file_name().alias("locator"))
    fresh.select("doc_id", digest(F.col("norm")).alias("digest"), F.unhex(sha256(F.col("norm"))).alias("sha"), "locator", F.lit(call).alias("call")).write.mode("append").parquet(path)
    whole = spark.read.parquet(path)
    log = whole.where(F.col("call") == call)
    if log.isEmpty():
        return log.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    run_state(spark, path, whole.schema, f"{base}/keyed", files_per_trigger)
    hits = written(read_state(spark, f"{base}/keyed").where("group_size > 1"), "dedup-hits")
    if not state:
        discard(spark, f"{base}/keyed")
    bits, hashes = bloom.size_for(hits.count())
    bits = min(bits, bloom.MOST_BITS)
    words = written(bloom.build(hits, "digest", bits, hashes), "dedup-filter").scalar()
    may_hit = bloom.might_contain(words, F.col("digest"), bits, hashes)
    # inline() keeps the filter's many uses of the digest from each computing it anew
    digests = lambda rows: rows.select(doc_id, normalised(rows).alias("norm")).select(F.inline(F.array(F.struct("doc_id", "norm", digest(F.col("norm")).alias("digest")))))
    again = digests(docs)
    if state and (files := [r.locator for r in whole.where(F.col("call") != call).join(hits.select("digest"), "digest", "left_semi").select("locator").distinct().collect()]):
        if "" in files:
            raise ValueError("earlier texts did not come from files, so hits can't be checked on full bytes")
        again = again.unionByName(digests(spark.read.parquet(*files)))
    texts = again.where(may_hit).groupBy("digest", "norm").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))
    texts = written(texts.select("digest", F.unhex(sha256(F.col("norm"))).alias("sha"), "n", "keep"), "dedup-texts")
    several = texts.groupBy("digest").agg(F.count("*").alias("texts"), F.count_distinct("sha").alias("shas")).where("texts > 1")
    # a digest that is no hit has one row, which stays; only rows that may be hits are joined
    alone = log.where(~may_hit).select("*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    rows = spread_join(log.where(may_hit), hits.select("digest", "keep_id", "group_size", F.lit(True).alias("hit")), ["digest"], "group_size", log.count(), "left")
    rows = rows.withColumn("keep_id", F.when(F.col("hit"), F.col("keep_id")).otherwise(F.col("doc_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1)))
    rows = rows.drop("hit").unionByName(alone)
    if not several.isEmpty():  # some digests stand for several texts
        if not several.where("shas < texts").isEmpty():
            raise ValueError("different texts have the same SHA-256")
        split = texts.join(several, "digest").select(F.col("digest").alias("d"), F.col("sha").alias("s"), "keep", "n")
        rows = rows.join(split, (F.col("digest") == F.col("d")) & (F.col("sha") == F.col("s")), "left")
        rows = rows.withColumn("keep_id", F.when(F.col("n").isNull(), F.col("keep_id")).otherwise(F.col("keep"))).withColumn("group_size", F.coalesce("n", "group_size"))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns; of rows that repeat a doc_id and text one stays."""
    doc_id, sha, before = F.col("doc_id").cast("long"), sha256(normalised(docs)), made()
    verdicts = settled(deduplicate(docs), "dedup-verdicts", before)
    gone = verdicts.where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__gone"))
    rows = docs.withColumn("__sha", sha)
    rows = rows.join(gone, doc_id.eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__gone")), "left_anti")
    again = written(verdicts.where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__again")).count().where("count > 1").drop("count"), "dedup-again")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if again.isEmpty():
        return rows.select(*columns)
    same = doc_id.eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__again"))
    twice = rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "__sha"])
    return rows.join(again, same, "left_anti").unionByName(twice).select(*columns)
