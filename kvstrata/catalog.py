"""The queries over the driver tables, and the SQL that must give the same rows.

The events table is read as a mutation log: key u:<user id>, an event of type error deletes, all others put their
props; seq is the event id and a generation has 1000 of them. Documents are blobs. Ordered results carry pos. The
store_ queries write through boxes on disk, in the folder that driver and executors share, and read them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import entries as wire
from .functions.codecs import JsonCodec
from .operators import chunks, lookup, stats
from .plans import log as logs
from .plans import snapshot
from .plans.query import KVQuery
from .sources.blobs import BlobStore
from .sources.config import Config
from .sources.files import shared_dir
from .sources.store import Box, Store
from .streaming import watch

GEN = 1000
KEYS = ("u:000012", "u:000045", "u:000077", "u:999999")
RANGE = ("u:000020", "u:000060")
CHUNK = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(prefix: str, column: str, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), width, "0"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    gen = F.floor(F.col("event_id") / GEN).cast("long")
    return table(spark, sf_dir, "events").select(_padded("u:", "user_id", 6).alias("key"), op.alias("op"), F.col("props").alias("value"), F.col("event_id").alias("seq"), gen.alias("gen"))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.live(event_log(spark, sf_dir)).select("key", "value", "seq")


def wanted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in KEYS], "key string")


def customer_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    return logs.puts(table(spark, sf_dir, "customer"), _padded("c:", "c_custkey", 9), value, F.col("c_custkey"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return docs.select(F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"), name.alias("filename"), F.lit("text/plain").alias("mime_type"), F.col("doc_id").alias("at"))


def kv_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir)


def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get(live(spark, sf_dir), KEYS[0]).select("key", "value")


def kv_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.exists(live(spark, sf_dir), wanted(spark))


def kv_get_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get_all(live(spark, sf_dir), wanted(spark))


def kv_get_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get_or_default(live(spark, sf_dir), wanted(spark), F.lit("{}"))


def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KVQuery(live(spark, sf_dir)).entries()


def kv_scan_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KVQuery(live(spark, sf_dir)).prefix("u:00001").entries()


def kv_scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KVQuery(live(spark, sf_dir)).range(*RANGE).entries()


def kv_scan_prefix_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KVQuery(live(spark, sf_dir)).prefix("u:00003").range(*RANGE).entries()


def kv_page_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KVQuery(live(spark, sf_dir)).reverse().offset(3).limit(5).pages().select("pos", "key", "value")


def kv_page_prefix_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix and range, descending, offset and limit, and a JSON field: all parts of a scan at once."""
    page = KVQuery(live(spark, sf_dir)).prefix("u:0000").range(*RANGE).reverse().offset(2).limit(7).pages()
    return page.select("pos", "key", JsonCodec("k int").decode(F.col("value"))["k"].alias("k"))


def kv_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KVQuery(live(spark, sf_dir)).keys()


def kv_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.search(live(spark, sf_dir), " U:00004 ").select("key", "value")


def kv_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KVQuery(live(spark, sf_dir)).json("k int").select("key", F.col("value.k").alias("k"))


def kv_json_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = JsonCodec("k int").decode(F.col("value"))["k"]
    return KVQuery(live(spark, sf_dir)).where(k > 50).entries()


def kv_json_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same field without a schema."""
    value = F.parse_json("value")
    return live(spark, sf_dir).select("key", F.variant_get(value, "$.k", "int").alias("k"))


def kv_update_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every live object with its field k one higher."""
    found = JsonCodec("k int").decode(F.col("value"))
    return live(spark, sf_dir).select("key", F.to_json(F.struct((found["k"] + 1).alias("k"))).alias("value"))


def kv_count_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.approximate_count(event_log(spark, sf_dir))


def kv_count_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.exact_count(event_log(spark, sf_dir))


def kv_gen_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.generation_stats(event_log(spark, sf_dir))


def kv_box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.box_stats(_two_boxes(spark, sf_dir))


def kv_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_bytes(event_log(spark, sf_dir))


def kv_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live entries over generations of which the first eight are merged."""
    return snapshot.live(snapshot.compacted(event_log(spark, sf_dir), 8)).select("key", "value", "seq")


def kv_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest-wins merge of runs given one by one."""
    log = event_log(spark, sf_dir)
    return snapshot.merge(log.where("gen % 3 = 0"), log.where("gen % 3 = 1"), log.where("gen % 3 = 2")).select("key", "value", "seq")


def _at_nine_tenths(log: DataFrame) -> Column:
    """A seq that moves with the length of the log."""
    last = log.agg(F.max("seq")).scalar()
    return last - F.floor(last / 10)


def kv_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box as it was when the log had nine tenths of its length."""
    log = event_log(spark, sf_dir)
    return snapshot.as_of(log, _at_nine_tenths(log)).select("key", "value", "seq")


def kv_update_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.fold(event_log(spark, sf_dir), puts=F.count("*"))


def kv_update_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An updater run over each key's puts in order: the largest k so far plus one."""
    log = event_log(spark, sf_dir).withColumn("value", F.get_json_object("value", "$.k").cast("int"))
    return lookup.fold_ordered(log, F.lit(0), lambda s, k: F.greatest(s, F.coalesce(k, F.lit(0))) + 1)


def kv_batch_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every generation as one batch: of equal keys in each the last wins."""
    log = event_log(spark, sf_dir)
    newest = log.groupBy("gen", "key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("last"))
    return newest.select("gen", "key", "last.op", "last.value", "last.seq")


def kv_batch_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live entries after a batch of deletes."""
    log = event_log(spark, sf_dir)
    last = log.agg(F.max("seq")).scalar()
    tombstones = logs.deletes(wanted(spark), F.col("key"), last + 1)
    return snapshot.merge(log.select("key", "op", "value", "seq"), tombstones).select("key", "value", "seq")


def kv_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.remove(live(spark, sf_dir), wanted(spark))


def kv_wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix of the log before its first bad record, which is nine tenths in."""
    log = event_log(spark, sf_dir)
    return logs.replay(log, F.col("seq") == _at_nine_tenths(log)).select("key", "op", "value", "seq")


def kv_sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sparse_index(event_log(spark, sf_dir), 64)


def kv_watch_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.events(event_log(spark, sf_dir), "events")


def _two_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = customer_box(spark, sf_dir).withColumn("gen", F.lit(0).cast("long"))
    return lookup.union_boxes([("events", event_log(spark, sf_dir)), ("customers", customers)])


def kv_watch_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.events(_two_boxes(spark, sf_dir))


def kv_watch_prefix_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = watch.matching(watch.events(event_log(spark, sf_dir), "events"), prefix="u:0000")
    return watch.bounded(feed)


def kv_watch_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    subscriptions = spark.createDataFrame([(1, "events", "u:00001"), (2, "customers", None), (3, None, "u:00002"), (4, "events", "x")], "sub_id int, sub_collection string, sub_prefix string")
    return watch.fan_out(watch.events(_two_boxes(spark, sf_dir)), subscriptions)


def kv_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.poll(watch.events(event_log(spark, sf_dir), "events"), 250, 100)


def kv_bloom_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe keys that have an entry: a Bloom filter first, then the exact semi join."""
    box, probe = live(spark, sf_dir), table(spark, sf_dir, "customer").select(_padded("u:", "c_custkey", 6).alias("key"))
    return stats.semi(stats.bloom_semi(probe, box), box)


def kv_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _padded("c:", "o_custkey", 9).alias("c_key"))
    return lookup.key_join(orders, customer_box(spark, sf_dir), "c_key")


def kv_conversation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turns of one conversation: a composite key, a prefix, descending order and a limit."""
    turns = table(spark, sf_dir, "conversations")
    key = F.concat(F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("/"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    box = turns.select(key.alias("key"), F.col("text").alias("value"))
    return KVQuery(box).prefix("00000003/").reverse().limit(3).pages().select("pos", "key", "value")


def kv_lineitem_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a range of orders by composite key."""
    key = F.concat(_padded("", "l_orderkey", 9), F.lit("/"), F.col("l_linenumber").cast("string"))
    box = table(spark, sf_dir, "lineitem").select(key.alias("key"), F.col("l_returnflag").alias("value"))
    return KVQuery(box).range("000000010", "000000050").entries()


def kv_label_get_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-get with missing keys: the labels of all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    box = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("value"))
    return lookup.get_all(box, docs)


def blob_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.files(blobs(spark, sf_dir), CHUNK).select("file_id", "filename", "total_size", "chunk_count")


def blob_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split(blobs(spark, sf_dir), CHUNK).select("file_id", "index", F.hex("data").alias("data_hex"))


def blob_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files put together again from their chunks."""
    all_blobs = blobs(spark, sf_dir)
    whole = chunks.assemble(chunks.split(all_blobs, CHUNK), chunks.files(all_blobs, CHUNK))
    return whole.select("file_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha"))


def blob_read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 1000 to 1099 of every file, over a chunk's edge."""
    all_blobs = blobs(spark, sf_dir)
    parts = chunks.split(all_blobs, CHUNK, 1000 // CHUNK, 1099 // CHUNK)  # only these chunks are cut
    found = chunks.read_range(parts, chunks.files(all_blobs, CHUNK), 1000, 100)
    return found.select("file_id", F.hex("data").alias("data_hex"))


def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.duplicates(blobs(spark, sf_dir))


def blob_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split(blobs(spark, sf_dir), CHUNK).select("file_id", "index", "crc32")


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live entries written to wire format and read back."""
    entry = wire.encode_entry(F.encode("key", "utf-8"), F.encode("value", "utf-8"))
    back = live(spark, sf_dir).select(wire.decode_entry(entry).alias("e"), F.octet_length(entry).alias("size"))
    return back.select(F.decode("e.key", "utf-8").alias("key"), F.decode("e.value", "utf-8").alias("value"), F.col("size").cast("long").alias("size"))


def compress_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through compressed blocks and back."""
    rows = blobs(spark, sf_dir).select("at", "data", wire.compress(F.col("data")).alias("block"))
    same = F.sha2(wire.decompress(F.col("block")), 256)
    return rows.select(F.col("at").alias("doc_id"), F.octet_length("data").cast("long").alias("n_bytes"), same.alias("sha"), wire.decompressed_size(F.col("block")).alias("said"))


def bloom_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of probes that have no entry, how many a Bloom filter lets through; none that has one may be missing.

    The filter is sized by the keys, which are a million at most but for odd ids, as they have six places. A null key
    is one key here, as in the SQL.
    """
    box = live(spark, sf_dir).select(F.coalesce("key", F.lit("")).alias("key"))
    probe = box.unionByName(spark.range(10_000).select(F.concat(F.lit("miss:"), F.col("id").cast("string")).alias("key")))
    passed = stats.bloom_semi(probe, box)
    hit = F.startswith("key", F.lit("miss:"))
    return passed.agg(F.count_if(~hit).alias("found"), (F.count_if(hit) < 500).alias("few_false"))


def _fresh_store(spark: SparkSession, config: Config | None = None) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", config)


def _filled(spark: SparkSession, sf_dir: str, config: Config | None = None, runs: int = 4) -> tuple[Store, Box]:
    """A box on disk into which the whole event log was written in some runs, of which the oldest are merged in between."""
    store, log = _fresh_store(spark, config), event_log(spark, sf_dir)
    box = store.box("events")
    lo, hi = log.agg(F.min("seq"), F.max("seq")).first()
    cuts = [lo + (hi + 1 - lo) * i // runs for i in range(runs + 1)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        box.write(log.where((F.col("seq") >= a) & (F.col("seq") < b)).withColumn("seq", F.col("seq") - a))
        if i == 2:
            box.compact(2, 2)
    return store, box


def _strings(entries: DataFrame) -> DataFrame:
    return entries.select(F.decode("key", "utf-8").alias("key"), F.decode("value", "utf-8").alias("value"))


def store_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live entries of a box after runs and a compaction, opened again."""
    store, _ = _filled(spark, sf_dir)
    store.close()
    return _strings(Store(spark, store.path).box("events").live())


def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live entries of a box whose runs were all merged."""
    _, box = _filled(spark, sf_dir)
    box.compact(1, 99)
    return _strings(box.query().entries())


def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, box = _filled(spark, sf_dir)
    return box.scan_strings(prefix="u:0000", start_key=RANGE[0], end_key=RANGE[1], reverse=True, offset=2, limit=7)


def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live entries after a buffered batch of deletes and a flush."""
    store, box = _filled(spark, sf_dir, Config(sync_writes=False))
    box.batch_delete(KEYS)
    store.close()
    return _strings(Store(spark, store.path).box("events").live())


def store_get_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-get that sees buffered writes over committed ones."""
    _, box = _filled(spark, sf_dir, Config(sync_writes=False))
    box.put(KEYS[0], "buffered")
    return _strings(box.get_all(KEYS))


def store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live entries after a JSON update of one key and a put of a new one."""
    _, box = _filled(spark, sf_dir)
    box.update_json(KEYS[1], lambda old: {"k": 1 + (old or {"k": 0})["k"]})
    box.put_json("u:999999", {"k": 0})
    return box.query().json("k int").select(F.decode("key", "utf-8").alias("key"), F.col("value.k").alias("k"))


def store_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a box that was cleared and then given the customers."""
    _, box = _filled(spark, sf_dir)
    box.clear()
    box.write(customer_box(spark, sf_dir))
    return _strings(box.live())


def store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed of a box: every mutation once, compacted or not, then a clear."""
    _, box = _filled(spark, sf_dir)
    box.compact(1, 99)
    box.clear()
    return box.events().select("collection", F.decode("key", "utf-8").alias("key"), "change_type")


def store_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed as a stream of all boxes, delivered to a table, for keys of a prefix."""
    store, box = _filled(spark, sf_dir)
    box.compact(1, 99)
    feed = watch.matching(store.watch(max_files=2), "events", "u:0000").select("collection", F.decode("key", "utf-8").alias("key"), "change_type")
    out = f"{store.path}/delivered"
    feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{store.path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(feed.schema).parquet(out)


def store_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a blob store, in two deliveries that share contents, and put together again."""
    files = BlobStore(spark, f"{shared_dir(spark)}/blobs-{uuid.uuid4().hex}", CHUNK)
    rows = blobs(spark, sf_dir)
    files.put_files(rows.where(F.col("at") % 2 == 0))
    files.put_files(rows)
    whole = chunks.assemble(files.chunks(), files.list_files())
    return whole.select("file_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha"))


QUERIES = (
    kv_live, kv_get, kv_exists, kv_get_all, kv_get_or_default, kv_scan, kv_scan_prefix, kv_scan_range, kv_scan_prefix_range, kv_page_reverse, kv_page_prefix_range, kv_keys, kv_search,
    kv_json_field, kv_json_where, kv_json_variant, kv_update_json, kv_count_approx, kv_count_exact, kv_gen_stats, kv_box_stats, kv_bytes, kv_compact, kv_merge, kv_as_of, kv_update_counter,
    kv_update_fold, kv_batch_lww, kv_batch_delete, kv_remove, kv_wal_replay, kv_sparse_index, kv_watch_collection, kv_watch_global, kv_watch_prefix_bounded, kv_watch_fanout, kv_poll,
    kv_bloom_semi, kv_key_join, kv_conversation_scan, kv_lineitem_scan, kv_label_get_all, blob_files, blob_chunks, blob_assemble, blob_read_range, blob_dedup, blob_crc, codec_roundtrip,
    compress_roundtrip, bloom_fp, store_live, store_compact, store_scan, store_delete, store_get_all, store_update, store_clear, store_events, store_stream, store_blobs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


BASE = """
WITH log AS (
  SELECT 'u:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
         props AS value, event_id AS seq, event_id // 1000 AS gen FROM events),
live AS (
  SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op = 'put'),
wanted(key) AS (VALUES ('u:000012'), ('u:000045'), ('u:000077'), ('u:999999')),
customers AS (
  SELECT 'c:' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS key, 'put' AS op,
         '{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS value, c_custkey AS seq FROM customer),
feed AS (
  SELECT 'events' AS collection, key, CASE op WHEN 'put' THEN 0 WHEN 'delete' THEN 1 ELSE 2 END AS change_type, seq FROM log),
both_feeds AS (
  SELECT * FROM feed UNION ALL SELECT 'customers', key, 0, seq FROM customers),
blobs AS (
  SELECT encode(coalesce(text, '')) AS data, sha256(coalesce(text, '')) AS file_id, 'doc-' || doc_id AS filename, doc_id FROM documents)
"""

SELECTS = {
    "kv_live": "SELECT key, value, seq FROM live",
    "kv_get": "SELECT key, value FROM live WHERE key = 'u:000012'",
    "kv_exists": "SELECT key, live.key IS NOT NULL AS found FROM wanted LEFT JOIN live USING (key)",
    "kv_get_all": "SELECT key, value FROM wanted LEFT JOIN live USING (key)",
    "kv_get_or_default": "SELECT key, CASE WHEN live.key IS NULL THEN '{}' ELSE value END AS value FROM wanted LEFT JOIN live USING (key)",
    "kv_scan": "SELECT key, value FROM live ORDER BY key",
    "kv_scan_prefix": "SELECT key, value FROM live WHERE starts_with(key, 'u:00001')",
    "kv_scan_range": "SELECT key, value FROM live WHERE key >= 'u:000020' AND key < 'u:000060'",
    "kv_scan_prefix_range": "SELECT key, value FROM live WHERE starts_with(key, 'u:00003') AND key >= 'u:000020' AND key < 'u:000060'",
    "kv_page_reverse": "SELECT CAST(row_number() OVER (ORDER BY key DESC) AS INT) AS pos, key, value FROM (SELECT * FROM live ORDER BY key DESC LIMIT 5 OFFSET 3)",
    "kv_page_prefix_range": "SELECT CAST(row_number() OVER (ORDER BY key DESC) AS INT) AS pos, key, CAST(json_extract_string(value, '$.k') AS INT) AS k FROM (SELECT * FROM live WHERE starts_with(key, 'u:0000') AND key >= 'u:000020' AND key < 'u:000060' ORDER BY key DESC LIMIT 7 OFFSET 2)",
    "kv_keys": "SELECT key FROM live",
    "kv_search": "SELECT key, value FROM live WHERE contains(lower(key), 'u:00004') OR contains(lower(value), 'u:00004')",
    "kv_json_field": "SELECT key, CAST(json_extract_string(value, '$.k') AS INT) AS k FROM live",
    "kv_json_where": "SELECT key, value FROM live WHERE CAST(json_extract_string(value, '$.k') AS INT) > 50",
    "kv_json_variant": "SELECT key, CAST(json_extract_string(value, '$.k') AS INT) AS k FROM live",
    "kv_update_json": "SELECT key, '{\"k\":' || (CAST(json_extract_string(value, '$.k') AS INT) + 1) || '}' AS value FROM live",
    "kv_count_approx": "SELECT count(*) AS approximate_count FROM (SELECT DISTINCT gen, key FROM log)",
    "kv_count_exact": "SELECT count(*) AS exact_count FROM live",
    "kv_gen_stats": "SELECT gen, count(*) AS entries, count(*) FILTER (WHERE op = 'delete') AS tombstones FROM (SELECT *, row_number() OVER (PARTITION BY gen, key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 GROUP BY gen",
    "kv_box_stats": """SELECT 'events' AS collection, (SELECT count(DISTINCT key) FROM log WHERE gen = (SELECT max(gen) FROM log)) AS newest_gen_entries, (SELECT count(DISTINCT gen) FROM log) AS segment_count,
       (SELECT count(*) FROM (SELECT DISTINCT gen, key FROM log)) AS approximate_count, (SELECT count(*) FROM live) AS exact_count
UNION ALL SELECT 'customers', count(DISTINCT key), 1, count(DISTINCT key), count(DISTINCT key) FROM customers""",
    "kv_bytes": "SELECT CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1",
    "kv_compact": "SELECT key, value, seq FROM live",
    "kv_merge": "SELECT key, value, seq FROM live",
    "kv_as_of": "SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE seq <= (SELECT max(seq) - max(seq) // 10 FROM log)) WHERE rn = 1 AND op = 'put'",
    "kv_update_counter": "SELECT key, count(*) AS puts FROM log WHERE op = 'put' GROUP BY key",
    "kv_update_fold": "SELECT key, list_reduce(list(CAST(coalesce(json_extract_string(value, '$.k'), '0') AS INT) ORDER BY seq), lambda s, k: greatest(s, k) + 1, 0) AS value FROM log WHERE op = 'put' GROUP BY key",
    "kv_batch_lww": "SELECT gen, key, op, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY gen, key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1",
    "kv_batch_delete": "SELECT key, value, seq FROM live WHERE key NOT IN (SELECT key FROM wanted)",
    "kv_remove": "SELECT key, value, seq FROM live WHERE key NOT IN (SELECT key FROM wanted)",
    "kv_wal_replay": "SELECT key, op, value, seq FROM log WHERE seq < (SELECT max(seq) - max(seq) // 10 FROM log)",
    "kv_sparse_index": """SELECT key, max(gen) AS gen, arg_max(place, gen) AS place FROM (
       SELECT gen, key, CAST(row_number() OVER (PARTITION BY gen ORDER BY key) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT gen, key FROM log)) WHERE place % 64 = 0 GROUP BY key""",
    "kv_watch_collection": "SELECT collection, key, change_type, seq FROM feed",
    "kv_watch_global": "SELECT collection, key, change_type, seq FROM both_feeds",
    "kv_watch_prefix_bounded": "SELECT collection, key, change_type, seq, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (ORDER BY seq) AS pos FROM feed WHERE starts_with(key, 'u:0000')) WHERE pos <= 1024",
    "kv_watch_fanout": """SELECT sub_id, collection, key, change_type, seq FROM both_feeds JOIN
       (VALUES (1, 'events', 'u:00001'), (2, 'customers', NULL), (3, NULL, 'u:00002'), (4, 'events', 'x')) AS s(sub_id, c, p)
       ON (c IS NULL OR c = collection) AND starts_with(key, coalesce(p, ''))""",
    "kv_poll": "SELECT collection, key, change_type, seq, CAST(row_number() OVER (ORDER BY seq) AS INT) AS pos FROM (SELECT * FROM feed WHERE seq > 250 ORDER BY seq LIMIT 100)",
    "kv_bloom_semi": "SELECT 'u:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key FROM customer WHERE 'u:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') IN (SELECT key FROM live)",
    "kv_key_join": "SELECT o_orderkey, c_key, value FROM (SELECT o_orderkey, 'c:' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS c_key FROM orders) LEFT JOIN customers ON c_key = key",
    "kv_conversation_scan": """SELECT CAST(row_number() OVER (ORDER BY key DESC) AS INT) AS pos, key, value FROM (
       SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') || '/' || lpad(CAST(turn AS VARCHAR), 4, '0') AS key, text AS value FROM conversations WHERE conv_id = 3 ORDER BY key DESC LIMIT 3)""",
    "kv_lineitem_scan": "SELECT lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '/' || l_linenumber AS key, l_returnflag AS value FROM lineitem WHERE l_orderkey >= 10 AND l_orderkey < 50",
    "kv_label_get_all": "SELECT d.doc_id AS key, quality AS value FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "blob_files": "SELECT file_id, arg_min(filename, doc_id) AS filename, CAST(any_value(octet_length(data)) AS BIGINT) AS total_size, CAST(greatest(1, ceil(any_value(octet_length(data)) / 1024.0)) AS INT) AS chunk_count FROM blobs GROUP BY file_id",
    "blob_chunks": """SELECT file_id, CAST(i AS INT) AS index, substr(hex(data), CAST(i * 2048 + 1 AS BIGINT), 2048) AS data_hex FROM (
       SELECT file_id, data, unnest(range(CAST(greatest(1, ceil(octet_length(data) / 1024.0)) AS BIGINT))) AS i FROM (SELECT file_id, any_value(data) AS data FROM blobs GROUP BY file_id))""",
    "blob_assemble": "SELECT file_id, CAST(any_value(octet_length(data)) AS BIGINT) AS n_bytes, file_id AS sha FROM blobs GROUP BY file_id",
    "blob_read_range": "SELECT file_id, any_value(substr(hex(data), 2001, 200)) AS data_hex FROM blobs GROUP BY file_id",
    "blob_dedup": "SELECT file_id, count(*) AS copies FROM blobs GROUP BY file_id HAVING count(*) > 1",
    "codec_roundtrip": "SELECT key, value, CAST(strlen(key) + strlen(value) + 10 AS BIGINT) AS size FROM live",
    "compress_roundtrip": "SELECT doc_id, CAST(octet_length(data) AS BIGINT) AS n_bytes, file_id AS sha, CAST(octet_length(data) AS BIGINT) AS said FROM blobs",
    "store_live": "SELECT key, value FROM live",
    "store_compact": "SELECT key, value FROM live",
    "store_scan": "SELECT key, value FROM live WHERE starts_with(key, 'u:0000') AND key >= 'u:000020' AND key < 'u:000060' ORDER BY key DESC LIMIT 7 OFFSET 2",
    "store_delete": "SELECT key, value FROM live WHERE key NOT IN (SELECT key FROM wanted)",
    "store_get_all": "SELECT key, CASE WHEN key = 'u:000012' THEN 'buffered' ELSE value END AS value FROM wanted LEFT JOIN live USING (key)",
    "store_update": """SELECT key, CAST(json_extract_string(value, '$.k') AS INT) AS k FROM live WHERE key NOT IN ('u:000045', 'u:999999')
UNION ALL SELECT 'u:000045', 1 + coalesce((SELECT CAST(json_extract_string(value, '$.k') AS INT) FROM live WHERE key = 'u:000045'), 0) UNION ALL SELECT 'u:999999', 0""",
    "store_clear": "SELECT key, value FROM customers",
    "store_events": "SELECT collection, key, change_type FROM feed UNION ALL SELECT 'events', '', 2",
    "store_stream": "SELECT collection, key, change_type FROM feed WHERE starts_with(key, 'u:0000')",
    "store_blobs": "SELECT file_id, CAST(any_value(octet_length(data)) AS BIGINT) AS n_bytes, file_id AS sha FROM blobs GROUP BY file_id",
    "bloom_fp": "SELECT count(*) AS found, true AS few_false FROM live",
}


def oracle_sql() -> dict[str, str]:
    return {name: BASE + select for name, select in SELECTS.items()}


__all__ = ["oracle_sql", "queries"]
