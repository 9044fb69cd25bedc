"""Stores and boxes on disk: writes, recovery, compaction, conflicts, and the change feed."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kvstrata.functions.codecs import JsonCodec
from kvstrata.plans.log import Batch
from kvstrata.schemas import CommitConflict
from kvstrata.sources.config import Config
from kvstrata.sources.manifest import Version
from kvstrata.sources.store import Store
from kvstrata.streaming import watch

BUFFERED = Config(sync_writes=False)


def entries(box):
    return {bytes(r.key).decode(): bytes(r.value).decode() for r in box.live().collect()}


@pytest.fixture
def store(spark, tmp_path):
    with Store(spark, str(tmp_path / "store"), BUFFERED) as s:
        yield s


def test_basics(store):
    box = store.box("b")
    box.put("key1", "value1")
    box.put("key1", "value2")
    box.put("gone", "x")
    box.delete("gone")
    box.put_bytes(b"\xff", b"\x00")
    assert box.get("key1") == "value2" and box.get("gone") is None and box.get("none") is None
    assert box.exists("key1") and not box.exists("gone") and box.get_bytes(b"\xff") == b"\x00"
    assert box.get_or_default("none", "d") == "d"
    box.flush()
    assert box.get("key1") == "value2" and box.get("gone") is None
    assert [bytes(r.key) for r in box.keys().collect()] == [b"key1", b"\xff"]
    assert box.stats() == {"name": "b", "memtable_entries": 3, "segment_count": 1, "approximate_count": 3, "exact_count": 2}
    store.box("other").put("p1", "v")
    store.box("other").flush()
    assert box.get("p1") is None and store.boxes() == ["b", "other"]


def test_each_call_is_a_generation_when_synchronous(spark, tmp_path):
    box = Store(spark, str(tmp_path), Config()).box("b")
    box.batch_put({"a": "1", "b": ""})
    box.batch_delete(["a", "never"])
    box.batch(Batch())
    assert box.segment_count() == 2 and entries(box) == {"b": ""}
    assert entries(Store(spark, str(tmp_path)).box("b")) == {"b": ""}  # reopened


def test_json_and_objects(spark, store):
    box = store.box("j")
    box.put_json("u", {"n": 1, "é": [1, None]})
    assert box.get_json("u") == {"n": 1, "é": [1, None]} and box.get_json_or_default("x", {}) == {}
    assert box.update_json("u", lambda o: o | {"n": o["n"] + 1})["n"] == 2
    assert box.update("c", lambda old: b"1" if old is None else old + b"1") == b"1"
    codec = JsonCodec("id int, name string")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    box.put_objects(rows, F.concat(F.lit("o"), F.col("id")), F.struct("id", "name"), codec, F.col("id"))
    assert box.get_object("o2", codec).name == "b" and box.get_object_or_default("o9", codec, 0) == 0
    assert [r.value.id for r in box.query().prefix("o").objects(codec).collect()] == [1, 2]
    assert json.loads(box.get("u"))["n"] == 2
    assert {bytes(r.key): r.value is None for r in box.get_all(["u", "u", "zz"]).collect()} == {b"u": False, b"zz": True}


def test_scans(store):
    box = store.box("s")
    box.batch_put({f"key_{i:03d}": str(i) for i in range(20)})
    keys = lambda frame: [bytes(r.key).decode() for r in frame.collect()]
    assert keys(box.scan(offset=5, limit=3)) == ["key_005", "key_006", "key_007"]
    assert keys(box.scan(reverse=True, limit=2)) == ["key_019", "key_018"]
    assert keys(box.range_scan("key_003", "key_007")) == [f"key_{i:03d}" for i in range(3, 7)]
    assert keys(box.prefix_scan("key_01", 2)) == ["key_010", "key_011"]
    assert [r.value for r in box.scan_strings(prefix="key_00", limit=2).collect()] == ["0", "1"]
    box.put_bytes("bad", b"\xff")
    with pytest.raises(Exception, match="(?i)malformed|invalid"):
        box.scan_strings().collect()


@pytest.mark.parametrize("seed", range(2))
def test_compaction_and_flush_never_change_what_is_live(store, seed):
    r, box, model = random.Random(seed), store.box(f"c{seed}"), {}
    for step in range(6):
        operations = []
        for _ in range(r.randint(1, 8)):
            k, v = f"k{r.randint(0, 6)}", r.choice(["", "x", "y"])
            if r.random() < 0.4:
                operations.append(("delete", k, None))
                model.pop(k, None)
            else:
                operations.append(("put", k, v))
                model[k] = v
        box.batch(Batch(operations))
        if r.random() < 0.8 or step == 5:
            box.flush()
            assert entries(box) == model
        if step % 3 == 2:
            box.compact(2, r.choice([2, 8]))  # fewer than there are: newer generations still win
            assert entries(box) == model
    box.flush()
    box.compact(1, 99)
    assert box.segment_count() <= 1 and entries(box) == model
    assert box.compact(2) is None  # nothing left to merge
    assert box.vacuum() and entries(box) == model and not box.vacuum()
    assert box.count() == box.count_exact() == len(model)
    box.clear()
    assert entries(box) == {} and box.segment_count() == 0


def test_a_lone_compacted_generation_skips_the_window(store):
    box = store.box("w")
    box.batch_put({"a": "1"})
    box.flush()
    box.put("a", "2")
    box.flush()
    assert "Window" in box.live()._jdf.queryExecution().toString()
    box.compact(2)
    assert "Window" not in box.live()._jdf.queryExecution().toString() and entries(box) == {"a": "2"}


def test_what_no_version_lists_does_not_exist(store):
    box = store.box("r")
    box.batch_put({"a": "1"})
    box.flush()
    box._generation(Batch().put("b", "2").to_df(store.spark, 50), box._manifest.latest(), False)  # a crash before the commit
    assert entries(box) == {"a": "1"}
    assert not box.vacuum()  # it may be that of a writer at work
    assert len(box.vacuum(age=0)) == 1 and entries(box) == {"a": "1"}


def test_two_writers_conflict(store):
    box = store.box("x")
    box._commit(Version(1))
    with pytest.raises(CommitConflict):
        box._commit(Version(1))


def test_names_and_settings(store):
    for bad in ("", ".", "..", "a/b", "_manifest", "é"):
        with pytest.raises(ValueError):
            store.box(bad)
    for field in ("memtable_size", "block_size", "worker_threads"):
        with pytest.raises(ValueError):
            Config(**{field: 0})
    assert Config.low_memory().compaction_threshold == 2 and not Config.ultra().sync_writes and Config.high_throughput().memtable_size == 64 << 20


def test_prefix_and_range_reach_the_scan(store):
    box = store.box("p")
    box.batch_put({"user:1": "a", "post:1": "b"})
    box.flush()
    plan = box.query().prefix("user:").df()._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan


def test_stream_equals_batch(spark, store, tmp_path):
    box = store.box("feed")
    for i in range(4):
        box.batch(Batch().put(f"user:{i}", "v").put(f"admin:{i}", "v").delete("user:0"))
        box.flush()
    assert box.watch_prefix("user:").isStreaming
    got = []
    query = watch.subscribe(box.watch(max_files=1), lambda frame, n: got.extend(frame.collect()), str(tmp_path / "ckpt"), None)
    query.awaitTermination()
    assert {tuple(map(str, r)) for r in got} == {tuple(map(str, r)) for r in box.events().collect()} and len(got) == 12
    some = []
    watch.subscribe(box.watch_prefix("user:"), lambda frame, n: some.extend(frame.collect()), str(tmp_path / "ckpt2"), None).awaitTermination()
    assert len(some) == 8 and watch.subscriber_count(spark) == 0
    assert {r.change_type for r in some} == {0, 1}


def test_events(spark):
    log = spark.createDataFrame([("a", "put", 0), ("b", "delete", 1), ("", "clear", 2), ("a", "put", 3)], "key string, op string, seq long")
    feed = watch.events(log, "box")
    assert [r.change_type for r in feed.orderBy("seq").collect()] == [0, 1, 2, 0]
    assert watch.bounded(feed, capacity=2).count() == 2
    assert [r.seq for r in watch.poll(feed, 0, 0).collect()] == [1]
    assert watch.matching(feed, "other").count() == 0 and watch.matching(feed, "box", "a").count() == 2


@pytest.mark.parametrize("options", [{}, {"most_broadcast": 0}])
def test_fan_out_gathers_no_events(spark, options):
    subs = [(1, "a", "k:1"), (2, None, None), (3, "b", None), (4, None, "k:29"), (5, "b", "x"), (6, "c", "")]
    subscriptions = spark.createDataFrame(subs, "sub_id int, sub_collection string, sub_prefix string")
    feed = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("collection"), F.concat(F.lit("k:"), "id").alias("key"), F.lit(0).alias("change_type"), F.col("id").alias("seq"))
    wanted = {(s, r.seq) for r in feed.collect() for s, c, p in subs if c in (None, r.collection) and r.key.startswith(p or "")}
    fanned = watch.fan_out(feed, subscriptions, **options)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would join small partitions
    try:
        got = fanned.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {(r.sub_id, r.seq) for r in got} == wanted and len(got) == len(wanted)
    assert max(Counter(r.task for r in got if r.sub_id == 2).values()) < 2000
    assert "BuildLeft" not in fanned._jdf.queryExecution().toString()  # no events are held


def test_ingest_a_stream_once(spark, store, tmp_path):
    log = spark.createDataFrame([("a", "put", "1", 0), ("b", "put", "2", 1), ("a", "delete", None, 2), ("c", "put", "3", 3)], "key string, op string, value string, seq long")
    for i in range(3):
        log.where(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    box = store.box("in")
    read = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 99).parquet(str(tmp_path / "in"))
    box.ingest(read(), str(tmp_path / "c1")).awaitTermination()
    assert entries(box) == {"b": "2", "c": "3"} and box.segment_count() == 1
    box.ingest(read(), str(tmp_path / "c2")).awaitTermination()  # batch 0 again, as after a lost checkpoint
    assert box.segment_count() == 1
    box.put("a", "later")
    box.flush()
    assert entries(box)["a"] == "later"


def other(spark, store, name):
    """The same box as another writer sees it."""
    return Store(spark, store.path, BUFFERED).box(name)


def beaten(box, rival, times, monkeypatch):
    """Let the rival commit just before each of the box's next commits."""
    left, commit = [times], box._manifest.commit

    def slow(version, token):
        if left[0]:
            left[0] -= 1
            rival.put(f"rival{left[0]}", "r")
            rival.flush()
        return commit(version, token)

    monkeypatch.setattr(box._manifest, "commit", slow)


def runs(box):
    return [n for n in box._files.names(box.path) if n.startswith("gen-")]


def seen(frame):
    return sorted((bytes(r.key).decode(), r.change_type) for r in frame.collect())


def streamed(box_or_store, tmp_path, name):
    got = []
    watch.subscribe(box_or_store.watch(), lambda frame, n: got.extend(frame.collect()), str(tmp_path / name), None).awaitTermination()
    return sorted((bytes(r.key).decode(), r.change_type) for r in got)


def test_no_write_is_lost_to_another_writer(spark, store, monkeypatch):
    box, rival = store.box("race"), other(spark, store, "race")
    box.put("a", "1")
    beaten(box, rival, 2, monkeypatch)
    box.flush()
    assert entries(box) == {"a": "1", "rival0": "r", "rival1": "r"} and len(runs(box)) == 3  # beaten runs are deleted
    beaten(box, rival, 1, monkeypatch)
    assert box.compact(2)["segments_merged"] >= 3 and entries(box)["a"] == "1"
    beaten(box, rival, 1, monkeypatch)
    box.update("a", lambda old: old + b"2")
    assert box.get("a") == "12"
    beaten(box, rival, 99, monkeypatch)
    box.put("kept", "in the buffer")
    with pytest.raises(CommitConflict):
        box.flush()
    monkeypatch.undo()
    assert box.get("kept") == "in the buffer" and box.memtable_count() == 1
    box.flush()
    assert entries(other(spark, store, "race"))["kept"] == "in the buffer"
    assert [k for k, _ in seen(box.events())].count("a") == 2 and seen(box.events()) == seen(other(spark, store, "race").events())


def test_feed_has_each_committed_write_once(spark, store, tmp_path, monkeypatch):
    box = store.box("feed")
    for i in range(4):
        box.put(f"k{i}", "v")
        box.flush()
    expected = [(f"k{i}", 0) for i in range(4)]
    box.compact(2)
    assert seen(box.events()) == expected and streamed(box, tmp_path, "a") == expected  # merged runs are no events
    box._generation(Batch().put("never", "x").to_df(spark, 50), box._manifest.latest(), False)  # never committed
    assert streamed(box, tmp_path, "b") == expected
    monkeypatch.setattr(box, "_publish", lambda version=None: None)  # a crash between commit and feed
    box.delete("k0")
    box.flush()
    monkeypatch.undo()
    again = other(spark, store, "feed")
    again.compact(1)
    assert seen(again.events()) == streamed(again, tmp_path, "c") == sorted([*expected, ("k0", 1)])
    again.clear()
    assert seen(again.events()) == streamed(store, tmp_path, "d") == sorted([*expected, ("k0", 1), ("", 2)])
    assert [r.change_type for r in again.events().orderBy("seq").collect()][-1] == 2


def test_vacuum_beside_a_writer(spark, store):
    box = store.box("v")
    box.put("a", "1")
    box.flush()
    version = box._manifest.latest()
    at_work = box._generation(Batch().put("b", "2").to_df(spark, version.next_seq), version, False)
    assert not other(spark, store, "v").vacuum()
    from dataclasses import replace

    box._commit(replace(version, number=version.number + 1, next_seq=9, next_gen=version.next_gen + 1, generations=(*version.generations, at_work)), at_work)
    assert entries(box) == {"a": "1", "b": "2"}


def test_settings_work(spark, tmp_path):
    off = Store(spark, str(tmp_path / "off"), Config(compaction_enabled=False)).box("b")
    for i in range(3):
        off.put(f"k{i}", "v")
    assert off.compact(1) is None and off.segment_count() == 3
    auto = Store(spark, str(tmp_path / "auto"), Config(auto_compaction=True, compaction_threshold=3, compression=False)).box("b")
    for i in range(5):
        auto.put(f"k{i % 2}", str(i))
    assert auto.segment_count() < 3 and entries(auto) == {"k0": "4", "k1": "3"}
    assert not any("zstd" in p.name for p in (tmp_path / "auto" / "boxes" / "b").glob("gen-*/part-*"))
    big = Store(spark, str(tmp_path / "zip"), Config(worker_threads=3)).box("b")
    big.batch_put({f"k{i}": "v" * 50 for i in range(300)})
    run = [p for p in (tmp_path / "zip" / "boxes" / "b").glob("gen-*/part-*")]
    assert len(run) == 3 and all("zstd" in p.name for p in run)


def test_wrong_page_checksum_raises(spark, tmp_path):
    box = Store(spark, str(tmp_path), Config(compression=False)).box("b")
    box.put("a", "needle-value")
    path = next(p for p in (tmp_path / "boxes" / "b").glob("gen-*/part-*") if b"needle-value" in p.read_bytes())
    data = path.read_bytes()
    path.write_bytes(data.replace(b"needle-value", b"needle-valuE"))
    for crc in path.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        box.live().collect()
    assert [bytes(r.value) for r in Store(spark, str(tmp_path), Config(verify_checksums=False)).box("b").live().collect()] == [b"needle-valuE"]


def test_poll_by_subscription(spark, store):
    one, two = store.box("one"), store.box("two")
    one.put("old", "v")
    one.flush()
    every, users = store.subscribe(), store.subscribe("one", "user:")
    assert store.subscriber_count() == 2 and store.poll(every, 10) == []
    for box in (one, two):
        box.batch_put({"user:1": "v", "x": "v", "user:2": "v"})
        box.flush()
    late = store.subscribe("two")
    assert [bytes(r.key) for r in store.poll(users, 1)] == [b"user:1"] and [bytes(r.key) for r in store.poll(users, 10)] == [b"user:2"]
    assert len(store.poll(every, 4)) == 4 and len(store.poll(every, 4)) == 2 and store.poll(every, 4) == [] and store.poll(late, 9) == []
    assert store.unsubscribe(users) and not store.unsubscribe(users)
    with pytest.raises(ValueError):
        store.poll(users, 1)


def test_scan_by_callback_stops(store):
    box = store.box("cb")
    box.batch_put({f"k{i}": str(i) for i in range(9)})
    got = []
    assert box.query().for_each(lambda k, v: got.append(bytes(k)) or len(got) < 3) == 3 and got == [b"k0", b"k1", b"k2"]
    assert box.query().for_each(lambda k, v: None) == 9
