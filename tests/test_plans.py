"""Logs, snapshots and scans on small frames, with a dict as the model."""

import random

import pytest
from pyspark.sql import functions as F

from kvstrata.functions.codecs import Codec, JsonCodec, ListCodec, StringCodec, VariantCodec
from kvstrata.operators import lookup, stats
from kvstrata.plans import log as logs
from kvstrata.plans import snapshot
from kvstrata.plans.log import Batch
from kvstrata.plans.query import KVQuery, successor


def log_of(spark, operations):
    return Batch([(op, k, v) for op, k, v in operations]).to_df(spark)


def live_dict(frame):
    return {bytes(r.key): bytes(r.value) for r in frame.collect()}


def model(operations):
    out = {}
    for op, k, v in operations:
        if op == "put":
            out[k.encode()] = v.encode()
        else:
            out.pop(k.encode(), None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_snapshot_is_a_dict(spark, seed):
    r = random.Random(seed)
    ops = [(r.choice(["put", "put", "delete"]), f"k{r.randint(0, 12)}", r.choice(["", "a", "bb", "ccc"])) for _ in range(60)]
    ops = [(op, k, v if op == "put" else None) for op, k, v in ops]
    frame = log_of(spark, ops)
    assert live_dict(snapshot.live(frame)) == model(ops)
    assert live_dict(snapshot.as_of(frame, 29)) == model(ops[:30])
    runs = [frame.where(F.col("seq") % 3 == i) for i in range(3)]
    assert live_dict(snapshot.merge(*runs)) == model(ops)
    with_gen = frame.withColumn("gen", F.floor(F.col("seq") / 10))
    for below in (0, 2, 6):
        assert live_dict(snapshot.live(snapshot.compacted(with_gen, below))) == model(ops)
    once = snapshot.compacted(with_gen, 4)
    assert sorted(map(str, snapshot.compacted(once, 4).collect())) == sorted(map(str, once.collect()))


def test_merge_newest_wins(spark):
    old = log_of(spark, [("put", "key1", "val1"), ("put", "key2", "val2"), ("put", "key3", "val3")])
    new = log_of(spark, [("put", "key1", "new_val1"), ("delete", "key3", None)]).withColumn("seq", F.col("seq") + 10)
    assert live_dict(snapshot.merge(new, old)) == {b"key1": b"new_val1", b"key2": b"val2"}


def test_empty_value_is_a_value(spark):
    assert live_dict(snapshot.live(log_of(spark, [("put", "a", "")]))) == {b"a": b""}


@pytest.fixture(scope="module")
def box(spark):
    keys = [b"", b"a", b"ab", b"b", b"b\x00", b"b\xff", b"b\xff\xff", b"c", b"user:1", b"user:2", b"\xff", b"\xff\xff"]
    return spark.createDataFrame([(bytearray(k), bytearray(k.hex().encode())) for k in keys], "key binary, value binary"), sorted(keys)


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("prefix", [None, b"", b"b", b"b\xff", b"\xff", b"user:", b"none"])
@pytest.mark.parametrize("bounds", [(None, None), (b"ab", b"c"), (b"c", b"a"), (b"", None), (None, b"b\xff")])
def test_scan_is_a_sorted_slice(box, prefix, bounds, reverse):
    frame, keys = box
    found = KVQuery(frame, prefix, *bounds, 3, 1, reverse).keys().collect()
    start, end = bounds
    expected = [k for k in sorted(keys, reverse=reverse) if (not prefix or k.startswith(prefix)) and (start is None or k >= start) and (end is None or k < end)]
    assert [bytes(r.key) for r in found] == expected[1:4]


def test_builder(box):
    frame, keys = box
    query = KVQuery(frame)
    assert query.explain_kind() == "FullScan"
    assert query.prefix("u").explain_kind() == "PrefixScan"
    assert query.prefix("u").start_key("a").explain_kind() == "RangeScan"
    assert query.limit(0).count() == 0
    assert query.offset(99).count() == 0
    assert query.count() == len(keys)
    assert [r.pos for r in query.reverse().limit(2).pages().collect()] == [1, 2]
    for bad in (lambda: query.limit(-1), lambda: query.offset(-1), query.pages):
        with pytest.raises(ValueError):
            bad()


def test_strict_utf8(spark):
    frame = spark.createDataFrame([(bytearray(b"k"), bytearray(b"\xff\xfe"))], "key binary, value binary")
    with pytest.raises(Exception, match="(?i)malformed|invalid"):
        KVQuery(frame).strings().collect()


def test_successor():
    assert successor(b"ab") == b"ac"
    assert successor(b"a\xff") == b"b"
    assert successor(b"\xff") is None


def test_replay_keeps_the_prefix(spark):
    frame = log_of(spark, [("put", f"k{i}", "v") for i in range(10)])
    assert logs.replay(frame, F.col("seq").isin(7, 4)).count() == 4
    assert logs.replay(frame, F.lit(False)).count() == 10


def test_batches(spark):
    batch = Batch().put("a", "1").put_all({"b": "2", "a": "3"}).delete("b")
    assert len(batch) == 4 and not batch.is_empty and Batch().is_empty
    assert live_dict(snapshot.live(batch.to_df(spark))) == {b"a": b"3"}
    assert Batch().to_df(spark).count() == 0


def test_codecs(spark):
    rows = spark.createDataFrame([(1, "x")], "id int, name string")
    for codec, value in ((JsonCodec("id int, name string"), F.struct("id", "name")), (ListCodec("int"), F.array("id")), (StringCodec(), F.col("name"))):
        back = rows.select(codec.decode(codec.encode(value)).alias("back"), value.alias("value")).first()
        assert back.back == back.value
    got = rows.select(F.variant_get(VariantCodec().decode(VariantCodec().encode(F.struct("id"))), "$.id", "int").alias("id")).first()
    assert got.id == 1
    own = Codec(lambda c: F.encode(F.concat_ws("|", c["id"], c["name"]), "utf-8"), lambda c: F.split(F.decode(c, "utf-8"), r"\|"))
    assert rows.select(own.decode(own.encode(F.struct("id", "name"))).alias("v")).first().v == ["1", "x"]
    with pytest.raises(Exception, match="MALFORMED"):
        rows.select(JsonCodec("id int").decode(F.encode(F.lit("[1"), "utf-8"))).collect()


def test_lookups(spark):
    box = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "key string")
    assert {tuple(r) for r in lookup.get_all(box, keys).collect()} == {("a", "1"), ("b", None), ("z", None)}
    assert {tuple(r) for r in lookup.exists(box, keys).collect()} == {("a", True), ("b", True), ("z", False)}
    assert {tuple(r) for r in lookup.get_or_default(box, keys, F.lit("d")).collect()} == {("a", "1"), ("b", None), ("z", "d")}
    assert lookup.remove(box, keys).count() == 0
    assert lookup.search(box, " A ").count() == 1


def test_sparse_index(spark):
    frame = spark.createDataFrame([("key1", 0), ("key2", 0), ("key1", 1)], "key string, gen long")
    assert {tuple(r) for r in stats.sparse_index(frame, 1).collect()} == {("key1", 1, 0), ("key2", 0, 1)}
    with pytest.raises(ValueError):
        stats.sparse_index(frame, 0)
