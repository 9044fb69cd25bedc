"""Chunked blobs, entry format, compressed blocks and Bloom filters."""

import random
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvstrata.functions import bloom
from kvstrata.functions import entries as wire
from kvstrata.operators import chunks, stats
from kvstrata.sources.blobs import BlobStore


@pytest.fixture(scope="module")
def blobs(spark):
    r = random.Random(0)
    data = [b"AB" * 2500, b"", b"hello", b"hello", bytes(range(250)) * 9, r.randbytes(4096)]
    return spark.createDataFrame([(f"f{i}", "m", bytearray(x), i) for i, x in enumerate(data)], "filename string, mime_type string, data binary, at long"), data


def test_files_and_chunks(blobs):
    frame, data = blobs
    meta, parts = chunks.files(frame, 100), chunks.split(frame, 100)  # held at 1024
    assert {(r.filename, r.total_size, r.chunk_size, r.chunk_count) for r in meta.collect()} == {("f0", 5000, 1024, 5), ("f1", 0, 1024, 1), ("f2", 5, 1024, 1), ("f4", 2250, 1024, 3), ("f5", 4096, 1024, 4)}
    assert {bytes(r.data) for r in chunks.assemble(parts, meta).collect()} == set(data)
    assert chunks.duplicates(frame).collect()[0].copies == 2
    assert chunks.new_files(frame, meta).count() == 0


@pytest.mark.parametrize("offset, length", [(0, 10), (50, 100), (1000, 100), (1024, 1024), (2249, 5), (9999, 5), (0, 0), (0, 99999)])
def test_ranges(blobs, offset, length):
    frame, data = blobs
    got = chunks.read_range(chunks.split(frame, 1024), chunks.files(frame, 1024), offset, length).collect()
    assert sorted(bytes(r.data) for r in got) == sorted(x[offset : offset + length] for x in set(data))


def test_corruption_raises(blobs):
    frame, _ = blobs
    parts, meta = chunks.split(frame, 1024), chunks.files(frame, 1024)
    broken = parts.withColumn("data", F.when(F.col("index") == 1, F.encode(F.lit("x"), "utf-8")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="checksum"):
        chunks.assemble(broken, meta).collect()
    with pytest.raises(Exception, match="missing"):
        chunks.assemble(parts.where("index <> 1"), meta).collect()
    assert chunks.read_chunk(parts, "none", 0).collect() == []
    with pytest.raises(ValueError):
        chunks.read_range(parts, meta, -1, 5)


def test_entry_format(spark):
    pairs = [(b"test_key", b"value"), (b"", b""), (b"k", b"\x00" * 70_000), (b"\xff" * 300, b"v")]
    frame = spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in pairs], "k binary, v binary").withColumn("e", wire.encode_entry(F.col("k"), F.col("v")))
    for r in frame.select("*", wire.decode_entry(F.concat("e", F.lit(b"tail"))).alias("back")).collect():
        k, v = bytes(r.k), bytes(r.v)
        body = len(k).to_bytes(2, "little") + k + len(v).to_bytes(4, "little") + v
        assert bytes(r.e) == body + zlib.crc32(body).to_bytes(4, "little")
        assert (bytes(r.back.key), bytes(r.back.value)) == (k, v)
    for bad in (F.expr("substring(e, 1, octet_length(e) - 1)"), F.expr("concat(substring(e, 1, 2), x'00', substring(e, 4))")):
        with pytest.raises(Exception, match="truncated|checksum"):
            frame.where("octet_length(k) = 8").select(wire.decode_entry(bad)).collect()
    with pytest.raises(Exception, match="too long"):
        spark.range(1).select(wire.encode_entry(F.encode(F.repeat(F.lit("x"), 65536), "utf-8"), F.lit(b""))).collect()


def test_compressed_blocks(spark):
    data = [b"AB" * 512, b"hello", random.Random(1).randbytes(4096), b"", b"\x00" * 2048, None]
    frame = spark.createDataFrame([(None if x is None else bytearray(x),) for x in data], "d binary").withColumn("b", wire.compress(F.col("d")))
    for r in frame.select("*", wire.decompress(F.col("b")).alias("back"), wire.is_compressed(F.col("b")).alias("c"), wire.decompressed_size(F.col("b")).alias("n")).collect():
        if r.d is None:
            assert r.back is None
            continue
        assert bytes(r.back) == bytes(r.d) and r.n == len(r.d)
        assert r.c == (len(r.d) in (1024, 2048)) and (not r.c or len(r.b) < len(r.d))


def test_python_holds_small_parts_of_blocks(spark):
    def seen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([batch.nbytes] * len(batch), pa.int64())

    text = F.when(F.col("id") % 10 > 0, F.encode(F.repeat(F.sha2(F.col("id").cast("string"), 256), 1600), "utf-8"))  # 100 KiB, some null
    frame = spark.range(200).coalesce(1).select(text.alias("d"))
    back = wire.decompress(wire.compress(F.col("d")))
    assert frame.where(~F.col("d").eqNullSafe(back)).count() == 0
    held = [r.held for r in frame.select(F.arrow_udf(seen, "long")(back).alias("held")).collect()]  # the three run in one worker
    assert len(held) == 200 and max(held) < 2 << 20


def test_bloom(spark):
    assert bloom.size_for(1000, 0.01) == (16384, 11) and bloom.size_for(1, 0.9)[0] == 64
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    probe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    passed = {r.key for r in stats.bloom_semi(probe, keys, 2000).collect()}
    assert {f"k{i}" for i in range(2000)} <= passed and len(passed) < 2000 + 0.05 * 18_000
    assert stats.bloom_semi(probe, keys.limit(0), 10).count() == 0


def test_filters_as_bytes(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    words = bloom.build(keys, "key", 4096, 7)
    packed = words.select(bloom.to_bytes(F.col("words"), 4096, 7).alias("b"))
    raw = bytes(packed.first().b)
    assert raw[0] == 7 and int.from_bytes(raw[1:9], "little") == 4096 and len(raw) == 9 + 512
    back = packed.select(bloom.from_bytes(F.col("b")).alias("f")).first().f
    assert (back.hashes, back.bits, back.words) == (7, 4096, words.first().words)


def test_blob_store(spark, tmp_path):
    store = BlobStore(spark, str(tmp_path / "blobs"), 1024)
    data = bytes(range(250)) * 20
    file_id = store.put_file(data, "a.bin", "x/y")
    assert store.put_file(data, "other.bin") == file_id and store.file_count() == 1
    assert store.get_metadata(file_id)["filename"] == "a.bin" and store.get_metadata(file_id)["chunk_count"] == 5
    assert store.get_file(file_id) == data and store.read_chunk(file_id, 4) == data[4096:] and store.read_chunk(file_id, 5) is None
    assert store.read_range(file_id, 1000, 100) == data[1000:1100] and store.read_range(file_id, 9999, 1) == b""
    assert store.get_file("none") is None and store.read_range("none", 0, 1) is None and not store.delete_file("none")
    empty = store.put_file(b"", "e")
    assert store.get_file(empty) == b"" and store.file_count() == 2
    assert BlobStore(spark, str(tmp_path / "blobs")).get_file(file_id) == data  # reopened
    assert store.delete_file(file_id) and store.get_file(file_id) is None and store.file_count() == 1
    rows = spark.createDataFrame([("x", "m", bytearray(b"one"), 1), ("y", "m", bytearray(b"one"), 2), ("z", "m", bytearray(data), 3)], "filename string, mime_type string, data binary, at long")
    assert {r.filename for r in store.put_files(rows).collect()} == {"x", "z"} and store.get_file(file_id) == data
