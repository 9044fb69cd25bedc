"""Wire formats of entries: length-prefixed key and value with a CRC32, and compressed blocks.

Entry: u16 key length, key, u32 value length, value, u32 CRC32 of all before it; little-endian (fixed format). It is
written and read by built-in functions. Compressed block: flag byte 0 and the bytes, or flag byte 1, u32 length, then
the u32 length again and an LZ4 block; used from 256 bytes on and only where that is shorter (fixed format). Blocks are for interchange only, as
Parquet compresses what is stored; an Arrow UDF makes them value by value, since Spark has no function for them. It
returns them in parts of about 1 MiB, so that Python holds what it was sent and little else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks under so many bytes are stored as they are.
LEAST_COMPRESSED = 256
MOST_KEY = 65535
#: Bytes of values after which Python returns them.
PART_BYTES = 1 << 20


def little_endian(n: Column, size: int) -> Column:
    """An unsigned number as size bytes."""
    wide = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(wide, 2 * i + 1, 2) for i in reversed(range(size))]))


def number(data: Column, at: Column, size: int) -> Column:
    """The unsigned little-endian number of size bytes at a position (from 0)."""
    byte = lambda i: F.hex(F.substring(data, (at + i + 1).cast("int"), F.lit(1)))
    return F.conv(F.concat(*[byte(i) for i in reversed(range(size))]), 16, 10).cast("long")


def encode_entry(key: Column, value: Column) -> Column:
    """The entry of a binary key and value; a key of more than 65,535 bytes raises."""
    size = F.octet_length(key)
    checked = F.when(size <= MOST_KEY, size).otherwise(F.raise_error(F.lit("key too long for an entry")).cast("int"))
    body = F.concat(little_endian(checked, 2), key, little_endian(F.octet_length(value), 4), value)
    return F.concat(body, little_endian(F.crc32(body), 4))


def decode_entry(data: Column) -> Column:
    """Struct of key and value of an entry; raises where it is cut short or its checksum is wrong. Bytes after it are ignored."""
    keys = number(data, F.lit(0), 2)
    values = number(data, keys + 2, 4)
    body = F.substring(data, F.lit(1), (keys + values + 6).cast("int"))
    whole = F.octet_length(data) >= keys + values + 10
    right = F.crc32(body) == number(data, keys + values + 6, 4)
    parts = F.struct(F.substring(data, F.lit(3), keys.cast("int")).alias("key"), F.substring(data, (keys + 7).cast("int"), values.cast("int")).alias("value"))
    bad = F.raise_error(F.lit("entry is truncated or its checksum is wrong")).cast("struct<key:binary,value:binary>")
    return F.when(whole, F.when(right, parts).otherwise(bad)).otherwise(bad)


def _compress(data: bytes) -> bytes:
    if len(data) >= LEAST_COMPRESSED:
        size = len(data).to_bytes(4, "little")
        block = b"\x01" + size + size + pa.compress(data, "lz4_raw", asbytes=True)
        if len(block) < len(data) + 5:
            return block
    return b"\x00" + data


def _decompress(block: bytes) -> bytes:
    if not block:
        return b""
    if block[0] == 0:
        return block[1:]
    if block[0] != 1 or len(block) < 9:
        raise ValueError("not a compressed block")
    return pa.decompress(block[9:], int.from_bytes(block[5:9], "little"), "lz4_raw", asbytes=True)


def _on_bytes(function: Callable[[bytes], bytes]):
    """An Arrow UDF on binary columns; its function is pickled by value, as executors need no copy of this package."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done, size = [], 0
            for x in batch:
                done.append(function(x.as_py()) if x.is_valid else None)
                size += len(done[-1] or b"")
                if size >= PART_BYTES:
                    yield pa.array(done, batch.type)
                    done, size = [], 0
            if done:
                yield pa.array(done, batch.type)
            pa.default_memory_pool().release_unused()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")


def compress(data: Column) -> Column:
    return _on_bytes(_compress)(data)


def decompress(block: Column) -> Column:
    return _on_bytes(_decompress)(block)


def is_compressed(block: Column) -> Column:
    return F.coalesce(F.hex(F.substring(block, 1, 1)) == "01", F.lit(False))


def decompressed_size(block: Column) -> Column:
    """Bytes of a block once decompressed."""
    return F.when(is_compressed(block), number(block, F.lit(1), 4)).otherwise(F.greatest(F.octet_length(block) - 1, F.lit(0)).cast("long"))
