"""Bloom filters made and probed by built-in functions.

A filter is a frame of one row with an array of 64-bit words. It is made by bit_or over words, so map-side partial
aggregation does most of the work, and probed through a scalar subquery, so no join or Python is involved. Its size
is fixed by its parameters, never by the data alone: a filter that is too small only passes more rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entries import little_endian, number

#: Most bits of a filter: 16 MiB.
MOST_BITS = 1 << 27


def size_for(n: int, p: float = 0.01) -> tuple[int, int]:
    """Bits (a power of two) and hash functions for n keys at a false-positive rate p.

    bits: -n ln p / (ln 2)^2 rounded up to a power of two, 64 at least; hashes: bits / n * ln 2 within 2..16; p
    within 0.001..0.5.
    """
    n, p = max(1, n), min(0.5, max(0.001, p))
    bits = max(64, 1 << math.ceil(math.log2(max(1.0, -n * math.log(p) / math.log(2) ** 2))))
    return bits, min(16, max(2, round(bits / n * math.log(2))))


def positions(key: Column, bits: int, hashes: int) -> list[Column]:
    """Bit positions of a key by double hashing."""
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    step = F.shiftright(b, 32).bitwiseOR(F.lit(1))
    start = F.shiftright(a, 32)
    return [F.pmod(start + i * step, F.lit(bits)) for i in range(hashes)]


def build(keys: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """One row, one column words array<long>: the filter of the non-null values of a column."""
    at = F.explode(F.array(*positions(F.col(column), bits, hashes))).alias("at")
    set_bits = keys.where(F.col(column).isNotNull()).select(at)
    words = set_bits.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("value"))
    every = keys.sparkSession.range(max(1, bits // 64)).select(F.col("id").alias("word"))
    both = every.join(words, "word", "left").select("word", F.coalesce("value", F.lit(0)).alias("value"))
    return both.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "value"))), lambda x: x["value"]).alias("words"))


def might_contain(words: Column, key: Column, bits: int, hashes: int) -> Column:
    """False only for keys that the filter doesn't hold; null for a null key."""
    test = None
    for at in positions(key, bits, hashes):
        hit = F.call_function("getbit", F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
        test = hit if test is None else test & hit
    return F.when(key.isNotNull(), test)


def to_bytes(words: Column, bits: int, hashes: int) -> Column:
    """A filter as bytes: u8 hashes, u64 bits, then the words as u64; little-endian (fixed format)."""
    body = F.array_join(F.transform(words, lambda w: F.hex(little_endian(w, 8))), "")
    return F.concat(little_endian(F.lit(hashes), 1), little_endian(F.lit(bits), 8), F.unhex(body))


def from_bytes(data: Column) -> Column:
    """Struct of hashes, bits and words of a filter's bytes."""
    bits = number(data, F.lit(1), 8)
    # a word may have its highest bit set, so its two halves are read
    word = lambda i: F.shiftleft(number(data, 9 + i * 8 + 4, 4), 32).bitwiseOR(number(data, 9 + i * 8, 4))
    words = F.transform(F.sequence(F.lit(0).cast("long"), F.shiftright(bits, 6) - 1), word)
    return F.struct(number(data, F.lit(0), 1).alias("hashes"), bits.alias("bits"), words.alias("words"))
