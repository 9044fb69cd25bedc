"""The ordered scan: prefix and range, order, offset and limit, as one lazy plan.

Ranges [start, end) exclude their end. Order comes first, then offset, then limit; an offset past the end and a limit
of 0 give nothing. A prefix becomes startswith, and for binary keys also the range [prefix, successor), as only ranges
on binary columns reach Parquet.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import Codec, JsonCodec


def successor(prefix: bytes) -> bytes | None:
    """The least byte string above all that start with prefix; None where there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


@dataclass(frozen=True)
class KVQuery:
    """An immutable scan of a frame with the columns key and value; each setter returns a new query."""

    source: DataFrame
    _prefix: str | bytes | None = None
    _start: str | bytes | None = None
    _end: str | bytes | None = None
    _limit: int | None = None
    _offset: int = 0
    _reverse: bool = False
    _where: tuple[Column, ...] = ()

    def prefix(self, prefix: str | bytes) -> KVQuery:
        return replace(self, _prefix=prefix)

    def start_key(self, key: str | bytes) -> KVQuery:
        return replace(self, _start=key)

    def end_key(self, key: str | bytes) -> KVQuery:
        return replace(self, _end=key)

    def range(self, start: str | bytes, end: str | bytes) -> KVQuery:
        return replace(self, _start=start, _end=end)

    def limit(self, n: int) -> KVQuery:
        if n < 0:
            raise ValueError("a limit is 0 or more")
        return replace(self, _limit=n)

    def offset(self, n: int) -> KVQuery:
        if n < 0:
            raise ValueError("an offset is 0 or more")
        return replace(self, _offset=n)

    def reverse(self, yes: bool = True) -> KVQuery:
        return replace(self, _reverse=yes)

    def where(self, condition: Column) -> KVQuery:
        """A condition on the live entries, such as one on a field of decoded JSON."""
        return replace(self, _where=(*self._where, condition))

    def explain_kind(self) -> str:
        """The kind of scan: a range wins over a prefix."""
        if self._start is not None or self._end is not None:
            return "RangeScan"
        return "FullScan" if self._prefix is None else "PrefixScan"

    def _literal(self, key: str | bytes) -> Column:
        if dict(self.source.dtypes)["key"] == "binary":
            return F.lit(key.encode("utf-8") if isinstance(key, str) else bytes(key))
        return F.lit(key if isinstance(key, str) else key.decode("utf-8"))

    def matches(self) -> Column:
        """The condition on key."""
        key, tests = F.col("key"), [F.lit(True)]
        if self._prefix is not None and len(self._prefix):
            tests.append(F.startswith(key, self._literal(self._prefix)))
            if dict(self.source.dtypes)["key"] == "binary":
                tests.append(key >= self._literal(self._prefix))
                first = self._prefix.encode("utf-8") if isinstance(self._prefix, str) else self._prefix
                if (after := successor(first)) is not None:
                    tests.append(key < F.lit(after))
        if self._start is not None:
            tests.append(key >= self._literal(self._start))
        if self._end is not None:
            tests.append(key < self._literal(self._end))
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def unordered(self) -> DataFrame:
        """The matching entries without order, offset and limit."""
        out = self.source.where(self.matches())
        for condition in self._where:
            out = out.where(condition)
        return out

    def df(self) -> DataFrame:
        """The matching entries in order."""
        out = self.unordered().orderBy(F.col("key").desc() if self._reverse else F.col("key").asc())
        if self._offset:
            out = out.offset(self._offset)
        return out if self._limit is None else out.limit(self._limit)

    def entries(self) -> DataFrame:
        return self.df().select("key", "value")

    def strings(self) -> DataFrame:
        """Key and value as strings; bytes that aren't UTF-8 raise."""
        text = {c: (F.decode(c, "utf-8") if t == "binary" else F.col(c)).alias(c) for c, t in self.source.dtypes}
        return self.df().select(text["key"], text["value"])

    def keys(self) -> DataFrame:
        """Keys only: values aren't read."""
        return self.df().select("key")

    def json(self, schema: str) -> DataFrame:
        return self.objects(JsonCodec(schema))

    def objects(self, codec: Codec) -> DataFrame:
        return self.df().select("key", codec.decode(F.col("value")).alias("value"))

    def for_each(self, callback: Callable[[bytes | str, bytes | str], bool | None]) -> int:
        """Call back with each key and value in order until that returns False; the number of calls.

        Partitions of the order come to the driver one after the other, so what lies behind the stop never does.
        """
        calls = 0
        for row in self.entries().toLocalIterator():
            calls += 1
            if callback(row.key, row.value) is False:
                break
        return calls

    def count(self) -> int:
        return self.df().count()

    def pages(self) -> DataFrame:
        """The entries with pos, their place in the order (from 1), for a page of known limit."""
        order = F.col("key").desc() if self._reverse else F.col("key").asc()
        if self._limit is None:
            raise ValueError("pos is given to a page, that is, with a limit")
        return self.df().withColumn("pos", F.row_number().over(Window.orderBy(order)))
