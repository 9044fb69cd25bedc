"""Codecs: pairs of functions from column to column, between typed values and stored bytes or strings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(stored: Column) -> Column:
    """Stored bytes as a string; bytes that aren't UTF-8 raise."""
    return F.decode(stored.cast("binary"), "utf-8")


@dataclass(frozen=True)
class Codec:
    """encode: a typed column to binary; decode: binary (or string) to a typed column."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


def StringCodec() -> Codec:  # noqa: N802
    return Codec(lambda c: F.encode(c, "utf-8"), text)


def JsonCodec(schema: str) -> Codec:  # noqa: N802
    """Objects (structs or maps) and lists (arrays) of a schema; text that isn't such JSON raises."""
    return Codec(lambda c: F.encode(F.to_json(c), "utf-8"), lambda c: F.from_json(text(c), schema, {"mode": "FAILFAST"}))


def ListCodec(element: str) -> Codec:  # noqa: N802
    return JsonCodec(f"array<{element}>")


def VariantCodec() -> Codec:  # noqa: N802
    """JSON without a schema; fields are read by variant_get."""
    return Codec(lambda c: F.encode(F.to_json(c), "utf-8"), lambda c: F.parse_json(text(c)))
