"""Content-addressed blobs in chunks, with byte-range reads.

A file's id is the SHA-256 of its content. Equal contents are one file, whose first name is kept. Files are split into
chunks by built-in functions; each chunk has a CRC32 that is checked when it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_CHUNK, DEFAULT_CHUNK, MOST_CHUNK = 1 << 10, 1 << 20, 16 << 20


def chunk_size(n: int = DEFAULT_CHUNK) -> int:
    """A chunk size within 1 KiB and 16 MiB."""
    return min(MOST_CHUNK, max(LEAST_CHUNK, n))


def files(blobs: DataFrame, size: int = DEFAULT_CHUNK) -> DataFrame:
    """Metadata of the distinct contents of blobs (filename, mime_type, data binary, at: the order of arrival)."""
    size = chunk_size(size)
    named = blobs.select(F.sha2("data", 256).alias("file_id"), F.octet_length("data").cast("long").alias("total_size"), "filename", "mime_type", "at")
    first = named.groupBy("file_id").agg(F.min(F.struct("at", "filename", "mime_type")).alias("f"), F.first("total_size").alias("total_size"))
    count = F.greatest(F.lit(1), F.ceil(F.col("total_size") / size)).cast("int")
    return first.select("file_id", "f.filename", "f.mime_type", "total_size", F.lit(size).alias("chunk_size"), count.alias("chunk_count"), F.col("file_id").alias("content_hash"))


def split(blobs: DataFrame, size: int = DEFAULT_CHUNK, first: int = 0, last: int | None = None) -> DataFrame:
    """file_id, index, data, crc32 of the chunks (first to last) of blobs (data); an empty file has one empty chunk.

    Copies are told apart before their bytes are split: only the first row of a content is.
    """
    size, stop = chunk_size(size), last
    whole = blobs.select(F.sha2("data", 256).alias("file_id"), "data").dropDuplicates(["file_id"])
    last = F.greatest(F.ceil(F.octet_length("data") / size).cast("int") - 1, F.lit(0))
    if stop is not None:
        last = F.least(last, F.lit(stop))
    some = whole.where(last >= first) if first else whole
    cut = some.select("file_id", F.posexplode(F.transform(F.sequence(F.lit(first), last), lambda i: F.substring(F.col("data"), i * size + 1, F.lit(size)))).alias("index", "data"))
    return cut.select("file_id", (F.col("index") + first).alias("index"), "data", F.crc32("data").alias("crc32"))


def checked(data: Column = None, crc: Column = None) -> Column:
    """The bytes of a chunk; raises where they don't have its checksum."""
    data, crc = F.col("data") if data is None else data, F.col("crc32") if crc is None else crc
    return F.when(F.crc32(data) == crc, data).otherwise(F.raise_error(F.lit("chunk checksum mismatch")).cast("binary"))


def read_chunk(chunks: DataFrame, file_id: str, index: int) -> DataFrame:
    """file_id, index, data of one chunk; no row where there is none."""
    return chunks.where((F.col("file_id") == file_id) & (F.col("index") == index)).select("file_id", "index", checked().alias("data"))


def assemble(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """file_id, data of whole files; raises where a chunk is missing. A file's bytes meet in one row."""
    parts = chunks.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("index", checked().alias("data")))).alias("parts"))
    rows = meta.select("file_id", "chunk_count").join(parts, "file_id", "left")
    data = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), ""))
    whole = F.coalesce(F.size("parts"), F.lit(0)) == F.col("chunk_count")
    return rows.select("file_id", F.when(whole, data).otherwise(F.raise_error(F.lit("chunk missing")).cast("binary")).alias("data"))


def read_range(chunks: DataFrame, meta: DataFrame, offset: int, length: int) -> DataFrame:
    """file_id, data: the bytes [offset, offset + length) of each file, cut at its end; empty past it.

    Only the chunks that the range touches are read.
    """
    if offset < 0 or length < 0:
        raise ValueError("offset and length are 0 or more")
    info = meta.select("file_id", "chunk_size", "total_size")
    rows = info.join(chunks, "file_id").where((F.col("index") >= F.floor(F.lit(offset) / F.col("chunk_size"))) & (F.col("index") * F.col("chunk_size") < offset + length))
    begin = F.greatest(F.lit(0), offset - F.col("index") * F.col("chunk_size"))
    stop = F.least(F.col("chunk_size"), offset + length - F.col("index") * F.col("chunk_size"))
    piece = F.substring(checked(), (begin + 1).cast("int"), F.greatest(stop - begin, F.lit(0)).cast("int"))
    parts = rows.select("file_id", "index", F.hex(piece).alias("piece")).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("index", "piece"))).alias("parts"))
    data = F.unhex(F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<struct<index:int,piece:string>>")), lambda p: p["piece"]), ""))
    return info.join(parts, "file_id", "left").select("file_id", data.alias("data"))


def duplicates(blobs: DataFrame) -> DataFrame:
    """file_id and copies of contents that come more than once."""
    return blobs.groupBy(F.sha2("data", 256).alias("file_id")).agg(F.count("*").alias("copies")).where("copies > 1")


def new_files(blobs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of blobs whose content no known file has."""
    ids = known.select(F.col("file_id").alias("__id"))
    return blobs.join(ids, F.sha2("data", 256) == F.col("__id"), "left_anti")
