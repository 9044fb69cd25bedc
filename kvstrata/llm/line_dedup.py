"""Operator 7: line deduplication by range-partitioned hashes, giving keep bitmaps instead of text.

Each long enough line becomes a row of a 128-bit hash of its key, its document and position. The rows are
range-partitioned by all of these, so that a line in a third of all documents is dealt over many partitions, and
sorted with the documents of a hash from the largest id down. A stream over each partition sees the first
occurrence of a hash first and decides about the others as it goes, holding the lines of a few documents at most.
Hashes at the edges of a partition may go on in the next: their rows (of two hashes a partition at most) are left
open and settled by an aggregation over them. Dropped positions are then gathered by document into a compressed
bitmap of the lines that stay; texts move only when bitmaps are applied to them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, spread_join, written

MIN_CHARS, MIN_DOCS = 40, 5
#: What is stripped from lines for their keys.
BLANKS = " \t\n\x0b\x0c\r"


def _document(docs: DataFrame) -> list[Column]:
    """doc_id, tag (a hash of the text, which tells rows of one doc_id apart) and text of the rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text")]


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, doc_id, tag, pos of every line whose key has at least min_chars code points."""
    lines = docs.select(*_document(docs)).select("doc_id", "tag", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", ascii_lower(F.btrim("line", F.lit(BLANKS)))).where(F.char_length("key") >= min_chars)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "tag", "pos")


FOUND = pa.schema([("open", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32())])
FOUND_DDL = "open boolean, h1 long, h2 long, doc_id long, tag long, pos int"


def _stream(min_docs: int, open_rows: int):
    """Sorted rows of a partition to the lines that go (open false) and the lines of hashes left open (open true).

    Left open are the first and the last hash, and one of more than open_rows rows, so that no more are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # all rows so far of the last hash, unless it is left open
        left_open, first = None, True

        def emit(rows: pa.Table, still_open: bool) -> Iterator[pa.RecordBatch]:
            if rows.num_rows:
                yield from rows.add_column(0, "open", pa.array(np.full(rows.num_rows, still_open))).cast(FOUND).to_batches()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            if not rows.num_rows:
                continue
            h1, h2, tag = (rows.column(c).to_numpy() for c in ("h1", "h2", "tag"))
            doc, null = rows.column("doc_id").fill_null(0).to_numpy(), rows.column("doc_id").is_null().to_numpy()
            new_hash = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_hash | np.r_[True, (doc[1:] != doc[:-1]) | (null[1:] != null[:-1]) | (null[1:] & (tag[1:] != tag[:-1]))]
            starts, run_of, nth = np.flatnonzero(new_hash), np.cumsum(new_hash) - 1, np.cumsum(new_doc)
            ordinal = nth - nth[starts][run_of]  # 0: the document that keeps the line
            goes = (np.maximum.reduceat(ordinal, starts) + 1 >= min_docs)[run_of] & (ordinal > 0)
            at, last = 0, int(starts[-1])
            if first or (h1[0], h2[0]) == left_open:
                at = int(starts[1]) if len(starts) > 1 else len(h1)
                yield from emit(rows.slice(0, at), True)
            first, held, left_open = False, None, (h1[-1], h2[-1])
            if at <= last:
                yield from emit(rows.slice(at, last - at).filter(pa.array(goes[at:last])), False)
                if len(h1) - last > open_rows:
                    yield from emit(rows.slice(last), True)
                else:
                    held, left_open = rows.slice(last), None
        if held is not None:
            yield from emit(held, True)

    return run


def dropped_lines(hashes: DataFrame, min_docs: int = MIN_DOCS, open_rows: int = 50_000) -> DataFrame:
    """doc_id, tag, pos of the lines that go: all of a hash found in min_docs documents but in the largest doc_id.

    Rows with a null doc_id are documents of their own, told apart by tag, and smaller than any other.
    """
    by = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("tag"), F.col("pos")]
    found = written(hashes.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_stream(min_docs, open_rows), FOUND_DDL), "line-found")
    rest = found.where("open")
    own = F.when(F.col("doc_id").isNull(), F.col("tag"))  # tells documents without an id apart
    documents = rest.groupBy("h1", "h2", "doc_id", own.alias("own")).agg(F.lit(1).alias("one"))
    # few hashes, two a partition at most and one for each open_rows rows, but a line may be in a third of all documents
    sums = (F.count("*").alias("n"), F.max("doc_id").alias("keep"), F.min("own").alias("keep_own"))
    hot = written(documents.groupBy("h1", "h2").agg(*sums).where(F.col("n") >= min_docs), "line-open")
    keeps = F.when(F.col("keep").isNotNull(), F.col("doc_id").eqNullSafe(F.col("keep"))).otherwise(F.col("tag") == F.col("keep_own"))
    settled = spread_join(rest, hot, ["h1", "h2"], "n", rest.count()).where(~keeps)
    return found.where("NOT open").select("doc_id", "tag", "pos").unionByName(settled.select("doc_id", "tag", "pos"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for positions in batch.column(2).to_pylist():
            keep = np.ones((max(positions) // 8 + 1) * 8, np.uint8)
            keep[positions] = 0
            out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "tag", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, open_rows: int = 50_000) -> DataFrame:
    """doc_id, tag, keep of each document that loses lines: zlib-compressed bits, 1 for a line that stays.

    Bits end at the last line that goes; all later lines stay. Repeated rows (doc_id and text) share a bitmap.
    """
    hashes = written(line_hashes(docs, min_chars), "line-hashes")
    lost = dropped_lines(hashes, min_docs, open_rows)
    return lost.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("at")).mapInArrow(_bitmaps, "doc_id long, tag long, keep binary")


APPLIED_DDL = "doc_id long, n_lines long, n_dropped long, kept string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, dropped, kept = [], [], []
        for text, keep in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n = text.count("\n") + 1
            total.append(n)
            if keep is None:
                dropped.append(0)
                kept.append(text)
                continue
            lines = text.split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n].tolist()
            stay = [x for x, bit in zip(lines, bits, strict=False) if bit] + lines[len(bits) :]
            dropped.append(n - len(stay))
            kept.append("\n".join(stay))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that is left) of every row of docs."""
    marks = bitmaps.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "keep")
    rows = docs.select(*_document(docs)).join(marks, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    return rows.select("doc_id", "text", "keep").mapInArrow(_apply, APPLIED_DDL)


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept of every row of docs; null and empty texts are one empty line, long ones read whole.

    Rows that repeat a doc_id are one document: a line counts once for them, and if that is the largest id that
    holds the line, all of them keep it. An empty table gives no rows; other columns are ignored.
    """
    return apply_bitmaps(docs, written(keep_bitmaps(docs, min_chars, min_docs), "line-bitmaps"))
