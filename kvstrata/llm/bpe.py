"""Operator 6: BPE encoding over a table of distinct words, and decoding through id-to-piece lookups.

A tokenizer of the kind read here never joins characters across white space, so a text's ids are its words' ids in
order. Three steps:

1. Texts are split into words where they lie. Each chunk (a batch of rows) numbers its distinct words; a text becomes
   the numbers of its words. The chunk's words are dealt out by hash into buckets, sorted and compressed.
2. A bucket sees a word once for each chunk that has it, never once for each occurrence, and encodes each distinct
   word once.
3. The ids return to the chunks and are joined to the texts by word number.

Steps 2 and 3 read one and the same exchange, in which chunks and buckets have places of their own. Neither words nor
ids of the corpus are ever gathered: a task holds one chunk's or one bucket's words. The vocabulary file is the only
thing broadcast; its size doesn't depend on the corpus.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import batches_of, release, text_bytes, written

#: Bytes of input for each bucket of words (see buckets_for) and for each task that joins ids.
BUCKET_BYTES, TASK_BYTES = 8 << 20, 64 << 20
#: Words encoded in one call, texts and bytes of a chunk, and ids of texts that are decoded at once.
CALL, TEXTS, CHUNK_BYTES, IDS = 4096, 8000, 16 << 20, 1 << 19
#: Bytes of a chunk that are split at once: all words of a chunk would take several times its bytes.
PART_BYTES = 1 << 20
#: Rows that Python gets at once.
SENT = 1000


def tokenizer(spec: bytes):
    """The tokenizer of a vocabulary file's content, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(spec.decode("utf-8"))
    out.no_truncation()
    out.no_padding()
    return out


def read_spec(path: str) -> bytes:
    """The content of a vocabulary file on the driver; it must be one whose pieces are joined by spaces."""
    with open(path, "rb") as f:
        spec = f.read()
    if json.loads(spec).get("decoder") is not None:
        raise ValueError("only vocabularies without a decoder are read: their pieces are joined by spaces")
    return spec


def _plain(values: np.ndarray) -> bytes:
    """Numbers, compressed by byte planes."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _numbers(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<u4")


#: place: chunk of a text, or less than zero for a bucket of words. words and numbers of words, or numbers of a text.
ROWS = pa.schema([("place", pa.int64()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("words", pa.binary()), ("numbers", pa.binary())])
ROWS_DDL = "place long, chunk long, doc_id long, words binary, numbers binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in ROWS]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, ROWS, strict=True)], schema=ROWS)


def _chunks(whole: pa.RecordBatch, texts: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of so many texts at most, and of so many bytes (CHUNK_BYTES) where they have more than one text."""
    size = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)
    reach, at = np.cumsum(size, dtype=np.int64), 0
    while at < whole.num_rows:
        before = reach[at - 1] if at else 0
        end = max(at + 1, min(at + texts, int(np.searchsorted(reach, before + (most or CHUNK_BYTES), "right"))))
        yield whole.slice(at, end - at)
        at = end


def _split(buckets: int, texts: int):
    """doc_id and text to rows of texts and of words."""

    def deal(chunk: int, parts: list[tuple], tables: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        known = pa.chunked_array(tables).dictionary_encode()  # words are numbered in the order in which they come first
        for i, (doc_ids, cuts, own) in enumerate(parts):
            numbers = known.chunk(i).indices.to_numpy().astype(np.uint32)[own]
            yield _rows([(chunk, chunk, d, None, _plain(numbers[a:b])) for d, a, b in zip(doc_ids, cuts, cuts[1:], strict=False)])
        known = known.chunk(0).dictionary
        parts.clear()
        tables.clear()
        order = pc.sort_indices(known).to_numpy().astype(np.int64)
        words = known.cast(pa.large_binary()).take(pa.array(order)).to_pylist()
        bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1)).tolist()
        yield _rows([(-1 - b, chunk, None, zlib.compress(b"\n".join([words[i] for i in by[x:y]]), 1), _plain(order[by[x:y]])) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, tables, rows, size = TaskContext.get().partitionId() << 32, [], [], 0, 0
        for part in (p for b in batches for p in _chunks(b, texts, min(PART_BYTES, CHUNK_BYTES))):
            more = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if rows and (rows + part.num_rows > texts or size + more > CHUNK_BYTES):
                yield from deal(chunk, parts, tables)
                release()
                chunk, rows, size = chunk + 1, 0, 0
            rows, size = rows + part.num_rows, size + more
            lists = pc.ascii_split_whitespace(pc.fill_null(part.column(1), "").cast(pa.large_string()))
            coded = lists.flatten().dictionary_encode()
            parts.append((part.column(0).to_pylist(), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())].tolist(), coded.indices.to_numpy()))
            tables.append(coded.dictionary)
            del lists, coded  # several times the part's bytes, which the rest doesn't need
        if rows:
            yield from deal(chunk, parts, tables)
        release()

    return run


def _coder(spec: bytes):
    """A function from words to the number of ids of each, and all ids.

    Words are encoded many at a time with a special token between them, which cuts a text before anything else is
    done to it; one by one where the vocabulary has no such token, or the word holds one.
    """
    coder, parts = tokenizer(spec), json.loads(spec)
    cuts = [t for t in parts.get("added_tokens", []) if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
    cut, cut_id = (cuts[0]["content"], cuts[0]["id"]) if cuts else (None, None)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), CALL):
            part = words[at : at + CALL]
            text = cut.join(part) if cut else ""
            if cut and text.count(cut) == len(part) - 1:
                ids = np.array(coder.encode(text, add_special_tokens=False).ids, np.int64)
                stops = np.r_[-1, np.flatnonzero(ids == cut_id), len(ids)]
                counts.append(np.diff(stops) - 1)
                flat.append(ids[ids != cut_id])
            else:
                each = [coder.encode(w, add_special_tokens=False).ids for w in part]
                counts.append(np.array(list(map(len, each)), np.int64))
                flat.append(np.array([i for x in each for i in x], np.int64))
        return np.concatenate(counts), np.concatenate(flat)

    return encode


def _gather(starts: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[start : start + count] of each pair, joined."""
    ends = np.cumsum(counts)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)]


def _encode(spec):
    """Rows sorted by place to rows of the chunks' word ids: words has counts and ids. Rows of texts are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bucket = None, None
        number: dict[bytes, int] = {}  # of the bucket's words, whose ids are flat[starts : starts + counts]
        counts = starts = flat = np.zeros(0, np.int64)
        for whole in batches:
            batch = whole.filter(pc.less(whole.column(0), 0))
            encode = encode or _coder(spec.value)
            for b, chunk, blob, numbers in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)], strict=True):
                if b != bucket:
                    bucket, number = b, {}
                    counts = starts = flat = np.zeros(0, np.int64)
                words = zlib.decompress(blob).split(b"\n")
                at = [number.setdefault(w, len(number)) for w in words]
                if fresh := [w.decode("utf-8") for w, i in zip(words, at, strict=True) if i >= len(counts)]:
                    more, ids = encode(fresh)
                    starts = np.r_[starts, len(flat) + np.cumsum(more) - more]
                    counts, flat = np.r_[counts, more], np.r_[flat, ids]
                own = np.array(at, np.int64)
                found = np.r_[counts[own], _gather(starts[own], counts[own], flat)]
                yield _rows([(chunk, chunk, None, _plain(found), numbers)])
        release()

    return run


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, words before texts, to doc_id and ids of the texts."""
    chunk, parts, starts, counts, flat = None, [], None, None, None
    for whole in batches:
        kept = whole.filter(pc.greater_equal(whole.column(0), 0))
        for at in range(0, kept.num_rows, 256):
            batch = kept.slice(at, 256)
            doc_ids, lists = [], []
            for c, doc_id, ids, numbers in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3, 4)], strict=True):
                if c != chunk:
                    chunk, parts, flat = c, [], None
                mine = _numbers(numbers)
                if ids is not None:
                    values = _numbers(ids)
                    parts.append((mine, values[: len(mine)], values[len(mine) :]))
                    continue
                if flat is None:  # the chunk's words are all here
                    n = sum(len(a) for a, _, _ in parts)
                    counts, starts, ahead = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
                    for a, k, v in parts:
                        counts[a] = k
                        starts[a] = ahead + np.cumsum(k, dtype=np.int64) - k
                        ahead += len(v)
                    flat = np.concatenate([np.zeros(0, np.uint32), *[v for _, _, v in parts]]).astype(np.int32)
                    parts = []
                doc_ids.append(doc_id)
                lists.append(_gather(starts[mine], counts[mine], flat))
            if doc_ids:
                offsets = np.r_[0, np.cumsum([len(x) for x in lists])]
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), ids], ["doc_id", "ids"])


def buckets_for(size: int) -> int:
    """Buckets of words for so many bytes of input.

    Distinct words grow more slowly than texts, and each chunk sends each bucket a row. So beyond 64 GiB buckets grow with
    the root of the input; a bucket is streamed, and holds distinct words only.
    """
    return max(16, min(size // BUCKET_BYTES, math.isqrt(size >> 10)))


def encode(docs: DataFrame, path: str, chunk_texts: int = TEXTS, buckets: int | None = None) -> DataFrame:
    """doc_id, ids of every row of docs (doc_id, text), equal to the library's encoding without special tokens.

    Null and empty texts have no ids, long ones are encoded whole; repeated rows, and rows with equal or null doc_id, are
    each encoded and returned. An empty table gives no rows. Other columns are ignored.
    """
    return _placed(docs, path, chunk_texts, buckets).mapInArrow(_join, "doc_id long, ids array<int>")


def _placed(docs: DataFrame, path: str, chunk_texts: int = TEXTS, buckets: int | None = None) -> DataFrame:
    """Rows for _join(): each chunk's words with their ids, then its texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = text_bytes(rows)
    buckets = buckets or buckets_for(size)
    spec = spark.sparkContext.broadcast(read_spec(path))
    # a stated number keeps the two exchanges' partitions alike, so that the texts need not move again
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    dealt = rows.mapInArrow(_split(buckets, chunk_texts), ROWS_DDL).repartition(n, "place")
    coded = dealt.sortWithinPartitions("place").mapInArrow(_encode(spec), ROWS_DDL).repartition(n, "place")
    return dealt.unionByName(coded).repartition(n, "place").sortWithinPartitions("place", F.col("words").isNull())


def _pieces(spec: bytes) -> list[str | None]:
    """The piece of each id."""
    parts = json.loads(spec)
    vocabulary = parts["model"]["vocab"]
    if isinstance(vocabulary, dict):
        numbered = {i: piece for piece, i in vocabulary.items()} | {t["id"]: t["content"] for t in parts.get("added_tokens", [])}
        return [numbered.get(i) for i in range(max(numbered) + 1)]
    coder = tokenizer(spec)
    return [coder.id_to_token(i) for i in range(coder.get_vocab_size(with_added_tokens=True))]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their lists hold about IDS numbers."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes, dtype=np.int64) // IDS
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def joined(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The pieces of each list of ids, joined by spaces; nulls and ids without a piece are left out."""
    flat = ids.flatten()
    good = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces))), False)
    if not pc.all(good).as_py() and len(flat) or pieces.null_count or ids.null_count:
        table = pieces.to_pylist()
        return pa.array([" ".join([table[i] for i in x or () if i is not None and 0 <= i < len(table) and table[i] is not None]) for x in ids.to_pylist()], pa.string())
    offsets = np.r_[0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces.take(flat)), " ")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows (with a column ids) and a text column: the pieces of the ids joined by spaces, unknown ids left out.

    The id-to-piece table is the vocabulary, joined on the map side. A text column that was there is replaced.
    """
    rows = rows.drop("text")
    spec = rows.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = None
        for batch in _runs(batches):
            pieces = pa.array(_pieces(spec.value), pa.string()) if pieces is None else pieces
            yield batch.append_column("text", joined(batch.column("ids"), pieces))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("text", StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs, encoded and then decoded.

    Both, and the digests, are made in the task that has the ids, as ids and texts needn't leave it. The digests are
    written, as only then it is sure that Python gets few texts at once.
    """
    rows = _placed(docs, path)
    spec = rows.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = digits = None
        for batch in _runs(_join(batches)):
            if pieces is None:
                pieces = pa.array(_pieces(spec.value), pa.string())
                digits = pa.array(list(map(str, range(len(pieces)))), pa.string())
            ids = batch.column("ids")
            hashes = [pa.array([sha256(x).hexdigest() for x in joined(ids, table).cast(pa.binary()).to_pylist()], pa.string()) for table in (digits, pieces)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), *hashes], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    with batches_of(rows.sparkSession, SENT):
        return written(rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"), "digests")
