"""Operator 9: removal of long repeated byte strings by bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if it is covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id.

No index of the whole corpus is ever built; strings that can be equal are brought together first. The smallest hash
among a string's GRAM-byte substrings depends on its content only, and neighbouring strings mostly share it: a
maximal run of neighbours with one smallest hash (its key) is a unit, and equal strings lie in units of equal keys.

1. Each task collects its units' distinct keys, buffer by buffer, and deals them out by key. Keys seen in more than
   one document or buffer are shared; a filter of bounded size holds them. A key of very many units is hot.
2. Texts are read again. Of the shared units with equal content in a buffer only those of the smallest document are
   sent on; the others go at once (map-side aggregation). Hot units are sent string by string, keyed by string.
3. Units with equal keys meet. Of units with equal content all but the smallest document's go. Where contents of a
   key differ, the distinct contents are concatenated, and the BWT of that text is expanded backwards, breadth first:
   intervals of strings of length 0, 1, 2, ... set the longest common prefixes of neighbouring suffixes by increasing
   value, until LENGTH. What is still unset then is a common prefix of LENGTH or more, so each string finds the
   smallest document that has it.
4. Spans are gathered by document and cut out.

Keys are 64-bit hashes and only decide which strings are compared: contents are equal where their bytes are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cleaning, release, written
from .common import text_bytes as input_bytes

LENGTH, GRAM = 50, 28
#: Strings of a unit at most, units of a buffer, bytes hashed at once, bytes of input for each bucket.
LONGEST, BUFFER, PIECE, BUCKET_BYTES = 64, 200_000, 1 << 18, 2 << 20
#: Texts that are Python objects at once, and spans that a task holds before it gives them out.
TEXTS, SPANS = 512, 500_000
#: Rows sent to Python at once.
ROWS = 1000
#: Bits of the filter for each shared key, and of the whole filter at most.
KEY_BITS, MOST_BITS = 16, 1 << 29
#: Units of a key above which it is hot, and bytes of one transform.
HOT, TEXT = 200_000, 1 << 19
NO_ID = 2**63 - 1

_random = np.random.default_rng(20)
BYTES, OTHER = _random.integers(0, 2**64, (2, 256), np.uint64)
STEPS = _random.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(STEPS[40])
BACK = pow(BASE, -1, 2**64)


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


POWERS, BACKS = _powers(BASE, PIECE + LENGTH), _powers(BACK, PIECE + LENGTH)


def _grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all substrings of n bytes."""
    level, size, out = BYTES[x], 1, None
    while True:
        if n & size:
            if out is None:
                out = level
            else:  # the pieces found so far come after one of the present size
                m = min(len(level), len(out) - size)
                out = level[:m] * STEPS[20 + size.bit_length()] + out[size : size + m]
        if size * 2 > n:
            return _mixed(out[: max(0, len(x) - n + 1)])
        level = level[:-size] * STEPS[size.bit_length()] + level[size:]
        size *= 2


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours."""
    size = 1
    while size * 2 <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (n - size)], h[n - size :]) if n > size else h


def units(x: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of strings, key and content hash of the units of bytes x; last: for each byte, its text's last start."""
    n = len(x) - LENGTH + 1
    none = np.zeros(0, np.uint64)
    if n <= 0:
        return none.astype(np.int64), none.astype(np.int64), none, none
    key = _least(_grams(x, GRAM), LENGTH - GRAM + 1)
    at = np.arange(n)
    valid = at <= last[:n]
    text = last[:n]
    new = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]] & valid
    ends = np.r_[np.flatnonzero(new[1:] | (valid[:-1] & ~valid[1:])) + 1, n]
    starts = np.flatnonzero(new)
    stops = ends[np.searchsorted(ends, starts, "right")]
    count = stops - starts
    if (count > LONGEST).any():  # repetitive text
        parts = -(-count // LONGEST)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + (np.arange(parts.sum()) - first) * LONGEST
        count = np.minimum(np.repeat(stops, parts) - starts, LONGEST)
    sums = np.r_[np.uint64(0), np.cumsum(OTHER[x] * POWERS[: len(x)], dtype=np.uint64)]
    content = _mixed((sums[starts + count + LENGTH - 1] - sums[starts]) * BACKS[starts] + count.astype(np.uint64))
    # minima lie near zero: mixed again, they are dealt evenly
    return starts, count, _mixed(key[starts] + STEPS[60]), content


class Buffer:
    """Units of many texts: text (index into rows), start, count, key, content; and the bytes of the texts."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.texts: list[bytes] = []
        self.parts: list[tuple] = []
        self.n = 0

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*self.parts, strict=True)]

    def ids(self) -> np.ndarray:
        return np.array([NO_ID if r[0] is None else r[0] for r in self.rows], np.int64)


def buffers(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Buffer]:
    """The units of texts (doc_id, tag, text as binary), in buffers of about limit units."""
    out = Buffer()

    def add(pending: list[tuple[int, bytes, int]]) -> None:
        """pending: index of a text, some of its bytes, and their offset in it."""
        x = np.frombuffer(b"".join(b for _, b, _ in pending), np.uint8)
        sizes = np.array([len(b) for _, b, _ in pending])
        firsts = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(pending)), sizes)
        starts, count, key, content = units(x, (firsts + sizes - LENGTH)[which])
        if len(starts):
            piece = which[starts]
            texts, offsets = np.array([i for i, _, _ in pending]), np.array([o for _, _, o in pending])
            out.parts.append((texts[piece], starts - firsts[piece] + offsets[piece], count, key, content))
            out.n += len(starts)

    for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
        pending, size = [], 0
        for doc_id, tag, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if text is None or len(text) < LENGTH:
                continue
            out.rows.append((doc_id, tag))
            out.texts.append(text)
            for at in range(0, len(text) - LENGTH + 1, PIECE - LENGTH):
                part = text[at : at + PIECE - 1] if len(text) >= PIECE else text
                if size + len(part) > PIECE:
                    add(pending)
                    pending, size = [], 0
                    if out.n >= limit:
                        yield out
                        out = Buffer()
                        out.rows.append((doc_id, tag))
                        out.texts.append(text)
                pending.append((len(out.rows) - 1, part, at))
                size += len(part)
        if pending:
            add(pending)
    if out.n:
        yield out


def _dealt(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket (by the high bits of the key) and indices, in key order."""
    order = np.argsort(key, kind="stable")
    bucket = ((key[order] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def _same(*columns: np.ndarray) -> np.ndarray:
    """Whether each row but the first equals the one before."""
    out = columns[0][1:] == columns[0][:-1]
    for c in columns[1:]:
        out &= c[1:] == c[:-1]
    return out


BLOB = "bucket int, blob binary"


def _collect_keys(buckets: int, limit: int):
    """Texts to the distinct keys of each buffer by bucket, with the units of each and whether documents share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer in buffers(batches, limit):
            text, _, _, key, content = buffer.columns()
            ids = buffer.ids()[text]
            order = np.lexsort((content, key))
            key, content, ids = key[order], content[order], ids[order]
            first = np.r_[True, ~_same(key)]
            at = np.flatnonzero(first)
            several = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
            distinct = np.add.reduceat(np.r_[True, ~_same(key, content)].astype(np.int64), at)
            found = key[at]
            out = []
            for b, rows in _dealt(found, buckets):
                gaps = np.diff(found[rows], prepend=np.uint64(0))
                count = np.minimum(distinct[rows], 2**31 - 1).astype(np.uint32) * np.uint32(2) + several[rows]
                planes = gaps.view(np.uint8).reshape(-1, 8).T.tobytes() + count.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                out.append((b, _packed(planes)))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "blob"])
        release()

    return run


def _bits(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return key & np.uint64(bits - 1), (key >> np.uint64(20)) * STEPS[50] >> np.uint64(64 - bits.bit_length() + 1)


def _share_keys(most_bits: int, hot: int):
    """Keys, sorted by bucket, to a filter of each bucket's shared keys, and its hot keys."""

    def close(bucket: int, keys: list, counts: list) -> tuple:
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order].astype(np.int64)
        at = np.flatnonzero(np.r_[True, ~_same(key)])
        seen = np.diff(np.r_[at, len(key)])
        shared = (seen > 1) | (np.maximum.reduceat(count & 1, at) > 0)
        total = np.add.reduceat(count >> 1, at)
        some = key[at][shared]
        bits = 64
        while bits < len(some) * KEY_BITS and bits < most_bits:
            bits *= 2
        table = np.zeros(bits, np.uint8)
        for p in _bits(some, bits):
            table[p.astype(np.int64)] = 1
        return bucket, _packed(np.packbits(table, bitorder="little").tobytes()), key[at][shared & (total > hot)].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, out = None, [], [], []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and now is not None:
                    out.append(close(now, keys, counts))
                    keys, counts = [], []
                now = bucket
                planes = np.frombuffer(_unpacked(blob), np.uint8).reshape(12, -1)
                keys.append(np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel(), dtype=np.uint64))
                counts.append(np.ascontiguousarray(planes[8:].T).view("<u4").ravel())
        if now is not None:
            out.append(close(now, keys, counts))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "filter", "hot"])

    return run


#: Units of a bucket, or spans of a place (bucket: -1 - place), or (bucket null) spans of a document.
FOUND = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("blob", pa.binary())])
FOUND_DDL = "bucket int, doc_id long, tag long, blob binary"


def _merged(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans [start, stop) of documents, sorted, those that overlap or touch as one."""
    if not len(ids):
        return ids, tags, start, stop
    order = np.lexsort((start, tags, ids))
    ids, tags, start, stop = ids[order], tags[order], start[order], stop[order]
    shift = np.cumsum(np.r_[0, ~_same(ids, tags)]) << 40  # stops rise with the document, so one running maximum does for all
    reach = np.maximum.accumulate(stop + shift)
    at = np.flatnonzero(np.r_[True, (start + shift)[1:] > reach[:-1]])
    return ids[at], tags[at], start[at], (reach - shift)[np.r_[at[1:] - 1, len(ids) - 1]]


class Spans:
    """Spans of a task, given out as one row for each place, which is a hash of the document."""

    def __init__(self, places: int):
        self.places, self.parts, self.n = places, [], 0

    def add(self, ids, tags, start, stop) -> None:
        if len(ids):
            self.parts.append((ids, tags, start, stop))
            self.n += len(ids)

    def rows(self, least: int = 1) -> list[tuple]:
        """Rows of all spans so far, if there are that many."""
        if self.n < least:
            return []
        ids, tags, start, stop = _merged(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))
        self.parts, self.n = [], 0
        place = (_mixed(tags.view(np.uint64) ^ ids.view(np.uint64)) % np.uint64(self.places)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(self.places + 1))
        return [(-1 - p, None, None, _columns(*(c[order[cuts[p] : cuts[p + 1]]] for c in (ids, tags, start, stop)))) for p in np.flatnonzero(np.diff(cuts)).tolist()]


def _columns(*columns: np.ndarray) -> bytes:
    """64-bit columns, compressed by byte planes."""
    return _packed(b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns))


def _of_columns(blob: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(_unpacked(blob), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes]


def _of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of spans, sorted by place, to one row a document."""

    def close(blobs: list[bytes]) -> pa.RecordBatch:
        ids, tags, start, stop = _merged(*(np.concatenate(c) for c in zip(*[_of_columns(b, 4) for b in blobs], strict=True)))
        first = np.flatnonzero(np.r_[True, ~_same(ids, tags)])
        pairs = np.column_stack([start, stop]).astype("<i8")
        out = [(None, None if ids[a] == NO_ID else int(ids[a]), int(tags[a]), pairs[a:b].tobytes()) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True)]
        return _batch(out)

    now, blobs = None, []
    for batch in batches:
        for place, blob in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if place != now and blobs:
                yield close(blobs)
                blobs = []
            now = place
            blobs.append(blob)
    if blobs:
        yield close(blobs)
    release()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FOUND]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def _pack(ids, tags, starts, counts, keys, contents: list[bytes]) -> bytes:
    """Units with their contents."""
    head = np.array([len(ids)], "<i8").tobytes()
    numbers = b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in (ids, tags, starts, counts, keys.view(np.int64)))
    return head + _packed(numbers + b"".join(contents))


def _unpack(blob: bytes) -> tuple:
    n = int(np.frombuffer(blob[:8], "<i8")[0])
    data = _unpacked(blob[8:])
    planes = np.frombuffer(data, np.uint8, n * 40).reshape(5, 8, n)
    ids, tags, starts, counts, keys = (np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes)
    cuts = np.cumsum(counts + LENGTH - 1) + n * 40
    return ids, tags, starts, counts, keys.view(np.uint64), [data[a:b] for a, b in zip([n * 40, *cuts.tolist()], cuts.tolist(), strict=False)]


def _send_units(shared, buckets: int, limit: int, places: int):
    """Texts to their shared units by bucket, and to the spans that other texts of the buffer already settle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = hot = None
        settled = Spans(places)
        for buffer in buffers(batches, limit):
            if filters is None:
                filters = [np.frombuffer(_unpacked(f), np.uint8) if f else None for f in shared.value[0]]
                hot = np.frombuffer(b"".join(shared.value[1]), np.uint64)
            text, start, count, key, content = buffer.columns()
            keep = np.zeros(len(key), bool)
            for b, rows in _dealt(key, buckets):
                if filters[b] is not None:
                    one, two = (filters[b][p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) for p in _bits(key[rows], 8 * len(filters[b])))
                    keep[rows] = one & two & 1
            text, start, count, key, content = (c[keep] for c in (text, start, count, key, content))
            if len(hot) and (is_hot := np.isin(key, hot)).any():  # string by string, under the string's own hash
                n = count[is_hot]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                t, s = np.repeat(text[is_hot], n), np.repeat(start[is_hot], n) + inner
                own = np.array([zlib.crc32(buffer.texts[a][b : b + LENGTH]) * 0x100000001 for a, b in zip(t.tolist(), s.tolist(), strict=True)], np.uint64)
                own, twin = _mixed(own), np.array([hash(buffer.texts[a][b : b + LENGTH]) & (2**63 - 1) for a, b in zip(t.tolist(), s.tolist(), strict=True)], np.uint64)
                text, start = np.r_[text[~is_hot], t], np.r_[start[~is_hot], s]
                count, key, content = np.r_[count[~is_hot], np.ones(len(t), count.dtype)], np.r_[key[~is_hot], own], np.r_[content[~is_hot], twin]
            if not len(key):
                continue
            ids = buffer.ids()[text]
            order = np.lexsort((ids, content, key))
            text, start, count, key, content, ids = (c[order] for c in (text, start, count, key, content, ids))
            at = np.flatnonzero(np.r_[True, ~_same(key, content)])
            least = np.repeat(ids[at], np.diff(np.r_[at, len(key)]))
            goes = ids > least
            first = np.repeat(at, np.diff(np.r_[at, len(key)]))
            for i in np.flatnonzero(goes).tolist():  # two hashes are equal; are the bytes?
                f, n = int(first[i]), int(count[i]) + LENGTH - 1
                if count[f] != count[i] or buffer.texts[text[i]][start[i] : start[i] + n] != buffer.texts[text[f]][start[f] : start[f] + n]:
                    goes[i] = False
            tags = np.array([r[1] for r in buffer.rows], np.int64)[text]
            settled.add(ids[goes], tags[goes], start[goes], (start + count)[goes] + LENGTH - 1)
            out = settled.rows(SPANS)
            text, start, count, key, ids, tags = (c[~goes] for c in (text, start, count, key, ids, tags))
            for b, rows in _dealt(key, buckets):
                parts = [buffer.texts[t][s : s + c + LENGTH - 1] for t, s, c in zip(text[rows].tolist(), start[rows].tolist(), count[rows].tolist(), strict=True)]
                out.append((b, None, None, _pack(ids[rows], tags[rows], start[rows], count[rows], key[rows], parts)))
            for at in range(0, len(out), 256):
                yield _batch(out[at : at + 256])
        yield _batch(settled.rows())
        release()

    return run


def suffixes(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text of small numbers, sorted by their first LENGTH numbers at least; by doubling sorted prefixes."""
    n, there = len(text), np.zeros(int(text.max()) + 1, np.int64)
    there[text] = 1
    code = (np.cumsum(there) - 1)[text]  # 0 stays the smallest
    bits = max(1, int(there.sum() - 1).bit_length())
    size = 62 // bits
    packed = np.zeros(n, np.int64)
    for i in range(min(size, n)):
        packed[: n - i] += code[i:] << (bits * (size - 1 - i))
    while True:
        order = np.argsort(packed)
        if size >= LENGTH:
            return order
        ranked = packed[order]
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(np.r_[1, (ranked[1:] != ranked[:-1]).astype(np.int64)])
        packed = rank << 32
        packed[: max(0, n - size)] |= rank[size:]
        size *= 2


def long_prefixes(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each sorted suffix, whether its common prefix with the one before is length or more; 0 separates texts.

    Breadth-first backward extension: at each level the intervals of strings of that length whose right end had no
    common prefix set yet; a level sets the prefixes of its value. Strings never hold a separator, so a prefix that
    would run over one may stay unset too: the caller looks at suffixes of length bytes or more only.
    """
    n = len(text)
    before = text[order - 1]  # the transform; the text begins with a separator
    step = np.empty(n, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    first = text[order]
    unset = np.ones(n + 1, bool)
    live, owner = np.arange(n), np.zeros(n, np.int64)
    for _ in range(length):
        inner = before[live] > 0
        at = step[live[inner]]
        owner = owner[inner]
        if not len(at):
            break
        if len(at) * 8 > n:
            held = np.full(n, -1)
            held[at] = owner
            at = np.flatnonzero(held >= 0)
            owner = held[at]
        else:
            by = np.argsort(at)
            at, owner = at[by], owner[by]
        new = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]) | (first[at[1:]] != first[at[:-1]])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(at)])
        ends = at[starts] + sizes
        fresh = unset[ends]
        unset[ends[fresh]] = False
        stay = np.repeat(fresh, sizes)
        live, owner = at[stay], np.repeat(np.arange(len(starts)), sizes)[stay]
    unset[0] = False
    return unset[:n]


def smaller_elsewhere(contents: list[bytes], ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Content and start, in order, of the strings of length bytes that a content with a smaller id holds too."""
    sizes = np.array([len(c) for c in contents])
    flat = np.frombuffer(b"".join(contents), np.uint8)
    firsts = np.cumsum(sizes + 1) - sizes  # each content follows a separator
    text = np.zeros(int((sizes + 1).sum()) + 1, np.int16)
    owner = np.repeat(np.arange(len(contents)), sizes)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = firsts[owner] + offset
    text[place] = flat.astype(np.int16) + 1
    order = suffixes(text)
    same = long_prefixes(text, order, length)
    valid = np.zeros(len(text), bool)
    valid[place] = offset <= sizes[owner] - length
    who, where = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    who[place], where[place] = owner, offset
    rows = valid[order]
    group = np.cumsum(~(same & rows & np.r_[False, rows[:-1]]))[rows]
    chosen = order[rows]
    if not len(chosen):
        return chosen, chosen
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    own = ids[who[chosen]]
    least = np.repeat(np.minimum.reduceat(own, at), np.diff(np.r_[at, len(group)]))
    hit = chosen[least < own]
    hit.sort()
    return who[hit], where[hit]


def _settle(text_bytes: int, places: int):
    """Units, sorted by bucket, to the spans that go; rows of spans are passed on."""

    def close(blobs: list[bytes], out: Spans) -> None:
        ids, tags, starts, counts, keys, contents = zip(*map(_unpack, blobs), strict=True)
        ids, tags, starts, counts, keys = (np.concatenate(c) for c in (ids, tags, starts, counts, keys))
        contents = [x for part in contents for x in part]
        order = sorted(range(len(contents)), key=lambda i: (int(keys[i]), contents[i], int(ids[i])))
        whole: list[int] = []  # units that go
        spans: list[np.ndarray] = []  # unit, start, stop in the document
        texts, owners, owner_ids, size = [], [], [], 0

        def expand() -> None:
            nonlocal texts, owners, owner_ids, size
            if len(texts) > 1:
                who, where = smaller_elsewhere(texts, np.array(owner_ids, np.int64))
                at = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (where[1:] != where[:-1] + 1)]) if len(who) else who
                lo, hi, content = where[at], where[np.r_[at[1:] - 1, len(who) - 1]] + LENGTH if len(at) else at, who[at]
                n = np.array([len(m) for m in owners])
                flat, first = np.array([u for m in owners for u in m], np.int64), np.cumsum(n) - n
                copies = n[content]
                inner = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                unit = flat[np.repeat(first[content], copies) + inner]
                spans.append(np.column_stack([unit, starts[unit] + np.repeat(lo, copies), starts[unit] + np.repeat(hi, copies)]))
            texts, owners, owner_ids, size = [], [], [], 0

        i = 0
        while i < len(order):
            j, groups = i, []  # distinct contents of a key: the units of the smallest document
            while j < len(order) and keys[order[j]] == keys[order[i]]:
                content, least, members = contents[order[j]], ids[order[j]], []
                while j < len(order) and keys[order[j]] == keys[order[i]] and contents[order[j]] == content:
                    u = order[j]
                    if ids[u] > least:
                        whole.append(u)
                    else:
                        members.append(u)
                    j += 1
                groups.append((content, least, members))
            if len({g[1] for g in groups}) > 1:
                for content, least, members in groups:
                    texts.append(content)
                    owners.append(members)
                    owner_ids.append(least)
                    size += len(content) + 1
                if size >= text_bytes:
                    expand()
            i = j
        expand()
        u = np.array(whole, np.int64)
        found = np.concatenate([np.column_stack([u, starts[u], starts[u] + counts[u] + LENGTH - 1]), *spans])
        u = found[:, 0]
        out.add(ids[u], tags[u], found[:, 1], found[:, 2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, out = None, [], Spans(places)
        for whole in batches:
            settled = pc.less(whole.column(0), 0)
            yield whole.filter(settled)
            batch = whole.filter(pc.invert(settled))
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if bucket != now and blobs:
                    close(blobs, out)
                    yield _batch(out.rows(SPANS))
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            close(blobs, out)
        yield _batch(out.rows())
        release()

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def buckets_for(size: int) -> int:
    """Buckets of keys for so many bytes of input: in proportion up to 128 GiB, with their root beyond.

    Each buffer sends each bucket a row, so the number can't grow on in proportion.
    """
    return max(16, min(size // BUCKET_BYTES, math.isqrt(size >> 5)))


def repeated_spans(docs: DataFrame, buffer: int = BUFFER, buckets: int | None = None, hot: int = HOT, text_bytes: int = TEXT) -> DataFrame:
    """doc_id, tag, blob: spans [start, stop) of bytes that go, as pairs of 64-bit numbers; one row a document."""
    spark, texts = docs.sparkSession, _texts(docs)
    size = input_bytes(docs)
    buckets, hot = buckets or buckets_for(size), max(hot, size >> 24)
    keys = texts.mapInArrow(_collect_keys(buckets, buffer), BLOB).repartition("bucket").sortWithinPartitions("bucket")
    # MOST_BITS in all, and 8 bytes for each hot key: a unit has about 12 bytes of input, so they are 1.4 million at most
    with batches_of(spark, ROWS), cleaning(spark):
        rows = keys.mapInArrow(_share_keys(max(64, 1 << (MOST_BITS // buckets).bit_length() - 1), hot), "bucket int, filter binary, hot binary").collect()
    filters = {r.bucket: bytes(r.filter) for r in rows}
    shared = spark.sparkContext.broadcast(([filters.get(b) for b in range(buckets)], [bytes(r.hot) for r in rows]))
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.mapInArrow(_send_units(shared, buckets, buffer, places), FOUND_DDL).repartition("bucket").sortWithinPartitions("bucket")
    settled = sent.mapInArrow(_settle(text_bytes, places), FOUND_DDL).repartition("bucket").sortWithinPartitions("bucket")
    with batches_of(spark, ROWS):
        return written(settled.mapInArrow(_of_documents, FOUND_DDL).select("doc_id", "tag", "blob"), "repeat-spans")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
        n_bytes, removed, runs, kept = [], [], [], []
        for text, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n_bytes.append(len(text))
            pairs = np.frombuffer(blob or b"", "<i8").reshape(-1, 2).tolist()
            at, parts, n = 0, [], 0
            for a, b in pairs:
                parts.append(text[at:a])
                n += b - a
                at = b
            runs.append(len(pairs))
            parts.append(text[at:])
            removed.append(n)
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def deduplicate(docs: DataFrame, **settings: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes left) of every row of docs.

    Texts are UTF-8 bytes, null as empty, long ones read whole; an empty table gives no rows. Rows that repeat a doc_id are
    one document and don't empty each other. A
    null doc_id is larger than any other: such rows lose what identified documents hold, and nothing is lost to
    them. Strings are judged on the input. Other columns are ignored.
    """
    spans = repeated_spans(docs, **settings).select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "blob")
    rows = _texts(docs).join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    return rows.select("doc_id", "text", "blob").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
