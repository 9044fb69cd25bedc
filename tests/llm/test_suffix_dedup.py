import random
from hashlib import sha256

import numpy as np
import pytest
from cases import frame

from kvstrata.llm import catalog, suffix_dedup


def brute(rows, length=50):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    key = lambda i: suffix_dedup.NO_ID if i is None else i
    first = {}
    for i, t in texts:
        for j in range(len(t) - length + 1):
            g = t[j : j + length]
            first[g] = min(first.get(g, suffix_dedup.NO_ID), key(i))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for j in range(len(t) - length + 1):
            if first[t[j : j + length]] < key(i):
                gone[j : j + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])))
    return sorted(out, key=str)


def as_rows(got):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=str)


@pytest.mark.parametrize("settings", [{}, {"buffer": 50, "buckets": 3, "hot": 1, "text_bytes": 1}])
def test_edges(edge, settings):
    docs, rows = edge
    rows = [(i, t[:3000] if t and len(t) > 50_000 and i == 41 else t, s) for i, t, s in rows]
    docs = frame(docs.sparkSession, rows).repartition(3)
    assert as_rows(suffix_dedup.deduplicate(docs, **settings)) == brute(rows)


def test_empty(nothing):
    assert suffix_dedup.deduplicate(nothing).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_brute_force(spark, seed, monkeypatch):
    r = random.Random(seed)
    letters = "ab" if seed else "abcdefgh é\x00"
    pool = ["".join(r.choice(letters) for _ in range(r.randint(40, 200))) for _ in range(5)]
    rows = [(r.randint(0, 30), "".join(r.choice([r.choice(pool), r.choice(pool)[r.randint(0, 30) :], "".join(r.choice(letters) for _ in range(20))]) for _ in range(r.randint(0, 5))), "s") for _ in range(40)]
    assert as_rows(suffix_dedup.deduplicate(frame(spark, rows).repartition(4), buffer=100, buckets=4)) == brute(rows)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in catalog.table(spark, sf_dir, "documents").collect()]
    got = catalog.op9_suffix_dedup(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, n, m, s, sha256(k).hexdigest()) for i, n, m, s, k in brute(docs)), key=str)


def test_pieces_of_long_texts():
    """A text longer than a piece gives the same units' strings as one that isn't cut."""
    r = np.random.default_rng(1)
    text = bytes(r.integers(97, 100, suffix_dedup.PIECE * 2 + 777, np.uint8))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text], pa.binary())], ["doc_id", "tag", "text"])
    starts = []
    for buffer in suffix_dedup.buffers(iter([batch]), 5000):
        _, start, count, _, _ = buffer.columns()
        starts += [x for s, c in zip(start.tolist(), count.tolist(), strict=True) for x in range(s, s + c)]
    assert sorted(starts) == list(range(len(text) - 49))


def test_long_prefixes_against_sorting():
    for seed in range(50):
        r = random.Random(seed)
        parts = [bytes(r.choice(b"abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 6))]
        ids = np.array([r.randint(0, 4) for _ in parts])
        who, where = suffix_dedup.smaller_elsewhere(parts, ids, 5)
        expected = [(i, j) for i, p in enumerate(parts) for j in range(len(p) - 4) if any(p[j : j + 5] in q and ids[k] < ids[i] for k, q in enumerate(parts))]
        assert list(zip(who.tolist(), where.tolist(), strict=True)) == expected
