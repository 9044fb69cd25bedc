from hashlib import sha256

import public_tokenizers
import pytest

from kvstrata.llm import bpe, catalog

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", None, "a b  c\t\nd", "<|endoftext|> x<|startoftext|>y<|endoftext|>", "don't I'LL we've 12345 é́ é ", " nbsp em　x\x1cy\x85z q", "İstanbul ΣΑΣ ς ﬁ Å Å",
        "日本語テキスト 한국어 \U0001f600\U0001f469‍\U0001f4bb", "a" * 5000, "x\x00y \x7f", "́ lead ́", "'s 's't 're", "﻿bom ​ zw", "½ ² Ⅷ ٣", "\x0b\x0c vt"]


def library(text):
    coder = bpe.tokenizer(bpe.read_spec(PATH))
    ids = coder.encode(text or "", add_special_tokens=False).ids
    return ids, coder.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("chunk, buckets", [(3, 5), (10_000, None)])
def test_equals_the_library(spark, edge, chunk, buckets):
    docs, rows = edge
    texts = [(i, t) for i, t, _ in rows] + [(100 + i, t) for i, t in enumerate(HARD)]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, ids string, words string").repartition(3)
    got = bpe.decode(bpe.encode(frame, PATH, chunk, buckets), PATH).collect()
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in got), key=str) == sorted(((i, *library(t)) for i, t in texts), key=str)


def test_digests_of_all_documents(spark, sf_dir):
    got = {r.doc_id: tuple(r)[1:] for r in catalog.op6_bpe(spark, sf_dir).collect()}
    docs = catalog.table(spark, sf_dir, "documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids, text = library(r.text)
        assert got[r.doc_id] == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest())


def test_each_distinct_word_is_encoded_once():
    """A bucket with two chunks' words gives the coder only those that it hasn't seen."""
    import pyarrow as pa

    seen = []

    class Spec:
        value = b""

    def coder(_):
        import numpy as np

        return lambda words: (seen.extend(words), (np.ones(len(words), np.int64), np.arange(len(words))))[1]

    was, bpe._coder = bpe._coder, coder
    try:
        import zlib

        import numpy as np

        rows = [(-1, c, None, zlib.compress(w), bpe._plain(np.arange(w.count(b"\n") + 1))) for c, w in ((0, b"a\nb"), (1, b"b\nc"), (2, b"a\nc"))]
        out = [r for b in bpe._encode(Spec)(iter([bpe._rows(rows)])) for r in b.to_pylist()]
    finally:
        bpe._coder = was
    assert seen == ["a", "b", "c"] and len(out) == 3 and pa.__version__


def test_decode_leaves_unknown_ids_out(spark):
    rows = spark.createDataFrame([(1, [0, None, 10**6, -1, 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    pieces = bpe._pieces(bpe.read_spec(PATH))
    assert [r.text for r in bpe.decode(rows, PATH).orderBy("doc_id").collect()] == [f"{pieces[0]} {pieces[1]}", "", ""]


def test_empty(nothing):
    assert bpe.digests(nothing, PATH).collect() == []


def test_chunks_end_by_bytes_too(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "CHUNK_BYTES", 100)
    texts = ["x" * n for n in (10, 30, 500, 0, 60, 50, 40, 9)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["doc_id", "text"])
    parts = list(bpe._chunks(batch, 4))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or (p.num_rows <= 4 and sum(len(t or "") for t in p.column(1).to_pylist()) <= 100) for p in parts)
    assert [bpe.buckets_for(n) for n in (0, 2**36, 2**48)] == [16, 8192, 2**19]


def test_splitting_holds_little_beside_a_chunk(monkeypatch):
    """A chunk's words are split in parts, and the rows are those of one part."""
    import random
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    r = random.Random(2)
    texts = [" ".join(f"w{int(r.paretovariate(0.7)) % 20000}" for _ in range(1000)) for _ in range(1500)] + [None, "", " \t "]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    def split():
        was = pa.default_memory_pool()
        pool = pa.proxy_memory_pool(was)
        pa.set_memory_pool(pool)
        try:
            rows = [tuple(x) for part in bpe._split(4, 8000)(iter([batch])) for x in zip(*[c.to_pylist() for c in part.columns], strict=True)]
        finally:
            pa.set_memory_pool(was)
        return rows, pool.max_memory()

    rows, peak = split()
    assert peak < 2.5 * batch.nbytes, peak / batch.nbytes
    monkeypatch.setattr(bpe, "PART_BYTES", 1 << 30, raising=False)
    assert split()[0] == rows and len(rows) == len(texts) + 4


def test_chunks_reach_across_batches(monkeypatch):
    """Few texts at once make the same rows as all of them: a batch was a chunk of its own."""
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": [None, ""] + [f"a{i % 7} b{i} c" for i in range(58)]})
    split = lambda batches: sorted((tuple(x) for part in bpe._split(3, 25)(iter(batches)) for x in zip(*[c.to_pylist() for c in part.columns], strict=True)), key=str)
    rows = split([whole])
    assert len({r[1] for r in rows}) == 3 and split([whole.slice(i, 5) for i in range(0, 60, 5)]) == rows
