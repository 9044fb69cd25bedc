import random

import numpy as np
import pytest
import xxhash
from cases import frame

from kvstrata.llm import catalog, simhash


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    counts = [0] * 64
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def groups(keys, radius):
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (keys[i] ^ keys[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(keys))]


def brute(rows):
    keys = [plain_fingerprint(t) for _, t, *_ in rows]
    part = groups(keys, 4)
    least = {}
    for (i, *_), p in zip(rows, part, strict=True):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    return sorted(((i, f"{k:016x}", least.get(p)) for (i, *_), k, p in zip(rows, keys, part, strict=True)), key=str)


def near_keys(r, n):
    """Chains and dense clusters of fingerprints."""
    out = [r.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        out.append(r.choice(out[-20:]) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("seed", range(20))
def test_tree_components(seed):
    r = random.Random(seed)
    keys = near_keys(r, 150)
    tree = simhash.Tree(4)
    for k in keys:
        tree.add(k)
    assert [tree.root(i) for i in range(len(keys))] == groups(keys, 4)


@pytest.mark.parametrize("tree_size", [7, 20_000])
@pytest.mark.parametrize("blocks", [5, 6])
def test_links_and_components(spark, tree_size, blocks, monkeypatch):
    """Small trees share a shard's queries; any number of blocks loses no link."""
    monkeypatch.setattr(simhash, "blocks_for", lambda n, radius: blocks)
    keys = near_keys(random.Random(blocks), 200)
    signed = [int(np.uint64(k).astype(np.int64)) for k in keys]
    nodes = spark.createDataFrame([(k,) for k in signed], "fp long")
    found = {r.node: r.component for r in simhash.components(simhash.links(nodes, 4, tree_size)).collect()}
    part = groups(keys, 4)
    for i, k in enumerate(signed):
        members = [signed[j] for j in range(len(keys)) if part[j] == part[i]]
        assert found.get(k, k) == min(members)


def test_edges(edge, nothing):
    docs, rows = edge
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == brute(rows)
    assert simhash.near_duplicates(nothing).collect() == []


def test_long_texts_in_chunks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in catalog.table(spark, sf_dir, "documents").collect()]
    assert sorted((tuple(r) for r in catalog.op10_simhash(spark, sf_dir).collect()), key=str) == brute(docs)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_frame_columns_are_not_needed(spark):
    assert simhash.near_duplicates(frame(spark, [(1, "a", "s")])).columns == ["doc_id", "fingerprint", "component_id"]
