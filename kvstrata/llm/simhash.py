"""Operator 10: SimHash near-duplicates, linked by BK-trees.

Fingerprints are 64-bit majorities over the XXH64 hashes (seed 42) of word shingles. Two fingerprints that
differ in at most ``radius`` of their 64 bits agree on at least ``blocks - radius`` of ``blocks`` bit blocks,
so every link lies inside a shard (which blocks, their bits). Each shard is a BK-tree: a child hangs on the edge
numbered by its Hamming distance to the parent, hence a query at distance k of a node follows only the edges
k - radius .. k + radius. As only connectivity is asked for, an edge whose whole subtree is known to lie in the
query's component is not followed either: that keeps dense groups of near copies out of the all-pairs regime.

Trees aren't sent through the driver (it must not hold the fingerprints): a shard's rows are shuffled to the task
that builds the tree. A shard of more than ``tree_size`` fingerprints becomes several trees, and its
fingerprints are sent as queries to each of them, which is where a tree is shared among tasks.

Spanning links of all shards are joined into components by alternating large-star and small-star rounds, each
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, spread_join, text_tag, written

SEED = 42
#: Shingles whose bits are counted at once, and texts that are Python objects at once.
CHUNK, TEXTS = 1 << 15, 1024


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of one text, as an unsigned 64-bit number; 0 for a text without words."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    n = max(1, len(parts) - words + 1)
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, n)], starts[min(at + words, len(parts)) :], strict=False)
        data = b"".join([digest(line[a : b - 1], SEED) for a, b in spans])
        counts += np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, tag (a hash of the text, which tells rows of one doc_id apart) and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            fps = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "tag", "fp"])
        release()

    return docs.select(F.col("doc_id").cast("long"), text_tag(docs), F.col("text").cast("string")).mapInArrow(run, "doc_id long, tag long, fp long")


class Tree:
    """A BK-tree over fingerprints that keeps components of those within the radius of each other."""

    def __init__(self, radius: int):
        self.radius, self.keys, self.edges, self.up = radius, [], [], []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def add(self, key: int) -> None:
        """Insert key, joined with every component that has a key within the radius."""
        me = len(self.keys)
        self.up.append(me)
        if me:
            self.search(key, me)
            at = 0
            while (d := (key ^ self.keys[at]).bit_count()) in self.edges[at]:
                at = self.edges[at][d]
            self.edges[at][d] = me
        self.keys.append(key)
        self.edges.append({})

    def search(self, key: int, me: int) -> None:
        """Join me with what lies within the radius of key.

        All below edge e of a node have distance e to it. So the subtrees at edges up to the radius belong to the
        node's component: they are not followed if me is in it, and left at the first hit otherwise (one).
        """
        r, keys, edges, root = self.radius, self.keys, self.edges, self.root
        todo = [(0, -1)]  # node, and the node whose component all of its subtree is in
        while todo:
            at, all_in = todo.pop()
            if all_in >= 0 and root(all_in) == root(me):
                continue
            d = (key ^ keys[at]).bit_count()
            if d <= r:
                self.join(at, me)
            for e, child in edges[at].items():
                if d - r <= e <= d + r:
                    todo.append((child, at if e <= r else all_in))


def _shard_links(radius: int):
    """Rows sorted by (shard, tree, query) to spanning links (a, b) of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, ids, out = None, None, [], []

        def links():
            for i in range(len(ids)):
                if ids[tree.root(i)] != ids[i]:
                    out.append((ids[i], ids[tree.root(i)]))

        for batch in batches:
            rows = [batch.column(i).to_pylist() for i in range(4)]
            for shard, part, query, fp in zip(*rows, strict=True):
                if (shard, part) != now:
                    if tree and len(ids) > 1:
                        links()
                    now, tree, ids = (shard, part), Tree(radius), []
                key = fp & 0xFFFFFFFFFFFFFFFF
                if not query:
                    tree.add(key)
                    ids.append(fp)
                elif ids:  # a query of another tree of this shard: joined, but not inserted
                    me = len(tree.up)
                    tree.up.append(me)
                    tree.search(key, me)
                    hit = tree.root(me)
                    if hit != me:
                        out.append((fp, ids[hit]))
                    tree.up.pop()  # never a parent, as roots have the smallest index
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]}, SCHEMA)
                out.clear()
        if tree and len(ids) > 1:
            links()
        if out:
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]}, SCHEMA)

    return run


SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def blocks_for(n: int, radius: int) -> int:
    """Blocks of the 64 bits: more of them when there are more fingerprints, so that shards stay small."""
    blocks = radius + 1
    while n / 2 ** (64 * (blocks - radius) / blocks) > 256 and blocks < radius + 4:
        blocks += 1
    return blocks


def shards(nodes: DataFrame, radius: int, blocks: int, tree_size: int) -> DataFrame:
    """(shard, tree, query, fp): each fingerprint once for each choice of blocks - radius agreeing blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum((2**64 - 2**edges[i]) & (2 ** edges[i + 1] - 1) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)])
    rows = nodes.select("fp", F.explode(keys).alias("shard"))
    large = rows.groupBy("shard").count().where(F.col("count") > tree_size).select(F.col("shard").alias("big"), F.ceil(F.col("count") / tree_size).cast("int").alias("trees"))
    rows = rows.join(large, F.col("shard") == F.col("big"), "left").drop("big")
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    rows = rows.withColumn("own", F.coalesce(own, F.lit(0)))
    # a pair of two trees meets in the tree of the smaller number
    return rows.select(F.xxhash64("shard.which", "shard.bits").alias("shard"), F.explode(F.sequence(F.lit(0), "own")).alias("tree"), "own", "fp").select("shard", "tree", (F.col("tree") != F.col("own")).alias("query"), "fp")


def links(nodes: DataFrame, radius: int = 4, tree_size: int = 20_000) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints fp that differ in at most radius bits."""
    rows = shards(nodes, radius, blocks_for(nodes.count(), radius), tree_size)
    rows = rows.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "query", "fp")
    return rows.mapInArrow(_shard_links(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge; alternating large and small stars.

    Rounds go on until nothing changes. The centre of a large star may hold most edges: see spread_join().
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    seen = state(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree")), "least")
        large = spread_join(both.where("b > a"), least, ["a"], "degree", 2 * seen[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = written(star, "edges")
        was, seen = seen, state(new)
        discard(spark, now, least)
        now = new
        if seen == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def classes(docs: DataFrame, words: int = 4, radius: int = 4, tree_size: int = 20_000) -> DataFrame:
    """doc_id, tag, fp, root of every row: rows with equal root are near-duplicates of one another.

    Equal fingerprints are one node, so copies never become pairs.
    """
    prints = written(fingerprints(docs, words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.count("*").alias("rows")), "nodes")
    found = components(links(nodes, radius, tree_size))
    rooted = written(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root"), "rows"), "rooted")
    return spread_join(prints, rooted, ["fp"], "rows", prints.count()).select("doc_id", "tag", "fp", "root")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, tree_size: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of every row.

    Empty and null texts have fingerprint zero. Rows with a null doc_id link others through their fingerprint but name
    no component, so the id of a component of such rows only is null. Repeated rows are returned as often as they
    occur, texts are read whole, however long, and an empty table gives no rows; other columns are ignored.
    """
    rows = written(classes(docs, words, radius, tree_size), "classes")
    ids = written(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")), "components")
    return spread_join(rows, ids, ["root"], "rows", rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
