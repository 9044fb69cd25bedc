"""Near copies for the pipeline: groups of texts linked by a Jaccard similarity of word shingles of at least ``least``.

SimHash over BK-trees (operator 10's, on this stage's shingles) finds the closest copies. Similarity 0.8 lies about 10
of 64 bits apart, often more, and no radius that wide can be searched by shards, so the other candidates come from
prefixes: of two texts of that similarity, each has one of the first n - ceil(least n) + 1 of its n shingles, in an order
that holds for all texts, in common with the other's. Nothing is lost by that. The order puts last what a sample finds
common, so lists of texts with a shingle stay short; which shingles those are changes the time, not the result.

All candidates are checked on the shingles themselves; those whose sketches (shingles counted in BINS bins) show that
too few can be shared are dropped before, which loses none either and spares moving their texts. Nor is any lost by their
places in a list: with the first shingle that two texts share, they share no more than either has from there on.

Lists of dense groups would be pairs in the square of their size. So rounds come first: links of SimHash, and those of
each text to heads of its lists in other groups, at most FEW a text and other heads in each round, for as long as a
tenth of them are near copies. Then all pairs of a list follow that these left in different groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import batches_of, discard, maybe_among, release, spread_join, text_tag, written

#: Words of a shingle and the similarity of near copies.
WORDS, LEAST = 5, 0.8
#: Bits of SimHash's links, candidates of a text in a round.
RADIUS, FEW = 4, 4
#: One text of so many is sampled for common shingles, of which so many are broadcast at most.
SAMPLED, COMMON = 32, 200_000
#: Texts that are Python objects at once.
TEXTS = 512
#: Bins of a sketch: with 256 of them pairs of some thousand shingles are told apart, in 256 bytes a text.
BINS = 256


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    """The word shingles of a text; a text of fewer words is one shingle, one without words has none."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    return {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def _hashes(text: str | None, words: int) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(s) for s in shingles(text, words)]), np.int64))


def similar(a: set, b: set, least: float) -> bool:
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def _prefix_length(n: int, least: float) -> int:
    """Shingles of n of which a text that similar has one; the rounding error of least * n never shortens it."""
    return n - int(np.ceil(least * n - 1e-9)) + 1


def _common(texts: DataFrame, words: int) -> np.ndarray:
    """Hashes that more than one sampled text has, the most common ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            found = [_hashes(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["shingle"])
        release()

    rows = texts.where(F.pmod("node", F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "shingle long")
    rows = rows.groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(COMMON)
    return np.array([r.shingle for r in rows.collect()], np.int64)


def _sketch(hashes: np.ndarray) -> bytes | None:
    """The shingles in each bin, a byte a bin; none where a count doesn't fit."""
    counts = np.bincount(hashes.view(np.uint64) % np.uint64(BINS), minlength=BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def postings(texts: DataFrame, words: int, least: float) -> DataFrame:
    """shingle, node, size, reach for the prefix of every text (node, text), and a row without shingle for its sketch.

    reach: the shingles of the text from this one on. Texts without words have no rows.
    """
    common = _common(texts, words)
    by_hash = np.argsort(common)
    sent = texts.sparkSession.sparkContext.broadcast((common[by_hash], -by_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            found, nodes, sizes, reaches, sketches = [], [], [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = _hashes(text, words)
                n = len(hashes)
                if not n:
                    continue
                sketches.append((node, n, _sketch(hashes)))
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    # rare ones by hash, then the common ones from the least to the most common
                    place = np.where(known[at] == hashes, rank[at] + len(known), -1)
                    hashes = hashes[np.argsort(place, kind="stable")]
                hashes = hashes[: _prefix_length(n, least)]
                found.append(hashes)
                nodes.append(np.full(len(hashes), node, np.int64))
                sizes.append(np.full(len(hashes), n, np.int64))
                reaches.append(n - np.arange(len(hashes)))
            if found:
                columns = [pa.array(np.concatenate(x)) for x in (found, nodes, sizes, reaches)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.binary())], POSTINGS)
                of, n, bins = zip(*sketches, strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(of), pa.int64()), pa.array(of, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(of), pa.int64()), pa.array(bins, pa.binary())], POSTINGS)
        release()

    return texts.select("node", "text").mapInArrow(run, "shingle long, node long, size long, reach long, bins binary")


POSTINGS = ["shingle", "node", "size", "reach", "bins"]


def _possible(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that may be similar enough: texts share at most the lesser count of each bin.

    A similarity of least needs least / (1 + least) of the sum of both sizes. Pairs with a text without sketch stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pc.and_(pc.is_valid(batch.column("x")), pc.is_valid(batch.column("y")))
            yield batch.filter(pc.invert(known)).select(["a", "b"])
            both = batch.filter(known)
            if both.num_rows:
                x, y = (np.frombuffer(b"".join(both.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("x", "y"))
                shared = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                sizes = both.column("size").to_numpy()
                yield both.filter(pa.array(shared * (1 + least) >= least * sizes - 1e-6)).select(["a", "b"])

    first = sketches.select(F.col("node").alias("a"), F.col("bins").alias("x"), F.col("size").alias("m"))
    second = sketches.select(F.col("node").alias("b"), F.col("bins").alias("y"), F.col("size").alias("n"))
    rows = pairs.select("a", "b").join(first, "a", "left").join(second, "b", "left")
    return rows.select("a", "b", "x", "y", (F.col("m") + F.col("n")).alias("size")).mapInArrow(run, "a long, b long")


def _checked(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) that are similar enough, by their shingles."""
    pairs = written(_possible(pairs, sketches, least), "possible")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            keep = [similar(shingles(x, words), shingles(y, words), least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    # only texts of some pair are moved
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct(), "nodes")
    some = maybe_among(texts, "node", nodes, "of")
    first = some.select(F.col("node").alias("a"), F.col("text").alias("x"))
    second = some.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _fits(x: str, y: str, least: float):
    """Whether texts with these sizes and reaches at a shingle can be similar, if it is the first one that they share.

    A similarity of least needs least / (1 + least) of the sum of both sizes; the lesser size is least of the other at least.
    """
    m, n = F.col(f"{x}size"), F.col(f"{y}size")
    enough = F.least(f"{x}reach", f"{y}reach") * (1 + least) >= least * (m + n) - 1e-6
    return enough & (F.least(m, n) >= least * F.greatest(m, n) - 1e-6)


def _asked(lists: DataFrame, turn: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (p, q) of texts with heads of their lists in other groups, at most FEW a text, and the lists of several groups.

    lists: shingle, node, size, reach, root. Heads have few shingles before their list's, as texts amid a dense group do;
    of equal ones each turn has others.
    """
    head = F.struct((1 - F.col("reach") / F.col("size")).alias("ahead"), F.xxhash64("shingle", "node", F.lit(turn)).alias("by"), "node", "size", "reach", "root")
    several = lists.groupBy("shingle").agg(F.count("*").alias("texts"), F.min(head).alias("head"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    several = written(several.select("shingle", "texts", "head"), "heads")
    rows = written(spread_join(lists, several, ["shingle"], "texts", lists.count()), "lists")
    pairs = rows.where((F.col("root") != F.col("head.root")) & _fits("", "head.", least)).select(F.col("node").alias("p"), F.col("head.node").alias("q"))
    few = pairs.groupBy("p").agg(F.slice(F.array_sort(F.collect_set("q")), 1, FEW).alias("qs"))
    return few.select("p", F.explode("qs").alias("q")), rows.drop("texts", "head")


def groups(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """doc_id, tag, root of every row: rows of equal root are near copies, or linked by near copies.

    Equal texts are one node, and texts without words are one group. Repeated rows are all returned.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag(docs), F.col("text").cast("string").alias("text"))
    texts = written(named.groupBy(F.col("tag").alias("node")).agg(F.first("text").alias("text")), "texts")
    with batches_of(spark, TEXTS):
        # SimHash: texts of one fingerprint, and the links of fingerprints; wordless texts all have fingerprint zero
        prints = written(simhash.fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), words).select(F.col("doc_id").alias("node"), "fp"), "prints")
        first = written(prints.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("rows")), "first")
        total = prints.count()
        equal = spread_join(prints, first, ["fp"], "rows", total).select(F.col("node").alias("p"), F.col("first").alias("q"))
        near = simhash.links(first, RADIUS)
        near = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("p")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("q")), "b").select("p", "q")
        # lists of texts with a shingle of their prefix in common
        every = written(postings(texts, words, least), "postings")
        sketches = written(every.where("shingle is null").select("node", "size", "bins"), "sketches")
        every = every.where("shingle is not null").drop("bins")
        often = written(every.groupBy("shingle").count().where("count > 1").select("shingle"), "often")
        lists = written(maybe_among(every, "shingle", often, "shingle"), "often-postings")  # few are in more than one text
        discard(spark, every)
        lists = lists.withColumn("root", F.col("node"))
        more, asked, links, turn = near.union(equal), [], [], 0
        while True:
            new, lists = _asked(lists, turn, least)
            asked.append(written(more.union(new).where("p <> q").select(*_ordered("p", "q")).distinct(), "pairs"))
            links.append(written(_checked(asked[-1], sketches, texts, words, least), "links"))
            # groups so far are stars, which new links join
            stars = [] if not turn else [roots.select(F.col("node").alias("a"), F.col("component").alias("b"))]
            roots = simhash.components(reduce(DataFrame.union, [*stars, links[-1]]))
            lists = lists.drop("root").join(roots, "node", "left").select("shingle", "node", "size", "reach", F.coalesce("component", "node").alias("root"))
            lists = written(lists, "rooted")
            more, turn = more.limit(0), turn + 1
            if links[-1].count() * 10 <= asked[-1].count():
                break
        # all pairs of a list that are in different groups so far
        open_ = lists.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
        # texts alike in all that _fits() reads, so that only pairs which fit are made
        parts = written(lists.join(open_, "shingle").groupBy("shingle", "root", "size", "reach").agg(F.collect_list("node").alias("nodes")), "parts")
        other = parts.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("root", "nodes", "size", "reach")])
        rest = parts.join(other, "shingle").where((F.col("root") < F.col("other_root")) & _fits("", "other_", least))
        rest = rest.select(F.explode("nodes").alias("x"), "other_nodes").select("x", F.explode("other_nodes").alias("y")).select(*_ordered("x", "y")).distinct()
        rest = written(rest.join(reduce(DataFrame.union, asked), ["a", "b"], "left_anti"), "rest")
        last = written(_checked(rest, sketches, texts, words, least), "links")
        roots = simhash.components(last.union(roots.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return named.select("doc_id", "tag").join(roots, F.col("tag") == F.col("node"), "left").select("doc_id", "tag", F.coalesce("component", "tag").alias("root"))
