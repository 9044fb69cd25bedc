"""Operator 2: exact top-k inner products over norm-sorted blocks with SVD-rotated partial sums.

Vectors are cut into blocks by descending length. Each query first gets a lower bound of its k-th score from a small
set of seeds (the longest vectors and a fixed sample). It is sent only to the blocks whose longest vector could still
reach that bound (Cauchy-Schwarz: |q| |c|). Inside a block, vectors are taken in runs of descending length. A rotation
by the singular vectors of a sample puts most of the length into the first dimensions. Partial sums over more and more
of them (HEADS), each plus the product of the two residual lengths, bound the score: after each head only pairs whose
bound reaches the query's current k-th score go on, and only what passes all heads gets its exact integer score. Bounds
carry a margin over rounding errors, so nothing is lost.

The rotation and the seeds come from bounded samples and only decide how much is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE, K, EVERY = 64, 20, 20
#: Vectors of a block, of the sample for the rotation, and of the longest as seeds.
BLOCK, SAMPLE, LONGEST = 8192, 8192, 2048
#: Cuts by length at most; with more vectors each block is dealt into parts, so that no task grows.
MOST_BLOCKS = 1000
#: Vectors of a run inside a block, queries bounded at once, pairs scored at once.
RUN, QUERIES, PAIRS = 1024, 512, 1 << 16
#: Shares of the dimensions after which partial sums are bounded.
HEADS = (0.25, 0.5, 0.625, 0.75, 0.875)


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, vec (floor of scale times each component, a whole number in a double), norm of the vectors that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * scale) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~bad)
    # floor() of a double is a long; beyond 2^53 doubles are whole numbers anyway
    whole = F.transform(x, lambda v: F.when(F.abs(v.cast("double") * scale) < 2.0**53, F.floor(v.cast("double") * scale).cast("double")).otherwise(v.cast("double") * scale))
    out = good.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vec"))
    return out.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)))


def _matrix(vectors: list, dim: int) -> np.ndarray:
    """Rows of equal length dim; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact_in_doubles(q: np.ndarray, c: np.ndarray) -> bool:
    """Are all sums of products of whole numbers of q and c exact in doubles?"""
    return not (q.size and c.size) or np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2**53


def _long(scores: list[int]) -> np.ndarray:
    if any(not -(2**63) <= s < 2**63 for s in scores):
        raise OverflowError("an inner product is beyond a long")
    return np.array(scores, np.int64)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of q with all rows of c; OverflowError where one is beyond a long."""
    if _exact_in_doubles(q, c):
        return np.rint(q @ c.T).astype(np.int64)
    one, two = ([[int(x) for x in row] for row in m.tolist()] for m in (q, c))
    return np.array([_long([sum(map(mul, a, b)) for b in two]) for a in one], np.int64).reshape(len(q), len(c))


def _pair_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of q with those of c one by one."""
    if _exact_in_doubles(q, c):
        return np.rint(np.einsum("ij,ij->i", q, c)).astype(np.int64)
    return _long([sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for a, b in zip(q.tolist(), c.tolist(), strict=True)])


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        cut = np.partition(scores, -k)[-k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))


def _send(seeds, ceilings, parts, dim: int, k: int, counts):
    """Queries to (block, part, query, id, vec, norm, bound) for each block that may hold one of their k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = seeds.value
        tops, dealt = ceilings.value, parts.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                piece = batch.slice(at, QUERIES)
                q_ids, q_vecs, norms = np.array(piece.column(0).to_pylist(), np.int64), piece.column(1).to_pylist(), np.array(piece.column(2).to_pylist())
                scores = _scores(_matrix(q_vecs, dim), vectors)
                out = []
                for i, q in enumerate(q_ids):
                    own = scores[i][ids != q]
                    bound = int(np.partition(own, -k)[-k]) if len(own) >= k else -(2**63)
                    reach = norms[i] * tops * (1 + 1e-9) + 1e-6 >= bound
                    for b in np.flatnonzero(reach).tolist():
                        out += [(b, p, True, int(q), q_vecs[i], float(norms[i]), bound) for p in range(dealt[b])]
                if counts:
                    counts["queries"].add(len(q_ids))
                    counts["sent"].add(len(out))
                yield _rows(out)

    return run


DDL = "block int, part int, query boolean, vec_id long, vec array<double>, norm double, bound long"
FIELDS = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("query", pa.bool_()), ("vec_id", pa.int64()), ("vec", pa.list_(pa.float64())), ("norm", pa.float64()), ("bound", pa.int64())])
FOUND_DDL = "query_id long, vec_id long, score long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS)


def _tails(turned: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """The length of each row from each cut on; summed from the end, so that small ones are exact."""
    squares = np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1]
    return [np.sqrt(squares[:, c]) if c < turned.shape[1] else np.zeros(len(turned)) for c in cuts]


def _reaching(q: np.ndarray, q_tails: list, c: np.ndarray, c_tails: list, cuts: list[int], need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows whose partial sums plus residual lengths reach need[i] after each cut."""
    i, j = np.arange(len(q)), np.arange(len(c))
    sums, dense, lo = np.zeros((len(q), len(c))), True, 0
    for n, cut in enumerate(cuts):
        if dense:
            sums = sums + q[i, lo:cut] @ c[j, lo:cut].T
            near = sums + np.outer(q_tails[n][i], c_tails[n][j]) >= need[i][:, None]
            if near.mean() < 0.125:  # few pairs: one by one from here on
                dense, (a, b) = False, np.nonzero(near)
                i, j, sums = i[a], j[b], sums[a, b]
            elif n + 1 == len(cuts):
                a, b = np.nonzero(near)
                return i[a], j[b]
            else:
                a, b = near.any(axis=1), near.any(axis=0)
                if a.sum() * b.sum() < 0.5 * near.size:  # else the copy costs more than it saves
                    i, j, sums = i[a], j[b], sums[np.ix_(a, b)]
        else:
            sums = sums + np.einsum("ij,ij->i", q[i, lo:cut], c[j, lo:cut])
            near = sums + q_tails[n][i] * c_tails[n][j] >= need[i]
            i, j, sums = i[near], j[near], sums[near]
        if not len(i):
            return i, i
        lo = cut
    return i, j


def _search(rotation, dim: int, cuts: list[int], k: int, counts):
    """Rows sorted by block, part, vectors by descending norm, then queries: to the best k of each query in the block."""

    class Block:
        def __init__(self, ids, vectors, norms):
            self.ids, self.vectors, self.norms = np.array(ids, np.int64), _matrix(vectors, dim), np.array(norms)
            self.turned = self.vectors @ rotation.value
            self.tails = _tails(self.turned, cuts)

        def best(self, q_ids, q_vecs, q_norms, bounds):
            q, q_ids = _matrix(q_vecs, dim), np.array(q_ids, np.int64)
            turned = q @ rotation.value
            tails = _tails(turned, cuts)
            hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
            for at in range(0, len(self.ids), RUN):
                run = slice(at, at + RUN)
                margin = 1e-9 * q_norms * self.norms[at] + 1e-6
                alive = np.flatnonzero(q_norms * self.norms[at] + margin >= bounds)
                if not len(alive):
                    break  # lengths only fall from here
                vectors, ids = self.vectors[run], self.ids[run]
                i, j = _reaching(turned[alive], [t[alive] for t in tails], self.turned[run], [t[run] for t in self.tails], cuts, (bounds - margin)[alive])
                i = alive[i]
                if counts:
                    counts["pairs"].add(len(q_ids) * len(ids))
                    counts["scored"].add(len(i))
                scores = [_pair_scores(q[i[x : x + PAIRS]], vectors[j[x : x + PAIRS]]) for x in range(0, len(i), PAIRS)]
                exact = np.concatenate([np.zeros(0, np.int64), *scores])
                ok = (exact >= bounds[i]) & (ids[j] != q_ids[i])
                i, j, exact = i[ok], j[ok], exact[ok]
                by = np.argsort(i, kind="stable")
                i, j, exact = i[by], j[by], exact[by]
                firsts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else i
                for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(i)], strict=False):
                    n = int(i[a])
                    s, c = np.concatenate([hits[n][0], exact[a:b]]), np.concatenate([hits[n][1], ids[j[a:b]]])
                    top = _top(s, c, k)
                    hits[n] = s[top], c[top]
                    if len(top) == k:
                        bounds[n] = max(bounds[n], s[top[-1]])
            return hits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, pile = None, None, ([], [], [])
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            ends = [i for i in range(1, batch.num_rows) if columns[0][i] != columns[0][i - 1] or columns[1][i] != columns[1][i - 1] or columns[2][i] != columns[2][i - 1]]
            for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                if a == b:
                    continue
                key, query = (columns[0][a], columns[1][a]), columns[2][a]
                if key != now:
                    now, block, pile = key, None, ([], [], [])
                if not query:
                    for x, c in zip(pile, (3, 4, 5), strict=True):
                        x += columns[c][a:b]
                    continue
                if block is None:
                    block, pile = Block(*pile), ([], [], [])
                for x in range(a, b, QUERIES):
                    y = min(x + QUERIES, b)
                    q_ids = columns[3][x:y]
                    hits = block.best(q_ids, columns[4][x:y], np.array(columns[5][x:y]), np.array(columns[6][x:y], np.int64))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(np.array(q_ids, np.int64), [len(s) for s, _ in hits])),
                        pa.array(np.concatenate([c for _, c in hits])), pa.array(np.concatenate([s for s, _ in hits])),
                    ], ["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block_rows: int = BLOCK, heads: Sequence[float] = HEADS, counts: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each query, ties to smaller vec_id.

    Queries are the vectors whose vec_id is divisible by every. Vectors that are null or hold a null or non-finite
    component, and rows with a null vec_id, take no part; shorter vectors count as ending in zeros, empty ones as
    zeros. Rows that repeat a vec_id are candidates each, but one query (by their smallest vector), of which all rows
    with that id are its own. Scores are exact; one beyond a long raises. An empty table gives no rows. Other columns
    are ignored, long texts among them never read. counts, if given, gets accumulators: queries, sent (queries to
    blocks), pairs (in the blocks that they reach), scored (pairs of which the exact score was needed).
    """
    spark = rows.sparkSession
    vectors = written(quantised(rows, scale), "vectors")
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not shape.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, shape.dim)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).collect()
    longest = vectors.orderBy(F.desc("norm"), "vec_id", "vec").limit(LONGEST).collect()
    seeds = {(r.vec_id, tuple(r.vec)): r for r in [*sample, *longest]}
    seed_ids, seed_vectors = np.array([r.vec_id for r in seeds.values()], np.int64), _matrix([r.vec for r in seeds.values()], dim)
    some = _matrix([r.vec for r in sample], dim)
    turned = np.linalg.svd(some.T @ some)[2]  # the right singular vectors of the sample, largest first
    del some
    heads_at = sorted({min(dim, max(1, round(dim * h))) for h in heads})
    if counts is not None:
        counts |= {name: spark.sparkContext.accumulator(0) for name in ("queries", "sent", "pairs", "scored")}
    n_blocks = max(1, min(MOST_BLOCKS, shape.n // block_rows))
    cuts = sorted(set(vectors.approxQuantile("norm", [i / n_blocks for i in range(1, n_blocks)], 0.001)), reverse=True) if n_blocks > 1 else []
    cut_at = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    block = F.size(F.filter(cut_at, lambda c: F.col("norm") < c))
    placed = vectors.withColumn("block", block)
    sizes = {r.block: (r.n, r.top) for r in placed.groupBy("block").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    parts = [-(-sizes[b][0] // (2 * block_rows)) if b in sizes else 0 for b in range(len(cuts) + 1)]
    tops = np.array([sizes[b][1] if b in sizes else -1.0 for b in range(len(cuts) + 1)])
    # a block that ties in length made too large is dealt into parts
    part = F.pmod(F.xxhash64("vec_id", "vec"), F.greatest(F.element_at(F.array(*[F.lit(c) for c in parts]), F.col("block") + 1), F.lit(1))).cast("int")
    candidates = placed.select(F.col("block").cast("int"), part.alias("part"), F.lit(False).alias("query"), "vec_id", "vec", "norm", F.lit(0).cast("long").alias("bound"))
    queries = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vec", "norm")).alias("least")).select("vec_id", "least.vec", "least.norm")
    share = spark.sparkContext.broadcast
    sent = queries.mapInArrow(_send(share((seed_ids, seed_vectors)), share(tops), share(parts), dim, k, counts), DDL)
    both = candidates.unionByName(sent).repartition("block", "part").sortWithinPartitions("block", "part", "query", F.desc("norm"), "vec_id")
    found = both.mapInArrow(_search(share(turned.T), dim, heads_at, k, counts), FOUND_DDL)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
