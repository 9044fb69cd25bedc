"""Operator 4: classifier chains over toxicity categories.

Categories are predicted one after the other by logistic regressions. A later category's model gets the earlier
categories' probabilities as features; in training these are out-of-fold predictions, so that it learns how much to
trust them on texts that the earlier model hasn't seen.

Features of a text are its distinct words and their first letters (stems of inflected words), hashed. Each model
keeps the features whose counts in its own training rows tell the classes apart best and weighs them; a text's score
is the sum over its distinct words, divided by the root of their number. Whole texts are scored.

The fit uses at most SAMPLE labelled rows, those with the smallest hashes of doc_id, whatever the size of the corpus; it
runs in one task.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import release

#: Labelled rows that a chain is fitted on, folds, hashed features and those that a model keeps.
SAMPLE, FOLDS, BITS, KEPT = 8000, 3, 20, 6000
#: Texts that are Python objects at once, and words whose scores a task remembers.
TEXTS, WORDS = 1024, 300_000
#: Features of training rows that a step of the fit takes at once.
PART = 1 << 16
#: The limit over which a text is toxic is set by out-of-fold predictions (see limit_of), inside these bounds: classes
#: weigh alike in training, so it lies near 0.5, and few labels should not carry it far away.
LOWEST, HIGHEST = 0.45, 0.6
#: Lengths of the word beginnings that are features.
STEMS = (4, 5, 6)
RIDGE, STEPS = 1e-4, 300
#: A kept feature differs between the classes by so many standard errors at least.
LEAST = 3.2
WORD = re.compile(r"\w+")


class Model(NamedTuple):
    """A logistic regression: weights of hashed features, of earlier probabilities (as logits), and the bias."""

    weights: dict[int, float]
    earlier: tuple[float, ...]
    bias: float


def features(word: str) -> list[int]:
    """Hashed features of a word."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(b"=" + word.encode("utf-8", "replace")) & mask, *[zlib.crc32(b"^" + word[:n].encode("utf-8", "replace")) & mask for n in STEMS if len(word) >= n]]


def words(text: str | None) -> set[str]:
    """Distinct words of a text, in lower case."""
    return set(WORD.findall((text or "").lower()))


def text_features(text: str | None) -> tuple[np.ndarray, int]:
    """Distinct hashed features of a text, and its number of distinct words."""
    found = words(text)
    return np.unique(np.array([f for w in found for f in features(w)], np.int32)), len(found)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _summed(size: int, places: np.ndarray, weights: Callable[[slice], np.ndarray]) -> np.ndarray:
    """np.bincount(places, weights, size), part by part: each adds to the sums so far, so the order of additions is the same."""
    # the sums so far lie before the part's values
    bins, values = np.arange(size + PART), np.zeros(size + PART)
    for at in range(0, len(places), PART):
        part = slice(at, at + PART)
        end = size + len(places[part])
        bins[size:end], values[size:end] = places[part], weights(part)
        values[:size] = np.bincount(bins[:end], values[:end], size)
    return values[:size].copy()


def _counts(features: np.ndarray) -> np.ndarray:
    """How often each feature is there; np.bincount would copy all of them to a wider type."""
    out = np.zeros(1 << BITS, np.int32)
    for at in range(0, len(features), 16 * PART):
        out += np.bincount(features[at : at + 16 * PART], minlength=1 << BITS).astype(np.int32)
    return out


class _Rows:
    """Training rows: features in one flat array, their rows, and the scale of each row."""

    def __init__(self, rows: Sequence[tuple[np.ndarray, int]]):
        self.n = len(rows)
        self.feature = np.concatenate([np.zeros(0, np.int32), *[f for f, _ in rows]])
        often = (_counts(self.feature) >= 3)[self.feature]  # no model keeps rarer ones
        self.feature = self.feature[often]
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(f) for f, _ in rows])[often]
        self.scale = 1 / np.sqrt(np.maximum(1, np.array([n for _, n in rows], float)))

    def fit(self, y: np.ndarray, use: np.ndarray, earlier: np.ndarray) -> Model:
        """The model of y on the rows in use; earlier: logits of the earlier categories, a column each."""
        positive = y[use].sum()
        if not positive or positive == use.sum():
            # labels of one class tell nothing: none is found, or all stay undecided
            return Model({}, (0.0,) * earlier.shape[1], 0.0 if positive else -4.0)
        na, nb = positive, use.sum() - positive
        chosen = self._chosen(y, use, na, nb)
        column = np.full(1 << BITS, -1, np.int32)
        column[chosen] = np.arange(len(chosen))
        keep = use[self.row] & (column[self.feature] >= 0)
        order = (np.cumsum(use) - 1).astype(np.int32)
        rows, columns = order[self.row[keep]], column[self.feature[keep]]
        del column, keep
        value = self.scale[use]  # of each row
        dense, target, n = earlier[use], y[use].astype(float), int(use.sum())
        # classes weigh alike; the columns of x are the kept features, the earlier logits and a one
        weight = np.where(target > 0, 0.5 / na, 0.5 / nb)
        cut = len(chosen), len(chosen) + earlier.shape[1]
        dot = lambda w: _summed(n, rows, lambda x: value.take(rows[x]) * w.take(columns[x])) + dense @ w[cut[0] : cut[1]] + w[-1]
        back = lambda g: np.concatenate([_summed(len(chosen), columns, lambda x, scaled=value * g: scaled.take(rows[x])), dense.T @ g, [g.sum()]])
        ridge = np.full(cut[1] + 1, RIDGE)
        ridge[-1] = 0
        x = np.ones(cut[1] + 1)
        for _ in range(20):  # the largest curvature
            x = back(weight * dot(x / np.linalg.norm(x)))
        step = 1 / (0.3 * np.linalg.norm(x) + RIDGE)
        w = old = np.zeros(cut[1] + 1)
        t = 1.0
        for _ in range(STEPS):  # accelerated gradient steps
            g = weight * (1 / (1 + np.exp(-np.clip(dot(w), -30, 30))) - target)
            new = w - step * (back(g) + ridge * w)
            t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
            w, old = new + (last - 1) / t * (new - old), new
        pw, pv, pc = old[: cut[0]], old[cut[0] : cut[1]], old[-1]
        return Model(dict(zip(chosen.tolist(), pw.tolist(), strict=True)), tuple(pv.tolist()), float(pc))

    def _chosen(self, y: np.ndarray, use: np.ndarray, na: int, nb: int) -> np.ndarray:
        """The features that a model of y on the rows in use keeps, in order; na, nb: its rows of either class."""
        a, b = (_counts(self.feature[(use & side)[self.row]]).astype(float) for side in (y.astype(bool), ~y.astype(bool)))
        pa_, pb = (a + 0.5) / (na + 1), (b + 0.5) / (nb + 1)
        z = np.abs(np.log(pa_ / (1 - pa_ + 1e-9)) - np.log(pb / (1 - pb + 1e-9))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        z[(a + b < 3) | (z < LEAST)] = 0
        return np.sort(np.argsort(-z, kind="stable")[: min(KEPT, int((z > 0).sum()))])

    def predict(self, model: Model, earlier: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << BITS)
        if model.weights:
            table[list(model.weights)] = list(model.weights.values())
        s = _summed(self.n, self.row, lambda x: table[self.feature[x]]) * self.scale + earlier @ np.array(model.earlier) + model.bias
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def limit_of(held_out: np.ndarray, y: np.ndarray) -> float:
    """The limit that tells out-of-fold probabilities of the classes (y: 0/1, negative: unknown) apart best.

    It maximises the share of toxic texts over it less that of others; of equally good limits, the middle of the first
    widest range. 0.5 where there are no texts of both classes.
    """
    hot, cold = np.sort(held_out[y > 0]), np.sort(held_out[y == 0])
    if not len(hot) or not len(cold):
        return 0.5
    inside = np.unique(held_out[(y >= 0) & (held_out > LOWEST) & (held_out < HIGHEST)])
    edges = np.r_[LOWEST, inside, HIGHEST]
    middles = (edges[1:] + edges[:-1]) / 2
    good = (len(hot) - np.searchsorted(hot, middles, "right")) / len(hot) - (len(cold) - np.searchsorted(cold, middles, "right")) / len(cold)
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float(middles[best[np.argmax(np.diff(edges)[best])]])


def fit_chain(rows: Sequence[tuple[np.ndarray, int]], labels: np.ndarray, folds: int = FOLDS) -> list[Model]:
    """A model for each column of labels (0/1, negative: unknown) in order; rows: features and number of words."""
    return fit_with_limit(rows, labels, folds)[0]


def fit_with_limit(rows: Sequence[tuple[np.ndarray, int]], labels: np.ndarray, folds: int = FOLDS) -> tuple[list[Model], float]:
    """The chain, and the limit of its last category."""
    return _fit(_Rows(rows), labels, folds)


def _fit(data: _Rows, labels: np.ndarray, folds: int = FOLDS) -> tuple[list[Model], float]:
    n = data.n
    fold = np.arange(n) % folds
    out, earlier = [], np.zeros((n, 0))
    for k in range(labels.shape[1]):
        y, known = np.maximum(labels[:, k], 0), labels[:, k] >= 0
        held_out = np.zeros(n)
        for f in range(folds):
            model = data.fit(y, known & (fold != f), earlier)
            held_out[fold == f] = data.predict(model, earlier)[fold == f]
        out.append(data.fit(y, known, earlier))
        earlier = np.column_stack([earlier, _logit(held_out)])
    return out, limit_of(held_out, labels[:, -1])


def _sampled(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int) -> DataFrame:
    """doc_id, the categories, features and words of the sample. labels: doc_id and a 0/1 column for each category.

    Of documents that repeat a doc_id one is taken, so there are no more rows than the sample's.
    """
    values = [F.max(F.col(c).cast("int")).alias(c) for c in categories]
    some = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*values).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t) for t in batch.column("text").to_pylist()]
            rest = batch.select([i for i, c in enumerate(batch.schema.names) if c != "text"])
            yield rest.append_column("features", pa.array([f.tobytes() for f, _ in found], pa.binary())).append_column("words", pa.array([n for _, n in found], pa.int32()))
        release()

    # the sample's size is bounded, so it may be broadcast
    joined = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", *categories).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return joined.mapInArrow(run, "doc_id long, " + ", ".join(f"`{c}` int" for c in categories) + ", features binary, words int")


def _in_order(rows: Iterator[tuple]) -> tuple[list, np.ndarray]:
    """Features and labels of rows (doc_id, labels, features, words), ordered by a hash of doc_id; an unknown label is -1."""
    found = ((i, n, np.frombuffer(bytes(f), np.int32), [-1 if y is None else y for y in labels]) for i, *labels, f, n in rows)
    got = sorted(found, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1]))
    return [(f, n) for _, n, f, _ in got], np.array([y for *_, y in got], int)


def training_rows(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> tuple[list, np.ndarray]:
    """Features and labels of the sample on the driver, in the order of the fit."""
    return _in_order(_sampled(docs, labels, categories, sample).toLocalIterator())


def fitted(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> tuple[list[Model], float]:
    """The chain and its limit, fitted in one task over the sample, whose size is bounded; the driver gets the models only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, values = _in_order(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        if len(values):
            data = _Rows(rows)
            del rows  # a copy of what data has
            chain, limit = _fit(data, values)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(([tuple(m) for m in chain], limit))], pa.binary())], ["chain"])
            del data
        release()

    got = _sampled(docs, labels, categories, sample).repartition(1).mapInArrow(run, "chain binary").collect()
    if not got:
        return [Model({}, (0.0,) * k, -9.0) for k in range(len(categories))], 0.5
    chain, limit = pickle.loads(bytes(got[0].chain))
    return [Model(*m) for m in chain], limit


def score(docs: DataFrame, chain: Sequence[Model], categories: Sequence[str]) -> DataFrame:
    """docs with a column p_<category> for each category; columns of these names are replaced."""
    new = [f"p_{c}" for c in categories]
    docs = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast([tuple(m) for m in chain])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(*m) for m in shared.value]
        known: dict[str, tuple[float, ...]] = {}
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            out = []
            for text in batch.column(at).to_pylist():
                found = words(text)
                sums = [0.0] * len(models)
                for w in found:
                    s = known.get(w)
                    if s is None:
                        if len(known) >= WORDS:
                            known.clear()
                        f = features(w)
                        s = known[w] = tuple(sum(m.weights.get(x, 0.0) for x in f) for m in models)
                    for k, x in enumerate(s):
                        if x:
                            sums[k] += x
                scale, earlier, ps = 1 / math.sqrt(max(1, len(found))), [], []
                for k, m in enumerate(models):
                    z = sums[k] * scale + sum(a * b for a, b in zip(m.earlier, earlier, strict=True)) + m.bias
                    p = 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
                    ps.append(p)
                    q = min(1 - 1e-4, max(1e-4, p))
                    earlier.append(math.log(q / (1 - q)))
                out.append(ps)
            for k, name in enumerate(new):
                batch = batch.append_column(name, pa.array([p[k] for p in out], pa.float64()))
            yield batch
        known.clear()
        release()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(name, DoubleType()) for name in new]]))


#: The chain's order: poor texts first, as toxicity is judged knowing them.
CATEGORIES = ("low_quality", "toxic")


def categories_of(labels: DataFrame) -> DataFrame:
    """doc_id, low_quality, toxic of the labels table."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), (1 - F.col("quality")).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))


def judge(docs: DataFrame, labelled: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: float | None = None) -> DataFrame:
    """docs with p_low_quality, p_toxic and is_toxic (p_toxic over the limit); the chain is fitted on labelled.

    The limit is set by out-of-fold predictions where none is given. Null and empty texts have no words and get the bias
    alone; long ones are judged whole. Where all labels are of one class, no text is found toxic. Null labels and labels
    without a document are unknown; of several labels of a document the largest counts. Repeated rows are judged alike
    and all returned; an empty table gives no rows.
    """
    chain, found = fitted(labelled, categories_of(labels), CATEGORIES, sample)
    text = docs.withColumn("text", F.col("text").cast("string"))
    return score(text.drop("is_toxic"), chain, CATEGORIES).withColumn("is_toxic", F.col("p_toxic") > (found if limit is None else limit))
