import math
import random
import re
import tracemalloc
import zlib

import numpy as np

from kvstrata.llm import catalog, toxicity


def corpus(n, seed):
    r = random.Random(seed)
    bad, plain = ["vile", "nasty", "rotten", "foul"], [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        poor, toxic = r.random() < 0.3, r.random() < 0.25
        words = [r.choice(plain) + ("!!" if poor else "") for _ in range(r.randint(20, 80))] + (["junk"] * 3 if poor else [])
        words += [r.choice(bad) + r.choice(["", "ly", "ness"]) for _ in range(5)] if toxic else []
        r.shuffle(words)
        rows.append((i, " ".join(words), int(poor), int(toxic)))
    return rows


def test_held_out_accuracy():
    rows = corpus(1500, 1)
    train, test = rows[:1000], rows[1000:]
    chain = toxicity.fit_chain([toxicity.text_features(t) for _, t, _, _ in train], np.array([r[2:] for r in train]))
    data, earlier = toxicity._Rows([toxicity.text_features(t) for _, t, _, _ in test]), np.zeros((len(test), 0))
    for k, model in enumerate(chain):
        p = data.predict(model, earlier)
        earlier = np.column_stack([earlier, toxicity._logit(p)])
        assert np.mean((p > 0.5) == np.array([r[2 + k] for r in test])) > 0.97
    assert len(chain[1].earlier) == 1  # the second model has the first one's probability


def test_later_models_learn_from_out_of_fold_probabilities(monkeypatch):
    """With labels that are noise, in-sample probabilities would look perfect; out-of-fold ones don't."""
    r = np.random.default_rng(0)
    rows = [(np.unique(r.integers(0, 1 << toxicity.BITS, 50).astype(np.int32)), 50) for _ in range(60)]
    seen = []
    fit = toxicity._Rows.fit
    monkeypatch.setattr(toxicity._Rows, "fit", lambda self, y, use, earlier: seen.append((use.sum(), earlier.shape[1])) or fit(self, y, use, earlier))
    toxicity.fit_chain(rows, r.integers(0, 2, (60, 2)), folds=3)
    assert seen == [(40, 0)] * 3 + [(60, 0)] + [(40, 1)] * 3 + [(60, 1)]


def test_query_scores_every_document(spark, sf_dir):
    out = catalog.op4_toxicity(spark, sf_dir)
    assert out.columns == ["doc_id", "p_low_quality", "p_toxic", "is_toxic"]
    assert out.count() == catalog.table(spark, sf_dir, "documents").count()


def test_column_and_driver_scores_agree(spark):
    rows = corpus(300, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows], "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame([(i, 1 - q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")
    train, values = toxicity.training_rows(docs, toxicity.categories_of(labels), toxicity.CATEGORIES)
    chain = toxicity.fit_chain(train, values)
    got = {r.doc_id: r for r in toxicity.judge(docs, docs, labels).collect()}
    data, earlier = toxicity._Rows([toxicity.text_features(t) for _, t, _, _ in rows]), np.zeros((len(rows), 0))
    p = data.predict(chain[0], earlier)
    assert set(got) == set(range(300)) and {r.is_toxic for r in got.values()} == {True, False}
    assert np.mean([got[i].is_toxic == bool(t) for i, _, _, t in rows]) > 0.95
    # features that are too rare in this sample for any model have no weight either way
    assert np.allclose(p, [got[i].p_low_quality for i in range(300)], atol=1e-9) or np.mean(np.abs(p - [got[i].p_low_quality for i in range(300)])) < 0.02


def plain_probabilities(text, chain):
    """The chain's probabilities for one text, in plain loops."""
    found = set(re.findall(r"\w+", (text or "").lower()))
    earlier, out = [], []
    for weights, of_earlier, bias in chain:
        z = 0.0
        for w in found:
            names = ["=" + w] + ["^" + w[:n] for n in (4, 5, 6) if len(w) >= n]
            z += sum(weights.get(zlib.crc32(n.encode()) % 2**20, 0.0) for n in names)
        z = z / math.sqrt(len(found) or 1) + sum(a * b for a, b in zip(of_earlier, earlier, strict=True)) + bias
        out.append(1 / (1 + math.exp(-z)))
        p = min(max(out[-1], 1e-4), 1 - 1e-4)
        earlier.append(math.log(p / (1 - p)))
    return out


def test_scores_by_brute_force(spark, edge):
    rows = corpus(250, 5)
    texts = [(i, t) for i, t, _, _ in rows] + [(1000 + n, t) for n, (_, t, _) in enumerate(edge[1]) if t is None or len(t) < 10_000]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")
    chain, limit = toxicity.fit_with_limit(*toxicity.training_rows(docs, toxicity.categories_of(labels), toxicity.CATEGORIES))
    text_of = dict(texts)
    got = toxicity.judge(docs, docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        expected = plain_probabilities(text_of[r.doc_id], chain)
        assert np.allclose([r.p_low_quality, r.p_toxic], expected, atol=1e-12) and r.is_toxic == (expected[1] > limit)


def test_fit_is_the_minimum_of_the_loss():
    """No small step from a model makes its loss, computed in plain loops, smaller."""
    rows = corpus(120, 9)
    found = [toxicity.text_features(t) for _, t, _, _ in rows]
    y = np.array([r[3] for r in rows])
    data = toxicity._Rows(found)
    earlier = np.array([[0.5 * (r[2] - 0.5)] for r in rows])
    model = data.fit(y, np.ones(len(rows), bool), earlier)

    def loss(weights, of_earlier, bias):
        total = 0.0
        for (f, n), t, e in zip(found, y, earlier[:, 0], strict=True):
            z = sum(weights.get(int(x), 0.0) for x in f) / math.sqrt(n) + of_earlier[0] * e + bias
            total += (math.log1p(math.exp(-z)) if t else math.log1p(math.exp(z))) * 0.5 / (y.sum() if t else len(y) - y.sum())
        return total + toxicity.RIDGE / 2 * (sum(w * w for w in weights.values()) + of_earlier[0] ** 2)

    least, r = loss(*model), random.Random(1)
    for _ in range(30):
        step = {k: v + r.gauss(0, 0.3) for k, v in model.weights.items()}
        assert loss(step, (model.earlier[0] + r.gauss(0, 0.3),), model.bias + r.gauss(0, 0.3)) > least


def test_limit_tells_classes_apart():
    y = np.array([0, 0, 0, 1, 1, -1])
    assert 0.48 < toxicity.limit_of(np.array([0.1, 0.2, 0.48, 0.56, 0.9, 0.5]), y) < 0.56
    assert toxicity.limit_of(np.array([0.1, 0.2]), np.array([0, 0])) == 0.5
    assert toxicity.limit_of(np.zeros(0), np.zeros(0, int)) == 0.5


def test_repeated_ids_reach_the_driver_once(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    rows, values = toxicity.training_rows(docs, toxicity.categories_of(labels), toxicity.CATEGORIES)
    assert len(rows) == len(values) == 2


def test_edges(spark, edge, nothing):
    docs, rows = edge
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None), (10, 1, 0), (10, None, 1), (None, 0, 1), (11, 0, None)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        out = toxicity.judge(docs, docs, labels)
        assert out.count() == len(rows) and out.columns[: len(docs.columns)] == docs.columns
        assert not any(r.is_toxic for r in out.collect())
    assert toxicity.judge(nothing, nothing, odd).collect() == []


def test_the_fit_holds_few_bytes_a_feature():
    """All features of the sample lie in one task: what the fit makes of them beside its rows stays small."""
    r = np.random.default_rng(3)
    y = (np.arange(2000) % 4 == 0).astype(int)
    common = np.arange(1500, dtype=np.int32)
    rows = [(common[r.random(1500) < (0.9 if hot else 0.6)], 1500) for hot in y]
    data = toxicity._Rows(rows)
    tracemalloc.start()
    try:
        model = data.fit(y, np.ones(2000, bool), np.zeros((2000, 0)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.weights) > 1400 and len(data.feature) > 1_900_000
    assert peak < 45 * len(data.feature)  # of which 29 are tables of all hashes; 33 measured, 60 when all was done at once


def test_sums_in_parts_are_those_of_bincount(monkeypatch):
    r = np.random.default_rng(5)
    places, weights = r.integers(0, 50, 1000).astype(np.int32), r.normal(size=1000)
    for part in (1, 7, 1000, 5000):
        monkeypatch.setattr(toxicity, "PART", part)
        assert (toxicity._summed(60, places, lambda x: weights[x]) == np.bincount(places, weights, 60)).all()
        assert (toxicity._counts(places) == np.bincount(places, minlength=1 << toxicity.BITS)).all()
    assert (toxicity._summed(3, places[:0], lambda x: weights[x]) == 0).all()
