import random

import corpus_pipeline as P
import pytest
from cases import frame, lower

from kvstrata.llm import near_copies as N
from kvstrata.llm.common import table


def brute(texts):
    """The group of each text: all pairs compared."""
    sets, up = [N.shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if N.similar(a, sets[j], 0.8):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(i) for i in range(len(texts))]


def kept(rows):
    """Of each group the smallest id."""
    least = {}
    for (i, *_), g in zip(rows, brute([t for _, t, *_ in rows]), strict=True):
        least[g] = min(least.get(g, i), i)
    return sorted(least.values())


def edited(r, words, edits):
    words = list(words)
    for at in r.sample(range(len(words)), edits):
        words[at] = f"new{r.randrange(10**6)}"
    return words


@pytest.mark.parametrize("seed", range(3))
def test_near_stage_finds_all_copies(spark, sf_dir, seed):
    r = random.Random(seed)
    common = " ".join(f"line{i}" for i in range(12))
    texts = ["", " ", "one", "two words"]
    for _ in range(12):
        base = [r.choice("abcdefghij") + str(r.randrange(300)) for _ in range(r.randint(20, 200))]
        texts += [" ".join(edited(r, base, r.randint(0, max(1, len(base) // 25)))) + (" " + common if r.random() < 0.5 else "") for _ in range(6)]
    base = [f"w{i}" for i in range(150)]
    texts += [" ".join(edited(r, base, r.randint(1, 3))) for _ in range(40)]
    rows = [(i, t, "s") for i, t in enumerate(dict.fromkeys(texts))]
    got = sorted(x.doc_id for x in P.unlike(spark, frame(spark, rows), sf_dir).collect())
    assert got == kept(rows) and len(got) < len(rows) - 40


def test_near_stage_on_documents(spark, sf_dir):
    """Similarity 0.83, but 9 bits of SimHash apart."""
    docs = table(spark, sf_dir, "documents")
    rows = sorted({lower(r.text): (r.doc_id, r.text) for r in docs.collect()}.values())
    names = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    got = sorted(x.doc_id for x in P.unlike(spark, docs.join(names, "doc_id", "left_semi"), sf_dir).collect())
    assert got == kept(rows)


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 10, 99, 1000])
def test_prefix_is_long_enough(n):
    # fewer than that of n may be missing from a copy
    assert n - N._prefix_length(n, 0.8) + 1 <= 0.8 * n + 1 and N._prefix_length(n, 0.8) >= n - -(-4 * n // 5) + 1


def test_sketches_drop_no_similar_pair(spark):
    r = random.Random(5)
    # the last text has too many shingles for the counts of a sketch, and one has no words
    texts = ["", *[" ".join(edited(r, [f"w{i}" for i in range(n)], e)) for n in (8, 60, 300) for e in (0, 0, 1, 2, 3, 5)], " ".join(map(str, range(90_000)))]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    sketches = N.postings(rows, 5, 0.8).where("shingle is null").select("node", "size", "bins")
    of = {x.node: x.bins for x in sketches.collect()}
    assert 0 not in of and of[len(texts) - 1] is None and len(of) == len(texts) - 1
    pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
    got = {tuple(x) for x in N._possible(spark.createDataFrame(pairs, "a long, b long"), sketches, 0.8).collect()}
    sets = [N.shingles(t) for t in texts]
    assert {(a, b) for a, b in pairs if N.similar(sets[a], sets[b], 0.8)} < got < set(pairs)


@pytest.mark.parametrize("edits", [2, 4])
def test_dense_group_around_the_limit(spark, sf_dir, monkeypatch, edits):
    """Variants of one text: with 1 and 2 edits they are linked in rounds; with up to 4 many pairs lie just under the limit."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(r, base, 1 + i % edits)) for i in range(160)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    made, written = {}, N.written

    def counted(df, name):
        out = written(df, name)
        made[name] = made.get(name, 0) + (out.count() if name in ("pairs", "rest") else 0)
        return out

    monkeypatch.setattr(N, "written", counted)
    got = sorted(x.doc_id for x in P.unlike(spark, frame(spark, rows), sf_dir).collect())
    assert got == kept(rows) and len(got) < 120
    asked = made["pairs"] + made["rest"]
    print("pairs asked", edits, made["pairs"], made["rest"])
    assert asked < (len(rows) * 12 if edits == 2 else len(rows) * (len(rows) - 1) / 2)


def test_pairs_that_do_not_fit_are_not_similar(spark):
    """Of texts in the order of their shingles: what they share from their first common shingle on is no more than either reach."""
    r = random.Random(3)
    texts = [" ".join(edited(r, [f"w{i}" for i in range(n)], e)) for n in (20, 24, 60) for e in (0, 1, 1, 2, 3)]
    rows = N.postings(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 5, 0.8).where("shingle is not null")
    x, y = (rows.select("shingle", *[rows[c].alias(f"{p}_{c}") for c in ("node", "size", "reach")]) for p in "xy")
    fit = {tuple(p) for p in x.join(y, "shingle").where("x_node < y_node").where(N._fits("x_", "y_", 0.8)).select("x_node", "y_node").collect()}
    sets = [N.shingles(t) for t in texts]
    assert {(a, b) for b in range(len(texts)) for a in range(b) if N.similar(sets[a], sets[b], 0.8)} <= fit
