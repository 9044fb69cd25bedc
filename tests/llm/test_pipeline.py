"""The stages on edges, and the whole pipeline against a brute-force version of what each stage must keep."""

from hashlib import sha256

import corpus_pipeline as P
import pytest
from cases import frame, lower
from test_bpe import library
from test_simhash import groups, plain_fingerprint

from kvstrata.llm import common, curriculum
from kvstrata.llm.common import table, written


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]


@pytest.mark.parametrize("k", range(4))
def test_stages_on_edges(spark, sf_dir, edge, nothing, k):
    docs, rows = edge
    stage = P.STAGES[k][1]
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.count() > 0
    assert stage(spark, nothing, sf_dir).collect() == []


def test_near_stage_keeps_one_of_each_group(spark, sf_dir):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(i, f"{base} tail{i}", "s") for i in range(1, 6)] + [(None, f"{base} tail9", "s"), (7, "quite another text of its own", "s")]
    kept = P.unlike(spark, frame(spark, rows), sf_dir).collect()
    part = groups([plain_fingerprint(t) for _, t, _ in rows], 4)
    assert len(kept) == len(set(part)) and 7 in {r.doc_id for r in kept}
    assert min(r.doc_id for r in kept) == 1 and None not in {r.doc_id for r in kept}


def alike(texts, n=5, least=0.8):
    """The group of each text: all pairs compared by their shingles."""
    sets, group = [], list(range(len(texts)))
    for t in texts:
        w = lower(t).encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= least * (len(a) + len(sets[j]) - both) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_whole_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stages = [docs]
    for _, stage in P.STAGES:
        stages.append(written(stage(spark, stages[-1], sf_dir), "test-stage"))
    rows = [[tuple(r) for r in s.collect()] for s in stages]
    tox, exact, near, mix, bpe = rows[1:]
    # toxicity: what goes is mostly labelled toxic, and most of what is labelled clean stays
    toxic = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    kept = {r[0] for r in tox}
    clean = [i for i, t in toxic.items() if not t]
    assert sum(i in kept for i in clean) > 0.9 * len(clean) and set(tox) <= set(rows[0])
    # exact duplicates: the largest id of each text
    last = {}
    for r in tox:
        last[lower(r[1])] = max(last.get(lower(r[1]), r), r)
    assert sorted(exact) == sorted(last.values())
    # near-duplicates: the smallest id of each group of texts linked by five-word shingles of Jaccard 0.8
    part, first = alike([r[1] for r in exact]), {}
    for r, p in zip(exact, part, strict=True):
        first[p] = min(first.get(p, r), r)
    assert sorted(near) == sorted(first.values())
    # the mix: each document as often as the passes that take of it
    plan = {r.doc_id: -(-r.taken // r.size) if r.size else 0 for r in curriculum.mix(stages[3]).collect()}
    assert sorted(mix) == sorted(r for r in near for _ in range(plan[r[0]]))
    # encoding
    expected = []
    for r in mix:
        ids, text = library(r[1])
        expected.append((r[0], len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest()))
    assert sorted(bpe) == sorted(expected)
    assert sorted(map(tuple, P.run(spark, sf_dir).collect())) == sorted(expected)


def expected_tokens(texts):
    out = []
    for i, t in texts:
        ids, text = library(t)
        out.append((i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("empty", [False, True])
def test_whole_run_on_edges_and_nothing(spark, edge, nothing, tmp_path, empty):
    """Null and repeated rows, clashing columns, very long texts and an empty table through all stages."""
    docs, rows = (nothing, []) if empty else edge
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None, None), (10, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = P.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = P.mixed(spark, written(P.unlike(spark, written(P.distinct(spark, docs, str(tmp_path)), "t-exact"), str(tmp_path)), "t-near"), str(tmp_path)).collect()
    assert sorted(map(tuple, got.collect()), key=str) == expected_tokens([(r.doc_id, r.text) for r in kept])
    assert bool(kept) != empty
    texts = {lower(r.text) for r in kept}
    assert len({(r.doc_id, lower(r.text)) for r in kept}) == len(texts)  # one document of each text


@pytest.mark.parametrize("stage", [P.distinct, P.unlike])
def test_stages_leave_only_the_names_of_what_goes(spark, sf_dir, edge, stage):
    """What a stage made on the way, texts among it, isn't there any more when the next one runs."""
    docs, rows = edge
    since = common.made()
    out = stage(spark, docs, sf_dir)
    assert len(common._made[since:]) <= 2
    left = [spark.read.parquet(p) for p in common._made[since:]]
    assert all("text" not in f.columns and f.count() <= len(rows) for f in left)
    assert 0 < out.count() < len(rows)


def test_bpe_stage_on_edges(spark, sf_dir, edge, nothing):
    docs, rows = edge
    got = P.encoded(spark, docs, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == expected_tokens([(i, t) for i, t, _ in rows])
    assert P.encoded(spark, nothing, sf_dir).collect() == []
