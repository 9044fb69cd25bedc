import random

import pytest
from cases import frame, lower
from helpers import check_query

from kvstrata.llm import catalog, line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_chars, min_docs):
    """Documents are doc_ids; rows without an id are told apart by their text."""
    name = lambda i, t: (i is not None, i if i is not None else 0, "" if i is not None else t or "")
    holders = {}
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            key = lower(x.strip(BLANKS))
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(name(i, t))
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            who = holders.get(lower(x.strip(BLANKS)), ())
            identified = [w for w in who if w[0]]
            alone = len(identified) == 0  # which of several rows without an id keeps a line is decided by a hash
            if len(who) < min_docs or alone or name(i, t) == max(identified):
                kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_matches_sql(spark, sf_dir):
    check_query(spark, sf_dir, catalog.op7_line_dedup, catalog.OP7_SQL)


def test_edges(spark, edge, nothing):
    docs, rows = edge
    assert sorted((tuple(r) for r in line_dedup.deduplicate(docs).collect()), key=str) == brute(rows, 40, 5)
    assert line_dedup.deduplicate(nothing).collect() == []


@pytest.mark.parametrize("open_rows", [0, 3, 50_000])
@pytest.mark.parametrize("seed", range(2))
def test_brute_force(spark, seed, open_rows):
    """A hot line in all documents, few partitions and many, rows left open early or late."""
    r = random.Random(seed)
    pool = [f"line {i} " + "z" * r.randint(0, 10) for i in range(12)]
    rows = [(r.randint(0, 60), "\n".join(r.choice([pool[0], r.choice(pool), " " + r.choice(pool).upper() + "\r"]) for _ in range(r.randint(1, 8))), "s") for _ in range(80)]
    rows = [(i, t, s) for i, t, s in {(i, t): (i, t, s) for i, t, s in rows}.values()]
    docs = frame(spark, rows).repartition(4)
    bitmaps = line_dedup.keep_bitmaps(docs, 6, 3, open_rows)
    got = line_dedup.apply_bitmaps(docs, bitmaps).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 6, 3)


def test_rows_without_ids_keep_one(spark):
    text = "the very same long line of text in rows without any id at all"
    docs = frame(spark, [(None, f"{text}\n{i}", "s") for i in range(7)])
    got = line_dedup.deduplicate(docs).collect()
    assert sorted(r.n_dropped for r in got) == [0] + [1] * 6
