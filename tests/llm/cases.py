"""Documents with all kinds of edges."""

import random

#: Columns whose names the operators use for themselves.
CLASH = "tag string, size string, digest string, norm string, locator string, keep string, ids string, position string, fp string, root string, h1 string, pos string, words string, lines string, block string"
EXTRA = tuple("x" for _ in CLASH.split(","))


def frame(spark, rows):
    """Documents (doc_id, text, source) with columns of clashing names."""
    full = [(i, t, "en", s, None if t is None else len(t), *EXTRA) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


LINE = "This line is long enough to count as a repeated line of many documents."
PASSAGE = "a passage of well over fifty bytes that several documents hold, é and all, word for word"


def edge_rows():
    """Nulls, empty, tiny and very long texts, copies, near copies, repeated rows, a repeated doc_id, odd characters."""
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "ETA", "theta", "iota", "kappa", "ünï", "日本"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = prose(300)
    out = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "One two", "b"), (5, "one TWO", "b"), (None, "one two", "b"), (None, None, None)]
    out += [(10 + i, base if i % 2 else base.upper(), "hot") for i in range(6)]
    out += [(20 + i, base + f" end {i}", "hot") for i in range(5)]
    out += [(30 + i, f"{prose(8)}\n{LINE if i % 2 else LINE.upper() + '  '}\n{prose(5)}\n{PASSAGE}", "c") for i in range(8)]
    out += [(40, prose(20_000), "long"), (41, "x" * 100_000, "long"), (42, "ab\x00c\u0301 \U0001f600 <|endoftext|> nbsp\u00a0end " + PASSAGE, None)]
    out += [(50, "the same row", "d"), (50, "the same row", "d"), (50, "another text of the same id " + PASSAGE, "d")]
    out += [(None, f"{LINE}\n{PASSAGE}", "e"), (None, f"{LINE}\nx {PASSAGE}", "e")]
    return out


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
