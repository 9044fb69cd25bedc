"""Operator 5: main text of pages by nearest-URL page differencing.

Pages are ordered by host and URL path, and each is paired with the neighbour on its host whose path has the longer
common prefix. The text lines (blocks) of both are aligned by a longest common subsequence, and shared lines are
deleted: what two pages of a site share is its frame. A neighbour that is a near copy (of the text outside articles
a share of NEAR, and NEAR_CHARS characters, is the same on both sides) is no mate, else copies would empty each other; the other neighbour is asked then.

Differencing can't see what is unique to a page, nor that a paragraph which two articles share belongs to both, so
markup rules complete it: lines inside an article or main element are never deleted, and lines whose elements say that
they are no article (menus, headers, footers, sidebars, notices, adverts, forms, comments) go even where they are not
shared. Only where a page has no mate with text, and an article or main element, does all text outside that go.

Distribution: the bounds of blocks of pages are found by range-partitioning the narrow keys. Pages are parsed where they
are read and sent to their block, and the first and last page of each block also to the block before or after it, so
every page meets both neighbours. Inside a block the sorted pages are streamed, with three in memory; a host of any size
is dealt over many blocks, whose number follows the bytes of the input.

Parsing takes time in proportion to a page's length, whatever is in it.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_reputation import host_and_path

#: Bytes of pages of a block; see blocks_for().
BLOCK_BYTES = 2 << 20
#: Two pages that share this much of their text outside articles, and so many characters, are near copies; where less
#: is shared, pages with a frame and nothing else are likelier.
NEAR, NEAR_CHARS = 0.9, 100
#: Keys sampled for each block's bound; Spark's own 100 would be too much for the driver with many blocks.
SAMPLED = 20

#: Fixed sets of HTML names.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title xmp noembed noframes canvas audio video".split())
AWAY = frozenset("nav header footer aside form menu dialog head button select search fieldset".split())
MAIN = frozenset("article main".split())
#: Opening one of these ends an open p.
ENDS_P = BLOCKS - frozenset("body html caption dd dt li td th tr tbody thead tfoot legend summary".split())
#: Words of class names, ids and roles of what is no article.
WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising alert alerts aside banner breadcrumb breadcrumbs captcha comment commentlist comments "
    "complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer form gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices "
    "notification pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription toc toolbar widget widgets".split()
)
BEGINNINGS = ("advert", "breadcrumb", "cookie", "footer", "navbar", "newsletter", "sidebar", "sponsor")
ENDINGS = ("adverts", "comments", "footer", "menu", "navbar", "newsletter", "sidebar")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"(?i)display\s*:\s*none")
MAIN_ROLE = re.compile(r"(?i)\brole\s*=\s*[\"']?main\b")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What lies in a tag up to a quote or its end.
PLAIN = re.compile(r"[^'\">]*")
NUMBER = re.compile(r"&#([0-9]{9,});?")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([^\s=\"'/>]+)")


def _says(value: str) -> bool:
    """Do the words of a class name, id or role say that an element is no article?"""
    for text in (value, CAMEL.sub(" ", value)):
        words = re.split(r"[^a-z0-9]+", text.lower())
        for i, w in enumerate(words):
            if (w in WORDS or w.startswith(BEGINNINGS) or w.endswith(ENDINGS)) and not (i and words[i - 1] in ("with", "has", "no", "without")):
                return True
    return False


#: How surely an element is no article: by a word inside a class name, by a whole one, by its tag or as it is hidden.
PART, WHOLE, SURE = 1, 2, 3


def _away(tag: str, rest: str) -> int:
    """How surely does an element say that it is no article? 0 if it doesn't."""
    if tag in AWAY:
        return SURE
    if not rest or tag in ("main", "body", "html"):
        return 0
    found = 0
    for name, value, alone in ATTRIBUTE.findall(rest):
        name, value = (name or alone).lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            return SURE
        if name in ("class", "id", "role") and _says(value):
            found = max(found, WHOLE if WORDS.intersection(value.lower().split()) else PART)
    return found


def _unescaped(text: str) -> str:
    """Text without character references; numbers beyond any character keep nine digits, as int() refuses very long ones."""
    if "&#" in text:
        text = NUMBER.sub(lambda m: f"&#{m[1].lstrip('0')[:9] or 0};", text)
    return html.unescape(text)


def lines(page: str | None) -> list[tuple[str, str]]:
    """(text, role) of the blocks of a page in order; roles: m in an article or main element, x no article, b else.

    Class words don't remove main. A word inside a class name doesn't remove an article whose text outweighs that of
    the other articles, nor do class words remove all the text that there is.
    """
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack = _Open()
    page = page or ""

    def flush() -> None:
        if parts and (text := " ".join(_unescaped("".join(parts)).split())):
            away, main = stack.state()
            role = "x" if away == SURE else "a" if away == PART and main else "c" if away else "m" if main else "b"
            out.append((text, role))
        parts.clear()

    for text, end, tag, rest in _tokens(page):
        if tag is None:
            parts.append(text)
            continue
        if tag in RAW:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS or (rest and not stack.state()[0] and _away(tag, rest)):
            flush()  # also where an inline element begins something that is no article
        if end:
            if stack.changes(tag):
                flush()
            stack.close(tag)
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P:
            stack.end(("p",), "blocks")
        elif tag in ENDS:
            stack.end(ENDS[tag], "lists")
        away, main = stack.state()
        if rest.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        whole = tag == "main" or MAIN_ROLE.search(rest) is not None
        own = _away(tag, rest)
        if not main and own < SURE and (whole or (tag == "article" and own == PART)):
            own = 0
        if main and own == PART:
            own = WHOLE  # a part of an article, not what contains it
        if whole and not main and away < SURE:
            away = 0
        stack.push(tag, max(away, own), main or whole or tag in MAIN)
    flush()
    return _settled(out)


#: Items that end open ones before them.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th", "option"), "th": ("td", "th", "option"), "option": ("td", "th", "option")}
LISTS = frozenset("ul ol dl table menu".split())


class _Open:
    """The open elements, with where those of each tag, the blocks and the lists are, so that nothing is searched."""

    def __init__(self):
        self.items: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, away, main
        self.at: dict[str, list[int]] = {"blocks": [], "lists": []}
        self.turns: list[int] = []  # where away or main differ from the element before

    def state(self) -> tuple[int, bool]:
        return self.items[-1][1:]

    def push(self, tag: str, away: int, main: bool) -> None:
        here = len(self.items)
        if (away, main) != self.state():
            self.turns.append(here)
        self.items.append((tag, away, main))
        self.at.setdefault(tag, []).append(here)
        if tag in BLOCKS and tag != "p":
            self.at["blocks"].append(here)
        if tag in LISTS:
            self.at["lists"].append(here)

    def cut(self, here: int) -> None:
        """Close the elements from a place on."""
        for tag, _, _ in self.items[here:]:
            self.at[tag].pop()
        for places in (self.at["blocks"], self.at["lists"], self.turns):
            while places and places[-1] >= here:
                places.pop()
        del self.items[here:]

    def close(self, tag: str) -> None:
        if places := self.at.get(tag):
            self.cut(places[-1])

    def changes(self, tag: str) -> bool:
        """Would an end tag change what is known of the text after it?"""
        places = self.at.get(tag)
        return bool(places and self.turns and self.turns[-1] >= places[-1])

    def end(self, tags: tuple[str, ...], within: str) -> None:
        """End the innermost open element of these tags, unless one of within lies inside it."""
        here = max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)
        if here > (self.at[within][-1] if self.at[within] else 0):
            self.cut(here)


def _tokens(page: str) -> Iterator[tuple[str, bool, str | None, str]]:
    """(text, False, None, "") and (_, is end, tag, what follows it) of a page; comments, raw elements and the like are skipped."""
    at, last, quoted = 0, page.rfind(">"), True
    while at < len(page):
        here = page.find("<", at)
        if here != at:
            yield page[at : here if here >= 0 else len(page)], False, None, ""
            if here < 0:
                return
        if page.startswith("<!--", here):
            end = page.find("-->", here + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith("<![CDATA[", here):
            end = page.find("]]>", here + 9)
            yield html.escape(page[here + 9 : end if end >= 0 else len(page)]), False, None, ""
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), here):
            end = page.find(">", here)
            at = end + 1 if end >= 0 else len(page)
            continue
        m = TAG.match(page, here) if here < last else None
        if m is None:  # no tag, or one that never ends
            yield "<", False, None, ""
            at = here + 1
            continue
        end = _tag_end(page, m.end()) if quoted else -1
        if end < 0:  # a quote that never ends: from here on quotes don't hide ends of tags
            quoted, end = False, page.find(">", m.end())
        tag, rest, at = m[2].lower(), page[m.end() : end], end + 1
        if tag in RAW and not m[1] and not rest.rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else len(page)
            continue
        yield "", bool(m[1]), tag, rest


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends a tag, outside quotes; -1 where there is none."""
    while True:
        at = PLAIN.match(page, at).end()
        if at == len(page):
            return -1
        if page[at] == ">":
            return at
        at = page.find(page[at], at + 1) + 1
        if not at:
            return -1


def _settled(found: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Roles m, b and x in place of a, an article in an element with a word in its class name, and c, in other such text."""
    size = {r: sum(len(x) for x, role in found if role == r) for r in "ambc"}
    a = "m" if size["a"] > size["m"] else "x"
    c = "b" if not size["m"] + size["b"] + (size["a"] if a == "m" else 0) else "x"
    return [(x, {"a": a, "c": c}.get(r, r)) for x, r in found]


def common(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b, by bit-parallel rows; long pairs are halved."""
    lo, hi = 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = set(range(lo)) | set(range(len(a) - hi, len(a)))
    return out | {lo + i for i in _subsequence(a[lo : len(a) - hi], b[lo : len(b) - hi])}


#: Bits of rows held at once.
HELD = 1 << 28


def _subsequence(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of an LCS. A row has bit j clear where the LCS of a prefix of a grows at b[j].

    If all rows would be too much, some are held and those between are made again on the way back: the same result.
    """
    if not a or not b:
        return set()
    at: dict[str, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1

    def rows(row: int, part: list[str]) -> Iterator[int]:
        for x in part:
            hit = row & at.get(x, 0)
            row = ((row + hit) | (row - hit)) & full
            yield row

    step = len(a) if len(a) * len(b) <= HELD else math.isqrt(len(a)) + 1
    held, row = [], full
    for lo in range(0, len(a), step):
        held.append(row)
        if lo + step < len(a):
            for row in rows(row, a[lo : lo + step]):  # noqa: B007
                pass
    out, j = set(), len(b) - 1
    for n in reversed(range(len(held))):
        lo = n * step
        here = list(rows(held[n], a[lo : lo + step]))
        for i in reversed(range(len(here))):
            while j >= 0 and here[i] >> j & 1:  # the LCS doesn't grow at j
                j -= 1
            if j < 0:
                return out
            if (here[i - 1] if i else held[n]) >> j & 1:  # it does with a[i], and not without
                out.add(lo + i)
                j -= 1
    return out


def near_copies(own: list[str], roles: str, shared: set[int], other: list[str], other_roles: str) -> bool:
    """Is nearly all text outside articles shared on both sides? Then none of it can be told from a frame."""
    both = sum(len(x) for i, (x, r) in enumerate(zip(own, roles, strict=True)) if r == "b" and i in shared)
    size = max(sum(len(x) for x, r in zip(lines_, roles_, strict=True) if r == "b") for lines_, roles_ in ((own, roles), (other, other_roles)))
    return both >= max(NEAR * size, NEAR_CHARS)


def main_text(own: list[str], roles: str, *mates: tuple[list[str], str]) -> str:
    """The lines that stay of a page, given those (and their roles) of the pages that may be its mate, the best first."""
    for mate, mate_roles in mates:
        if not mate:
            continue
        shared = common(own, mate)
        if near_copies(own, roles, shared, mate, mate_roles):
            continue
        return "\n\n".join([x for i, (x, r) in enumerate(zip(own, roles, strict=True)) if r == "m" or (r == "b" and i not in shared)])
    wanted = "m" if "m" in roles else "b"  # nothing tells what lies outside the article from a frame
    return "\n\n".join([x for x, r in zip(own, roles, strict=True) if r == wanted])


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


DDL = "block int, host string, path string, page_id long, url string, tag long, context int, lines string, roles string"
FIELDS = pa.schema([("block", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("tag", pa.int64()), ("context", pa.int32()), ("lines", pa.string()), ("roles", pa.string())])


def _parse(bounds):
    """host, path, page_id, url, tag, html to lines, sent to the blocks that need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = zip(*bounds.value, strict=True)
        for batch in batches:
            out = []
            for host, path, page_id, url, tag, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = lines(page)
                key = (host.encode(), path.encode(), page_id is not None, page_id or 0, tag)
                block = bisect_right(firsts, key) - 1
                row = (host, path, page_id, url, tag)
                text = ("\n".join(x for x, _ in found), "".join(r for _, r in found))
                out.append((block, *row, 0, *text))
                if key == firsts[block] and block:
                    out.append((block - 1, *row, 1, *text))
                if key == lasts[block] and block + 1 < len(firsts):
                    out.append((block + 1, *row, 1, *text))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(FIELDS), FIELDS, strict=True)], schema=FIELDS)

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last key of a sorted partition."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first or batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1, 1)
    if last is not None:
        for x in (first, last):
            yield x.append_column("part", pa.array([TaskContext.get().partitionId()], pa.int32()))


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and key to page_id, url, text of those that aren't there as context."""

    def text(before, row, after) -> tuple:
        mates = [x for x in (before, after) if x is not None and x[:2] == row[:2]]
        mates.sort(key=lambda x: -_prefix(x[2], row[2]))
        of = lambda x: (x[7].split("\n") if x[8] else [], x[8])
        return row[3], row[4], main_text(*of(row), *map(of, mates))

    before = row = None
    for batch in batches:
        out = []
        for after in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row is not None and not row[6]:
                out.append(text(before, row, after))
            before, row = row, after
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(OUT.names, zip(*out, strict=True), strict=True)), OUT)
    if row is not None and not row[6]:
        yield pa.RecordBatch.from_pydict(dict(zip(OUT.names, zip(text(before, row, None), strict=True), strict=True)), OUT)


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _block_edges(keys: DataFrame, blocks: int) -> list:
    """The first and the last key of each of so many key ranges."""
    by = ("host", "path", "page_id", "tag")
    sorted_keys = keys.repartitionByRange(blocks, *by).sortWithinPartitions(*by)
    return sorted_keys.mapInArrow(_edges, "host string, path string, page_id long, tag long, part int").collect()


def blocks_for(size: int) -> int:
    """Blocks for so many bytes of pages: in proportion up to 32 GiB, with their root beyond.

    The driver holds two narrow keys a block, so their number can't grow on in proportion; blocks are streamed.
    """
    return max(1, min(size // BLOCK_BYTES, math.isqrt(size >> 7)))


def extract(pages: DataFrame, rows: int | None = None) -> DataFrame:
    """page_id, url, text of every row of pages (page_id, url, html). rows: pages of a block, if blocks_for() is not to say.

    Null html is empty; a page without text has an empty text, and a long one is read whole. Pages without a url are
    neighbours of one another. Repeated rows are all returned; of neighbours with equal common prefixes the one before
    is the mate. An empty table gives no rows, and other columns are ignored.
    """
    spark = pages.sparkSession
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    narrow = pages.select(host.alias("host"), path.alias("path"), F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.xxhash64("url", F.col("html").cast("string")).alias("tag"), F.col("html").cast("string").alias("html"))
    keys = narrow.select("host", "path", "page_id", "tag")
    size = pages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, size.n // rows) if rows else blocks_for(size.bytes)
    setting = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    was = spark.conf.get(setting)
    spark.conf.set(setting, str(SAMPLED))
    try:
        edges = _block_edges(keys, blocks)
    finally:
        spark.conf.set(setting, was)
    spans: dict[int, list] = {}
    for r in edges:
        spans.setdefault(r.part, []).append((r.host.encode(), r.path.encode(), r.page_id is not None, r.page_id or 0, r.tag))
    bounds = sorted((min(x), max(x)) for x in spans.values())
    if not bounds:
        return spark.createDataFrame([], "page_id long, url string, text string")
    sent = narrow.mapInArrow(_parse(spark.sparkContext.broadcast(bounds)), DDL)
    # a task has four blocks or so, however many pages there are
    sent = sent.repartition(max(partitions, blocks // 4), "block").sortWithinPartitions("block", "host", "path", "page_id", "tag")
    return sent.select("block", "host", "path", "page_id", "url", "tag", "context", "lines", "roles").mapInArrow(_pair, "page_id long, url string, text string")
