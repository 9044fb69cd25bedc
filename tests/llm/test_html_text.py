import os
import random
import time

import pytest

from kvstrata.llm import html_text as H


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain  text\n only", "plain text only"),
        ("<html><head><title>T</title><style>p{}</style><script>var t='</p><p>x</p>';</script></head><body><nav>Menu</nav><article><h1>A &amp; B</h1><p><b>One<br>two<p>three &copy;</article><footer>F</footer></body>", "A & B\n\nOne two\n\nthree ©"),
        ("<body><div class='ad'>buy</div><div id=comments><p>c</p></div><div class='cookie-notice'>n</div><form>f<input></form><aside>s</aside><p>stay</p>", "stay"),
        ("<article><p>a</p><div class='reader-comments'><p>no</p></div><header>h</header><p>b<span class=advert>ad</span>c</p></article><p>outside</p>", "a\n\nb\n\nc"),
        ("<main><div class='content with-sidebar'><p>in</p></div></main>", "in"),
        ("<!-- <p>no</p> --><p>1 < 2 & 3 &lt;b&gt; &#233;&#x41;</p><p hidden>h</p><p style='display: none'>d</p>", "1 < 2 & 3 <b> éA"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e\n f</pre>", "a\n\nb\n\nc\n\nd\n\ne f"),
        ("<p>broken <b", "broken <b"),
        ("<p title='a>b'>q</p><![CDATA[raw <x>]]>", "q\n\nraw <x>"),
        ("<article><p>a</p><article class='comment'><p>no</p></article></article><div id='siteFooter'>f</div>", "a"),
        ("<div role='main'><p>a</p><div class='adBox'>x</div><div class='topmenu'>x</div><section class='userComments'>x</section><div class='no-comments'>b</div></div><p>c</p>", "a\n\nb"),
        ("<p>x</p></div></article></p>y", "x\n\ny"),
    ],
)
def test_blocks(page, text):
    found = H.lines(page)
    assert H.main_text([x for x, _ in found], "".join(r for _, r in found)) == text


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def is_subsequence(x, b):
    rest = iter(b)
    return all(any(y == z for z in rest) for y in x)


@pytest.mark.parametrize("held", [1 << 28, 4])
def test_longest_common_subsequence(held, monkeypatch):
    monkeypatch.setattr(H, "HELD", held)
    for seed in range(300):
        r = random.Random(seed)
        a, b = ([r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(0, 14))] for _ in range(2))
        found = sorted(H.common(a, b))
        assert len(found) == lcs(a, b) and is_subsequence([a[i] for i in found], b), (a, b)


def pages_of(seed):
    r = random.Random(seed)
    frame = lambda h: f"<div>{h} home</div><div>{h} about</div>"
    out = []
    for i in range(120):
        host = r.choice(["hot.com", "hot.com", "b.org", f"own{i}.net"])
        path = r.choice(["/en/", "/de/", "/x/"]) + str(r.randint(1, 40))
        body = "".join(f"<p>text {r.randint(0, 10**6)}</p>" for _ in range(r.randint(0, 3)))
        out.append((i, f"http://{host}{path}?{i}", frame(host) + (f"<article>{body}</article>" if r.random() < 0.3 else body) + f"<div>{host} end</div>"))
    return out + [(200, None, "<p>no url</p>"), (None, None, None), (201, "http://b.org/en/1", None), (201, "http://b.org/en/1", None), (202, "http://b.org/zz", "<p>" + "long " * 30000 + "</p>")]


def key_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def brute(rows):
    """Sort all, look at both neighbours."""
    rows = sorted(rows, key=lambda r: (*map(str.encode, key_of(r[1])), r[0] is not None, r[0] or 0))
    found = [H.lines(r[2]) for r in rows]
    parts = lambda j: ([x for x, _ in found[j]], "".join(r for _, r in found[j]))
    out = []
    for i, row in enumerate(rows):
        host, path = key_of(row[1])
        mates = [j for j in (i - 1, i + 1) if 0 <= j < len(rows) and key_of(rows[j][1])[0] == host]
        mates.sort(key=lambda j: -len(os.path.commonprefix([key_of(rows[j][1])[1], path])))
        out.append((row[0], row[1], H.main_text(*parts(i), *map(parts, mates))))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [7, 40, 10**6])
def test_any_blocks_give_the_same(spark, rows):
    pages = pages_of(3)
    frame = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, text string").repartition(5)
    got = sorted((tuple(r) for r in H.extract(frame, rows).collect()), key=str)
    assert got == brute(pages)
    shared = [t for _, u, t in got if u and "hot.com" in u]
    assert shared and not any("home" in t for t in shared)  # the frame of a site goes


def test_empty(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_differencing_decides_outside_the_article(spark):
    page = "<div>site frame</div><article><p>teaser {0}</p></article><div><p>own text {0}</p></div><div>site end</div>"
    rows = [(i, f"http://h.com/a/{i}", page.format(i)) for i in range(3)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"teaser {i}\n\nown text {i}" for i in range(3)}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='content-sidebar-wrap'><main><p>a</p></main></div><div>f</div>", "a"),
        ("<div class='layout-sidebar-right'><article><p>a</p></article></div>", "a"),
        ("<div class='sidebar'><div id='main' role='main'><p>a</p></div></div>", "a"),
        ("<article class='post category-social'><p>a</p><div class='share-box'>s</div></article><aside><article><p>no</p></article></aside>", "a"),
        ("<article class='post cookie-recipe'><p>a</p></article>", "a"),
        ("<div class='page-widget'><p>all there is</p></div>", "all there is"),
        ("<article><p>a</p></article><ol class='comment-list'><li class='comment'><article class='comment-body'><p>longer than the article</p></article></li></ol>", "a"),
        ("<article><p>a <math><mi>x</mi></math> b</p><object>c</object><svg><text>d</svg><p>e</p><svg><p>f</article>", "a x b\n\ncd\n\ne\n\nf"),
    ],
)
def test_class_words_never_remove_the_article(page, text):
    found = H.lines(page)
    assert H.main_text([x for x, _ in found], "".join(r for _, r in found)) == text


def built(seed):
    """Pages whose text is known as they are built, with no code of the operator: (page_id, url, html, text)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    frames = {h: [f"{h} line {i} {word()}" for i in range(4)] for h in ("one.com", "two.org", "three.net")}
    own = [h for h in frames for _ in range(15)] + ["lone.com"]
    pages = []
    for i, h in enumerate(own):
        top, end = frames.get(h, ["top a", "top b", "end a", "end b"])[:2], frames.get(h, ["", "", "end a", "end b"])[2:]
        paragraphs = [f"{word()} {i} &amp; &#233;{j} {word()} {'long ' * r.randint(5, 30)}" for j in range(r.randint(1, 4))]
        article = r.random() < 0.5
        unique = [f"{word()} aside {i}"] if r.random() < 0.5 else []
        tag = r.choice(["p", "div", "section"])
        body = "".join(f"<{tag}>\n {p}\n</{tag}>" for p in paragraphs)
        page = "<html><head><title>t</title><script>x('</p>')</script></head><body>" + "".join(f"<div>{x}</div>" for x in top)
        page += "".join(f"<nav><p>{u}</p></nav>" for u in unique) + (f"<article>{body}<div class='comments'><p>c {i}</p></div></article>" if article else body)
        page += "".join(f"<div>{x}</div>" for x in end) + f"<footer>{word()}</footer></body></html>"
        text = [" ".join(p.replace("&amp;", "&").replace("&#233;", "é").split()) for p in paragraphs]
        if h == "lone.com" and not article:
            text = [*top, *text, *end]
        pages.append((i, f"https://{h}/{r.choice('ab')}/{r.randrange(10**6)}", page, "\n\n".join(text)))
    return pages


@pytest.mark.parametrize("seed", range(3))
def test_texts_known_by_construction(spark, seed):
    pages = built(seed)
    frame = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in H.extract(frame, rows=6).collect()}
    assert got == {i: text for i, _, _, text in pages}


def test_copies_do_not_empty_each_other(spark):
    page = "<div>frame of the site</div><p>" + "one and the same text of some length " * 3 + "</p><div>end</div>"
    other = "<div>frame of the site</div><p>" + "quite another text that is as long as that " * 3 + "</p><div>end</div>"
    rows = [(1, "http://h.com/a/1", page), (2, "http://h.com/a/1?print", page), (3, "http://h.com/b/2", other)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "one and the same" in got[1] and "one and the same" in got[2]
    assert got[2] == ("one and the same text of some length " * 3).strip() and got[3] == ("quite another text that is as long as that " * 3).strip()
    twins = spark.createDataFrame(rows[:2], "page_id long, url string, html string")
    assert all("one and the same" in r.text for r in H.extract(twins).collect())


@pytest.mark.parametrize("piece, end", [("<a ", ""), ("<a ", ">"), ('<a "', ""), ('<a "', ">"), ("<a '\" ", ">x"), ("<div>x</p>", ""), ("<b>", "<p></p>" * 100_000), ("<p><b>", ""), ("<script ", ""), ("</script ", ""), ("<script></script ", ""), ("<!--", ""), ("<![CDATA[", ""), ("<!", ""), ("<li><b>", ""), ("<ul><li>", "</ul>"), ("&", ""), ("&#9", ""), ("<p class=", ">"), ("<td><div>", ""), ("<", ">")])
def test_a_megabyte_of_anything_is_read_fast(piece, end):
    page = piece * (1_000_000 // len(piece)) + end
    began = time.process_time()
    H.lines(page)
    assert time.process_time() - began < 6  # a quadratic reader takes hours
    H.lines("&#" + "9" * 1_000_000 + ";<p>" + "&#00000000000065;")
