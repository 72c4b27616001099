"""Main text against a brute-force style tree, and on pages of known results."""

import math
import random
import xml.etree.ElementTree as ET
from collections import Counter, defaultdict

import pytest
from interfacet.llm import site_tree

SCHEMA = "page_id long, url string, html string"


def texts_of(spark, rows, **how):
    found = site_tree.extract(spark.createDataFrame(rows, SCHEMA), **how).collect()
    assert len(found) == len(rows)
    return {r["page_id"]: r["text"] for r in found}


def test_pages(spark):
    page = "<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>T&amp;t</h1><p>One<br>two<p>three<script>x('</p>')</script><div class=comments><p>no</div></article><footer>f</footer>"
    rows = [(1, "http://a.b/x", page), (2, None, None), (3, "http://a.b/y", ""), *[(i, "http://s.t/1", f"<body><div class=top><p>same here</p></div><div class=body><p>text {i}</p></div>") for i in range(10, 20)]]
    got = texts_of(spark, rows)
    assert got[1] == "T&t\n\nOne two\n\nthree" and got[2] == got[3] == ""
    assert all(got[i] == f"text {i}" for i in range(10, 20))


def test_importance_decides_inside_and_beside_articles(spark):
    page = lambda i: f"<body><div class=intro>intro {i}</div><div class=top>same</div><article><p>text {i}</p><div class=hint>call us</div></article></body>"
    copy = "<body><article><p>one text</p></article></body>"
    got = texts_of(spark, [*[(i, "http://s.t/1", page(i)) for i in range(10)], *[(20 + i, "http://c.d/1", copy) for i in range(9)]])
    assert all(got[i] == f"intro {i}\n\ntext {i}" for i in range(10)) and all(got[20 + i] == "one text" for i in range(9))


def test_names_around_the_only_article_are_not_believed(spark):
    whole = "<body><nav>menu</nav><form class='social page'><div class='share'><article><p>long text of the page</p><div class='comments'><p>me too</p></div></article></div></form></body>"
    cards = "<body><div class=post><p>the text of this post, which is long</p></div><div class=related><article>other</article></div></body>"
    aside = "<body><aside><article>quite a long teaser of something</article></aside><p>short</p></body>"
    got = texts_of(spark, [(1, "http://a.b/1", whole), (2, "http://a.b/2", cards), (3, "http://a.b/3", aside)])
    assert got == {1: "long text of the page", 2: "the text of this post, which is long", 3: "short"}


def brute(pages):
    """page to text: the style tree of one host whose pages are well-formed and have no named boilerplate."""
    def elements(root):
        stack = [(root, "", None)]
        while stack:
            e, path, up = stack.pop()
            own = path + "/" + e.tag + (("." + e.get("class")) if e.get("class") else "")
            yield e, own, up
            stack += [(c, own, own) for c in reversed(list(e))]

    seen = defaultdict(list)
    for html in set(pages.values()):
        at = defaultdict(lambda: ([], []))
        for e, path, _ in elements(ET.fromstring(html)):
            at[path][0].append("|".join(t.strip() for t in e.itertext() if t.strip()))
            at[path][1].append(tuple(c.tag + str(c.get("class")) for c in e))
        for path, (shown, style) in at.items():
            if any(shown):
                seen[path].append((tuple(shown), tuple(style)))
    low = set()
    for path, each in seen.items():
        m = len(each)
        if m < site_tree.PAGES:
            continue
        parts = []
        for k in (0, 1):
            n = Counter(x[k] for x in each)
            parts.append(sum(-c / m * math.log(c / m) for c in n.values()) / math.log(m))
        w = site_tree.DECAY ** len({x[1] for x in each})
        if (1 - w) * parts[1] + w * parts[0] < site_tree.LOW:
            low.add(path)
    out = {}
    for i, html in pages.items():
        keep, gone = [], set()
        for e, path, up in elements(ET.fromstring(html)):
            if path in low or up in gone:
                gone.add(path)
            elif (e.text or "").strip():
                keep.append(e.text.strip())
        out[i] = "\n\n".join(keep)
    return out


@pytest.mark.parametrize("sent", [site_tree.SENT, 0])
def test_style_tree_equals_brute_force(spark, sent):
    """Menus, notices and answers of readers whose classes say nothing."""
    r = random.Random(5)
    line = lambda n: " ".join(r.choice(["ab", "cd", "ef", "gh", "ij"]) + str(r.randrange(99)) for _ in range(n))
    pages = {}
    for i in range(40):
        menu = "".join(f"<li>entry {k}</li>" for k in range(6 if i % 5 else 5))
        body = "".join(f"<p>{line(12)}</p>" for _ in range(r.randint(1, 5)))
        notice = "<div class='x2'><p>we use small files</p></div>" if i % 4 else "<div class='x2'><p>we use small files</p><p>and more</p></div>"
        pages[i] = f"<body><div class='x1'><ul>{menu}</ul></div>{notice}<div class='x3'>{body}<div class='x4'><p>read on here</p></div></div><div class='x5'><p>{'made with care' if i % 9 else line(3)}</p></div></body>"
    pages[40] = pages[3]  # a copy
    got = texts_of(spark, [(i, "https://h.example/p", t) for i, t in pages.items()], sent=sent)
    assert got == brute(pages)
    assert not any("entry" in t or "small files" in t or "read on" in t for t in got.values()) and all(len(t) > 10 for t in got.values())


def test_odd_pages(spark):
    rows = [(1, "http://a.b/x", "<div>" * 3000 + "deep"), (1, "http://a.b/x", "<div>" * 3000 + "deep"), (None, "no host", "a &lt;b&gt; &#x41; <b>c</b>"), (4, "", "< p>x</p"), (5, "http://a.b/x", "<p>" + "word " * 200_000), (6, "http://q.r/", "<!-- never closed")]
    wide = spark.createDataFrame([(*r, "h", 0) for r in rows], SCHEMA + ", host string, page long")
    got = [(r["page_id"], r["text"]) for r in site_tree.extract(wide).collect()]
    assert len(got) == 6 and got.count((1, "deep")) == 2 and (None, "a <b> A c") in got and (6, "") in got
    assert dict(got)[5] == " ".join(["word"] * 200_000)
    assert site_tree.extract(wide.where("false")).count() == 0


def test_hostile_pages_take_linear_time():
    """Open tags, closing tags without an opening one, and marks that never end: twice the page, about twice the time."""
    import time

    for part in ("<ul>", "<!-", '<a "', "<p>", "<b>"):
        html = part * 40000 + "</i>" * 40000
        start = time.time()
        site_tree.parse(html)
        assert time.time() - start < 10  # a search of the whole stack or page at each tag takes minutes
    assert site_tree.parse("a<p>b<!-- c > d")[1] == [(0, "a"), (1, "b")]
    assert site_tree.parse("a<!-- > --> b <!-->c")[1] == [(0, "a b")]
