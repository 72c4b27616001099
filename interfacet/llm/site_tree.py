"""Main text of web pages by a site style tree.

The DOMs of a host are merged into one tree of style nodes (tag and class on the path from the root).
A node's importance joins the entropy of how its children are laid out on the host's pages
(presentation) and of what it shows there (content), each as a share of the most it can be: menus,
notices and footers look and read alike on many pages, articles don't. Branches of low importance go
on every page, inside articles too; copies of a page count once. Beside an article, other text stays
where its importance is known and not low. A page whose whole article is of low importance keeps it.

Tags and class words that name boilerplate are a prior: such branches go at any importance, since what
entropy can't part (an advert that is another one on each page) they can. The names around an article
are not believed where it holds more text than all that no name removes.

Null and empty html gives an empty text; pages without a host form one site; repeated rows get equal
results; an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import html as references
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, materialize, rows

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# HTML element kinds.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title"}
DROPPED = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "menu", "dialog"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | DROPPED
CLOSES_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"article", "body", "div", "main", "section", "td", "li", "blockquote"}}
BOILERPLATE = {"ad", "ads", "adv", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "disqus", "footer", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget"}
CONTENT = {"article", "main"}
NEVER = DROPPED - {"form"}  # a form may hold a whole page
LOW = 0.3  # importance below which a branch goes
PAGES = 4  # pages a node must be on before its importance counts
DECAY = 0.9  # what each way of laying a node out takes from the weight of its content
SENT = 2_000_000  # rated nodes that are sent to all tasks (16 MB); more are joined to their pages


class Node(NamedTuple):
    """An element of a page that can hold blocks; the root has parent -1."""

    parent: int
    key: int  # of the style node: hash of the path
    tag: str
    content: bool  # article or main, or in one
    bad: int  # 1 where its class words or a form say boilerplate, 2 where its tag does


def named(tag: str, attributes: str) -> tuple[str, set[str]]:
    """Name of a style node and the words of its class, id and role."""
    found = [(m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "").lower()) for m in NAMED.finditer(attributes)] if attributes else []
    words = {w for _, v in found for w in re.split(r"[^a-z]+", v) if w}
    return tag + "".join(f".{v}" for k, v in found if k == "class"), words


class Stack:
    """Open elements, with the places of each tag at hand, so that no search walks the whole stack."""

    def __init__(self):
        self.items: list[tuple[str, int]] = [("", 0)]  # tag, element (of the nearest one that can hold blocks)
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tags) -> int:
        """The place of the innermost open element of tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, tag: str, element: int) -> None:
        self.places.setdefault(tag, []).append(len(self.items))
        if tag in BLOCKS:
            self.blocks.append(len(self.items))
        self.items.append((tag, element))

    def cut(self, upto: int) -> None:
        while len(self.items) > upto:
            self.places[self.items.pop()[0]].pop()
        while self.blocks and self.blocks[-1] >= upto:
            self.blocks.pop()


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The elements of a page, parents first, and its blocks of text (element, text) in page order, in time that grows with the page."""
    import xxhash

    nodes = [Node(-1, 0, "", False, 0)]
    stack = Stack()
    out: list[tuple[int, str]] = []
    held: list[str] = []

    def flush():
        text = " ".join(references.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((stack.items[-1][1], text))

    def close(upto: int):
        flush()
        stack.cut(upto)

    at, end = 0, len(html)
    tags = html.rfind(">") + 1  # no tag ends behind it, so none is looked for
    while at < end:
        m = TAG.search(html, at, tags) if at < tags else None
        comment = html.find("<!--", at, m.start() if m else end) if m is None or m.start() > at else -1
        if comment >= 0:  # one that is never closed
            held.append(html[at:comment])
            break
        if m is None:
            held.append(html[at:])
            break
        held.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not (m[0].endswith("-->") and len(m[0]) > 6):
                break
            continue
        tag = m[2].lower()
        if m[1]:
            i = stack.last((tag,))
            if i and tag in BLOCKS:
                close(i)
            elif i and not (stack.blocks and stack.blocks[-1] >= i):
                stack.cut(i)
            continue
        if tag in BLOCKS:
            flush()
        if tag == "br":
            held.append(" ")
        if tag in VOID:
            continue
        for names, scope in ((SAME.get(tag), SCOPE.get(tag)), ({"p"} if tag in CLOSES_P else None, SCOPE["p"])):
            if names and (i := stack.last(names)) > stack.last(scope or ()):
                close(i)
        element = stack.items[-1][1]
        if tag in BLOCKS:
            name, words = named(tag, m[3])
            above = nodes[element]
            bad = 2 if tag in NEVER else 1 if tag == "form" or words & BOILERPLATE or (not above.content and (tag == "header" or "header" in words)) else 0
            nodes.append(Node(element, xxhash.xxh3_64_intdigest(f"{above.key:x}/{name}"), tag, above.content or tag in CONTENT or "main" in words, bad))
            element = len(nodes) - 1
        stack.push(tag, element)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else end
            stack.cut(len(stack.items) - 1)
    flush()
    return nodes, out


def believed(nodes: list[Node], blocks: list[tuple[int, str]]) -> list[bool]:
    """For each element whether tags and names say boilerplate."""
    bad: list[int] = []
    for n in nodes:
        bad.append(max(n.bad, bad[n.parent] if n.parent >= 0 else 0))
    clean = sum(len(t) for e, t in blocks if not bad[e])
    size: dict[int, int] = {}  # text of articles that only names remove, by their outermost element
    inside: list[int] = []
    for i, n in enumerate(nodes):
        above = inside[n.parent] if n.parent >= 0 else -1
        inside.append(above if above >= 0 else i if n.tag in CONTENT and bad[i] == 1 else -1)
    for e, t in blocks:
        if inside[e] >= 0:
            size[inside[e]] = size.get(inside[e], 0) + len(t)
    top = max(size, key=lambda i: (size[i], -i), default=-1)
    if top < 0 or size[top] <= clean:
        return [b > 0 for b in bad]
    around = nodes[top].parent
    while around >= 0:
        bad[around] = 0
        around = nodes[around].parent
    for i, n in enumerate(nodes):
        if inside[i] == top:
            bad[i] = 0 if i == top else max(n.bad, bad[n.parent])
    return [b > 0 for b in bad]


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def node_key(site: str, key: int) -> int:
    """Key of a style node of a site, as a signed 64-bit number."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(f"{site}/{key:x}")).astype(np.int64))


def shown_by(site: str, html: str) -> dict[int, tuple[int, int]]:
    """For each style node of a page: hashes of what it shows and of how its children are laid out."""
    nodes, blocks = parse(html)
    mask = (1 << 63) - 1
    from zlib import crc32

    text, style = [0] * len(nodes), [0] * len(nodes)
    for e, t in blocks:
        text[e] = (text[e] * 1000003 + crc32(t.encode("utf-8", "surrogatepass")) + 1) & mask
    for i in range(len(nodes) - 1, 0, -1):  # children before their parents
        above = nodes[i].parent
        text[above] = (text[above] * 1000003 + text[i]) & mask
        style[above] = (style[above] * 1000003 + nodes[i].key) & mask
    out: dict[int, tuple[int, int]] = {}
    for n, t, s in zip(nodes[1:], text[1:], style[1:], strict=True):
        if t:
            a, b = out.get(n.key, (0, 0))
            out[n.key] = (a * 31 + t) & mask, (b * 31 + s) & mask
    return {node_key(site, k): v for k, v in out.items()}


def style_nodes(pages: DataFrame) -> DataFrame:
    """node, shown, style, page (hash of the page): a row for each page and style node that shows text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found, pages_ = [], []
            for site, page, h in rows(batch):
                one = shown_by(site, page or "")
                found += [(k, *v) for k, v in one.items()]
                pages_ += [h] * len(one)
            yield pa.RecordBatch.from_arrays([*(pa.array([f[i] for f in found], pa.int64()) for i in range(3)), pa.array(pages_, pa.int64())], names=["node", "shown", "style", "page"])

    return pages.select("host", "html", F.xxhash64("html")).mapInArrow(run, "node long, shown long, style long, page long")


def entropy(nodes: DataFrame, what: str) -> DataFrame:
    """node, m (pages), kinds of `what` and its entropy as a share of the most it can be; pages that are copies count once."""
    each = nodes.groupBy("node", what).agg(F.countDistinct("page").alias("n"))
    total = each.groupBy("node").agg(F.sum("n").alias("m"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log("n")).alias("s"))
    return total.select("node", "m", "kinds", F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0).alias(what))


def rated(nodes: DataFrame) -> DataFrame:
    """node, n (pages), low: nodes that enough pages have, and whether their importance is below LOW.

    Importance is (1 - w) times the entropy of presentation and w times that of content, with
    w = DECAY ** (ways the node is laid out).
    """
    style, content = entropy(nodes, "style"), entropy(nodes, "shown").select("node", "shown")
    w = F.pow(F.lit(DECAY), F.col("kinds"))
    both = style.where(F.col("m") >= PAGES).join(content, "node")
    return both.select("node", F.col("m").alias("n"), ((1 - w) * F.col("style") + w * F.col("shown") < LOW).alias("low"))


def among(key: np.ndarray, known: np.ndarray) -> list[bool]:
    """Whether each key is in known, which is sorted."""
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return (known[at] == key).tolist() if len(known) else [False] * len(key)


def main_text(site: str, html: str, low: np.ndarray, high: np.ndarray) -> str:
    """The text of a page; low and high: sorted keys of the site's nodes of low and of other known importance."""
    nodes, blocks = parse(html)
    bad = believed(nodes, blocks)
    key = np.array([node_key(site, n.key) for n in nodes], np.int64)
    gone, rare = among(key, low), among(key, high)
    for i in range(1, len(nodes)):
        gone[i] |= gone[nodes[i].parent]
    clean = [(e, t) for e, t in blocks if not bad[e]]
    article = any(nodes[e].content for e, _ in clean)
    whole = article and all(gone[e] for e, _ in clean if nodes[e].content)
    return "\n\n".join(t for e, t in clean if (whole and nodes[e].content) or (not gone[e] and (nodes[e].content or not article or rare[e])))


def extract(pages: DataFrame, sent: int = SENT) -> DataFrame:
    """page_id, url, text of every row of pages."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host("url").alias("host"))
    nodes = materialize(style_nodes(source))
    known = materialize(rated(nodes))
    result = "page_id long, url string, text string"

    def texts(batch, sent_to_all=None):
        import pyarrow as pa

        ids, urls, out = [], [], []
        for page_id, url, page, site, *own in rows(batch):
            low, high = sent_to_all or (np.sort(np.array(keys or [], np.int64)) for keys in own)
            ids.append(page_id), urls.append(url), out.append(main_text(site, page or "", low, high))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    if known.count() <= sent:
        keys = [np.sort(np.array([r[0] for r in known.where(F.col("low") == flag).select("node").toLocalIterator()], np.int64)) for flag in (True, False)]
        to_all = pages.sparkSession.sparkContext.broadcast(keys)

        def run(batches):
            for batch in batches:
                yield texts(batch, to_all.value)

        return source.select("page_id", "url", "html", "host").mapInArrow(run, result)

    # Too many to send: each page gets the rated nodes that it has.
    on_page = joined(nodes.select("node", "page").distinct(), known, ["node"])
    lists = on_page.groupBy("page").agg(*[F.collect_list(F.when(F.col("low") == flag, F.col("node"))).alias(name) for name, flag in (("low", True), ("high", False))])
    keyed_ = source.withColumn("page", F.xxhash64("html")).join(lists, "page", "left")

    def run_own(batches):
        for batch in batches:
            yield texts(batch)

    return keyed_.select("page_id", "url", "html", "host", "low", "high").mapInArrow(run_own, result)
