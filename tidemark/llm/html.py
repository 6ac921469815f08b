"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and every stretch of text is a node with a hidden label, content or not. A node's potential
comes from what it looks like (tag, words of its class, id and role, length and links of its text); the
potential between parent and child is the chance of the child's label given the parent's and the child's
tag. Sum-product messages, first from the leaves up, then from the root down, give each node's marginal of
being content; the text of a node is kept where it is above one half.

The potentials are counted on labelled pages: html whose elements carry label="1" (content) or label="0", an
unmarked one having its parent's. `fit` counts them from a table of such pages, of which it takes a bounded sample.
The tables here have none, so without a model of the caller's own `labelled_pages` writes them: layouts of articles in
varied containers between menus, headers, notices, adverts, forms, sidebars, reader comments and footers. Its names of
classes are what web authors call these things; a test holds pages against it that were written apart from it.

Blocks: text between the borders of block elements is one block; its character references are decoded, its
runs of white space (a line break element is one) become a space, and it is trimmed. Blocks with text are
joined in page order by line feeds.

Defined cases: null or empty html gives an empty text; broken html is read as far as it goes: an element that
is not closed ends with its parent or with what implies its end, stray end tags are passed over, an unclosed
comment, script or tag takes the rest of the page; a text whose chance is exactly one half is left out; pages of any
length and depth are read whole, in time in proportion to their length; rows that share a page_id, and repeated rows,
each give a row; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: What starts a tag, comment, marked section or declaration, and what can end a tag or begin a quoted value in it.
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: The most that one feature of a text may count, in log odds; names of elements may count 5.
TEXT_WEIGHT = 0.7
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names of HTML elements by what they do; fixed values of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose start ends an open one of these, up to the elements that hold it.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "datalist")), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "body": (("head",), ("html",))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an open paragraph can stay open in.
P_SCOPE = frozenset("button td th caption object table html".split())


class Node:
    __slots__ = ("tag", "attributes", "parent", "text", "links")

    def __init__(self, tag: str, attributes: str, parent: int, text: str | None = None):
        self.tag, self.attributes, self.parent, self.text, self.links = tag, attributes, parent, text, False


class _Stack:
    """The open elements, with the places of each tag, so the innermost of some tags is found without a search."""

    def __init__(self):
        self.nodes, self.tags = [0], ["#root"]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def innermost(self, tags: Iterable[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, tags: Iterable[str], holders: Iterable[str] = ()) -> None:
        """End the innermost element of the tags and all in it, unless a holder stands between."""
        at = self.innermost(tags)
        if not at or at < self.innermost(holders):
            return
        for tag in self.tags[at:]:
            self.places[tag].pop()
        del self.nodes[at:], self.tags[at:]


def _tag_end(page: str, at: int, missing: set[str]) -> int:
    """The place of the > that ends a tag, quoted values passed over; -1 without one. missing: quotes known not to follow."""
    while m := _STOP.search(page, at):
        if not m[1]:
            return m.start()
        at = m.end()
        if m[1] not in missing:
            close = page.find(m[1], at)
            if close >= 0:
                at = close + 1
            else:
                missing.add(m[1])  # an open quote: the tag ends at the next >
    return -1


def parse(page: str) -> list[Node]:
    """Nodes in page order, so parents stand before children; texts are nodes of the tag #text, their references decoded.

    Every step moves on in the page or closes elements that were opened once, so the time is linear in its length."""
    nodes = [Node("#root", "", -1)]
    stack = _Stack()
    at, size, missing = 0, len(page), set()

    def text(part: str) -> None:
        if part:
            nodes.append(Node("#text", "", stack.nodes[-1], entities.unescape(part) if "&" in part else part))

    def after(mark: str, start: int) -> tuple[int, int]:
        found = page.find(mark, start)
        return (found, found + len(mark)) if found >= 0 else (size, size)

    while at < size:
        m = _OPEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        if not m[2]:
            if m[0] == "<!--":
                at = after("-->", m.end())[1]
            elif m[0] == "<![CDATA[":
                end, at = after("]]>", m.end())
                nodes.append(Node("#text", "", stack.nodes[-1], page[m.end() : end]))
            else:
                at = after(">", m.end())[1]
            continue
        end = _tag_end(page, m.end(), missing)
        if end < 0:
            break  # a tag without an end takes the rest of the page
        at, tag, attributes = end + 1, m[2].lower(), page[m.end() : end]
        if m[1]:
            stack.close((tag,))
            continue
        if tag in BLOCK:
            stack.close(("p",), P_SCOPE)
        if tag in ENDS:
            stack.close(*ENDS[tag])
        if tag in HEADINGS and stack.tags[-1] in HEADINGS:
            stack.close((stack.tags[-1],))
        nodes.append(Node(tag, attributes, stack.nodes[-1]))
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            # what stands in such an element is no markup; a title's or text area's text is kept for its node
            nodes[-1].text = page[at : end.start() if end else size]
            at = (page.find(">", end.start()) + 1 or size) if end else size
            continue
        if not attributes.endswith("/"):
            stack.push(len(nodes) - 1, tag)
    return nodes


def _names(attributes: str) -> list[str]:
    """Words of the class, id and role of an element."""
    if not attributes or "=" not in attributes:
        return []
    return sorted({w.lower() for k, *v in _ATTRIBUTE.findall(attributes) if k.lower() != "label" for w in _NAME.findall("".join(v))})


def features(nodes: list[Node]) -> list[list[str]]:
    out = []
    for n in nodes:
        if n.tag == "#text":
            size = len(n.text)
            out.append([f"size={min(8, size.bit_length())}", f"link={n.parent > 0 and any(nodes[i].tag == 'a' for i in _up(nodes, n.parent, 2))}", f"stop={n.text.rstrip()[-1:] in '.!?:;' and size > 1}"])
        else:
            out.append([f"tag={n.tag}", *(f"name={w}" for w in _names(n.attributes))])
    return out


def _up(nodes: list[Node], i: int, most: int) -> Iterator[int]:
    while i > 0 and most:
        yield i
        i, most = nodes[i].parent, most - 1


class Model:
    """Log potentials: of a feature for each label, and of a child's label by its tag and the parent's label."""

    def __init__(self, pages: Iterable[str], weight: float = 0.5):
        feature: Counter = Counter()
        label_count: Counter = Counter()
        edge: Counter = Counter()
        for page in pages:
            nodes = parse(page)
            labels = []
            for n, own in zip(nodes, features(nodes), strict=True):
                mark = next((v for k, *v in _ATTRIBUTE.findall(n.attributes) if k.lower() == "label"), None)
                x = int("".join(mark)) if mark else (labels[n.parent] if n.parent >= 0 else 0)
                labels.append(x)
                kind = n.tag == "#text"
                label_count[kind, x] += 1
                feature.update((f, x) for f in own)
                if n.parent >= 0:
                    edge[n.tag, labels[n.parent], x] += 1
                    edge[None, labels[n.parent], x] += 1
        self.feature: dict[str, float] = {}
        for f in {f for f, _ in feature}:
            kind = f.split("=")[0] in ("size", "link", "stop")
            p = [(feature[f, x] + weight) / (label_count[kind, x] + 2 * weight) for x in (0, 1)]
            # a tag is already in the edge; alone it would count twice. What a text looks like tells little.
            most = 0.0 if f.startswith("tag=") else TEXT_WEIGHT if kind else 5.0
            self.feature[f] = max(-most, min(most, math.log(p[1] / p[0])))
        self.edge: dict[str | None, tuple[float, float]] = {}
        for tag in {t for t, _, _ in edge}:
            self.edge[tag] = tuple((edge[tag, up, 1] + weight * self._prior(edge, up)) / (edge[tag, up, 0] + edge[tag, up, 1] + weight) for up in (0, 1))

    @staticmethod
    def _prior(edge: Counter, up: int) -> float:
        a, b = edge[None, up, 1], edge[None, up, 0]
        return (a + 0.5) / (a + b + 1)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's chance of being content, by messages up the tree and down again."""
        n = len(nodes)
        get = self.feature.get
        other = self.edge.get(None, (0.1, 0.9))
        own1 = [math.exp(sum(get(f, 0.0) for f in fs)) for fs in features(nodes)]  # against 1 for the other label
        up0, up1 = [1.0] * n, own1[:]
        to0, to1 = [1.0] * n, [1.0] * n
        edges = [self.edge.get(x.tag, other) for x in nodes]
        for i in range(n - 1, 0, -1):
            p0, p1 = edges[i]
            a = up0[i] * (1 - p0) + up1[i] * p0
            b = up0[i] * (1 - p1) + up1[i] * p1
            s = a + b
            to0[i], to1[i] = a / s, b / s
            j = nodes[i].parent
            up0[j] *= to0[i]
            up1[j] *= to1[i]
            s = up0[j] + up1[j]
            up0[j] /= s
            up1[j] /= s
        out = [0.0] * n
        out[0] = 0.0  # the page itself is no content
        for i in range(1, n):
            j, (p0, p1) = nodes[i].parent, edges[i]
            # the parent's belief without what this child told it
            a, b = (1 - out[j]) / to0[i], out[j] / to1[i]
            s = a + b
            a, b = a / s, b / s
            d1 = up1[i] * (a * p0 + b * p1)
            d0 = up0[i] * (a * (1 - p0) + b * (1 - p1))
            out[i] = d1 / (d0 + d1)
        return out

    def extract(self, page: str) -> str:
        nodes = parse(page)
        chance = self.marginals(nodes)
        blocks: list[str] = []
        held: list[str] = []
        block_of = [0] * len(nodes)

        def flush() -> None:
            if held:
                if t := " ".join("".join(held).split()):
                    blocks.append(t)
                held.clear()

        last = 0
        for i, x in enumerate(nodes):
            if i:
                block_of[i] = i if x.tag in BLOCK else block_of[x.parent]
            if block_of[i] != last:
                flush()
                last = block_of[i]
            if x.tag == "br":
                held.append(" ")
            elif x.tag == "#text" and chance[i] > 0.5:
                held.append(x.text)
        flush()
        return "\n".join(blocks)


def labelled_pages(count: int = 400, seed: int = 7) -> list[str]:
    """Pages whose elements carry label="1" (content) or label="0"; unmarked ones have their parent's label."""
    r = random.Random(seed)
    syllables = "ka lo mi ter an be sto ri den fa gu no per sil ta vo".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(3, 14).capitalize() + r.choice("...!?") for _ in range(r.randint(a, b)))

    def links(tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="#">{words(1, 3)}</a></{tag}>' for _ in range(r.randint(2, 8)))

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.70:
            return f"<p>{r.choice(['', '<b>', '<em>'])}{sentences(1, 6)}{r.choice(['</p>', '', '<br>'])}"
        if kind < 0.78:
            return f"<h2>{words(2, 6)}</h2>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{sentences(1, 2)}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote><p>{sentences(1, 3)}</p></blockquote>"
        if kind < 0.92:
            return f'<figure><img src="x.png"><figcaption>{sentences(1, 1)}</figcaption></figure>'
        if kind < 0.95:
            return f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>"
        if kind < 0.97:
            return f"<pre>{words(3, 9)}</pre>"
        return f'<p>{sentences(1, 2)} <a href="#">{words(1, 4)}</a> {sentences(1, 2)}</p>'

    def boilerplate(where: str) -> str:
        mark = 'label="0"'
        top = [
            lambda: f"<nav {mark}><ul>{links()}</ul></nav>", lambda: f"<header {mark}><h1>{words(1, 3)}</h1><p>{words(2, 6)}</p></header>", lambda: f'<div {mark} class="{r.choice(["menu", "nav", "navigation", "topbar", "breadcrumb", "site-header", "header", "masthead"])}">{links(r.choice(["li", "span"]))}</div>',
            lambda: f'<div {mark} {r.choice(["class", "id"])}="{r.choice(["cookie-notice", "notice", "cookie", "consent", "alert", "popup", "newsletter", "subscribe", "promo", "banner"])}"><p>{sentences(1, 2)}</p></div>',
            lambda: f'<form {mark} class="search"><label>{words(1, 2)}</label><input name="q"><button>{words(1, 1)}</button></form>',
        ]
        any_ = [
            lambda: f'<div {mark} class="{r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "ad-slot"])}">{r.choice([sentences(1, 2), "<p>" + sentences(1, 2) + "</p>"])}</div>', lambda: f"<aside {mark}>{r.choice(['', '<h3>' + words(1, 3) + '</h3>'])}{r.choice(['<p>' + sentences(1, 3) + '</p>', '<ul>' + links() + '</ul>'])}</aside>",
            lambda: f'<div {mark} class="{r.choice(["share", "social", "related", "recommended", "tags", "widget", "sidebar", "more"])}">{r.choice(["<ul>" + links() + "</ul>", "<p>" + sentences(1, 2) + "</p>"])}</div>',
        ]
        bottom = [
            lambda: f"<footer {mark}>{r.choice(['', '<p>'])}&copy; {sentences(1, 2)}</footer>", lambda: f'<div {mark} class="{r.choice(["footer", "copyright", "legal", "site-footer", "bottom"])}">{sentences(1, 2)}</div>',
            lambda: f'<section {mark} class="comments"><h2>{words(1, 2)}</h2>' + "".join(f'<div class="comment"><p>{sentences(1, 5)}</p></div>' for _ in range(r.randint(1, 5))) + "</section>",
            lambda: f'<div {mark} id="{r.choice(["comments", "respond", "disqus", "discussion", "replies"])}"><ol class="commentlist">' + "".join(f'<li class="reply"><p>{sentences(1, 4)}</p></li>' for _ in range(r.randint(1, 5))) + "</ol></div>",
            lambda: f'<form {mark} class="{r.choice(["contact", "comment-form", "signup"])}"><p>{words(2, 5)}</p><textarea></textarea><button>{words(1, 1)}</button></form>',
        ]
        return r.choice({"top": top + any_, "any": any_, "bottom": bottom + any_}[where])()

    out = []
    for _ in range(count):
        tag, name = r.choice([("article", ""), ("article", 'class="post"'), ("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("div", 'class="article-body"'), ("div", 'class="entry-content"'), ("section", 'class="post-body"'), ("div", 'id="article"'), ("div", 'class="story text"'), ("div", 'class="main"')])
        body = [r.choice(["", f"<h1>{words(3, 8)}</h1>"])]
        for _ in range(r.randint(1, 9)):
            body.append(paragraph())
            if r.random() < 0.08:
                body.append(boilerplate("any"))
        if r.random() < 0.15:
            body.append(boilerplate("bottom"))
        article = f'<{tag} {name} label="1">{"".join(body)}</{tag}>'
        for _ in range(r.choice([0, 0, 1, 2])):
            article = f'<{r.choice(["div", "section", "main"])} {r.choice(["", f'class="{r.choice(["wrapper", "container", "page", "row", "layout"])}"'])} label="0">{"".join(boilerplate("any") for _ in range(r.choice([0, 0, 1])))}{article}{"".join(boilerplate("any") for _ in range(r.choice([0, 0, 1])))}</div>'
        head = f"<head><title>{words(2, 6)}</title><style>p{{}}</style><script>var a = 1;</script></head>"
        out.append(f"<!DOCTYPE html><html>{head}<body>{''.join(boilerplate('top') for _ in range(r.randint(0, 4)))}{article}{''.join(boilerplate('bottom') for _ in range(r.randint(0, 4)))}</body></html>")
    return out


#: Labelled pages that a model is fitted on at most, about.
SAMPLE = 5_000


def fit(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled pages (html): all of them, or a sample of about `sample` chosen by a hash of the html."""
    rows = pages.select(F.col("html").cast("string").alias("html")).where("html is not null")
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("html"), F.lit(1_000_003)) < sample / n * 1_000_003)
    return Model(sorted(r["html"] for r in rows.toLocalIterator()))


def _extracted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for b in batches:
        t = [model.extract(x) if x else "" for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(t, pa.string()), pa.array(np.fromiter(map(len, t), np.int64, len(t)))], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model or Model(labelled_pages()))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(lambda it: _extracted(it, shared), "page_id long, url string, text string, n_chars long")
