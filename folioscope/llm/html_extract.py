"""Main text by site style trees.

The element trees of all pages of a host are merged by their path of tags and classes. For each
node two entropies tell how much it varies over the host's distinct contents: of its presentation
(the sequence of child tags) and of its content (the text below it), both relative to the number
of contents. Pages that carry one article under different advertisements or counters are one
content (`page_content`) and weigh once, by the one with the smallest digest. The entropies' mean is the node's importance: menus, notices and footers repeat and score low,
articles differ and score high. Branches below `LEAST` are removed. With few pages a host tells
little, so its figures are drawn towards those of the same path over all hosts (`DRAWN` pages'
worth), and what a page's own mark-up says outright (landmark elements, scripts, forms, class
names such as "sidebar" or "comments") is followed as well. An article or main element and what
is inside are never removed for low importance, only by their own mark-up: a text that all pages
share is still text.

The first pass emits one row for each page and node; they are reduced by (host, content, node),
then by (host, node, digest), before hosts meet, so a host of any size is spread over tasks. The second pass rereads the pages
with the few low nodes of their host.

Cases: null and empty html give an empty text; unclosed, misnested and cut-off mark-up is read as
browsers do (a cut-off tag at the end is dropped); pages of equal content on a host count once; a
null url belongs to the host ""; equal rows give equal rows; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bounded_batches, sliced
from folioscope.session import staged

LEAST, DRAWN = 0.3, 10

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
CUT_OFF = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element kinds of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
          "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
LANDMARKS = {"nav", "footer", "aside", "form", "template", "svg", "math", "button", "select", "dialog", "menu", "head", "canvas", "object", "audio", "video", "fieldset"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "sidebar", "menu", "nav", "navbar",
         "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup",
         "modal", "overlay", "comment", "comments", "disqus", "reply", "replies", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe",
         "signup", "login", "search", "widget", "toolbar", "pagination", "pager", "copyright", "disclaimer", "banner", "teaser"}
HOLDERS = {"content", "main", "article", "wrapper", "container", "page", "body", "entry", "post", "with", "has", "layout", "story"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
            "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Node:
    """An open element on the way through a page."""

    __slots__ = ("tag", "path", "noise", "main")

    def __init__(self, tag: str, path: int, noise: bool, main: bool):
        self.tag, self.path, self.noise, self.main = tag, path, noise, main


class Blocks:
    """The blocks of text that are kept of a page."""

    def __init__(self):
        self.found: list[tuple[bool, str]] = []
        self.pieces: list[str] = []
        self.main, self.last = False, False

    def add(self, node: Node, value: str) -> None:
        self.pieces.append(value)
        self.last = node.main

    def border(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.found.append((self.last, text))
            self.pieces.clear()

    def texts(self) -> list[str]:
        """If the page has an article or main element, only what is inside."""
        self.border()
        return [text for main, text in self.found if main or not self.main]


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def named_noise(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """What the mark-up itself calls something other than main text."""
    if tag in LANDMARKS or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower()))
    if inside:
        words.discard("header")
    return bool(words & NAMES) and not words & HOLDERS


def walk(page: str, visit) -> None:
    """Runs through a page. visit(kind, node, value): "open" with a block element, "text" with a
    piece of decoded text and its block element, "break" at every block border."""
    top = Node("", 0, False, False)
    stack = [top]
    page = CUT_OFF.sub("", page)
    at, end = 0, len(page)

    def close(to: int) -> None:
        if any(n.tag not in INLINE for n in stack[to:]):
            visit("break", stack[-1], None)
        del stack[to:]

    while at < end:
        found = TOKEN.search(page, at)
        piece = page[at:found.start() if found else end]
        if piece:
            visit("text", stack[-1], html.unescape(piece))
        if not found:
            return
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag not in INLINE or all(n.tag in INLINE for n in stack[i:]):
                        close(i)
                    break
            else:
                if tag == "p":
                    visit("break", stack[-1], None)
            continue
        if tag == "br":
            visit("text", stack[-1], " ")
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in SIBLINGS:
            same, scope = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in scope:
                    break
                if stack[i].tag in same:
                    close(i)
                    if tag != "tr" or stack[-1].tag not in same:
                        break
        if tag in VOID:
            if tag not in INLINE:
                visit("break", stack[-1], None)
            continue
        up = stack[-1]
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(found[3])} if found[3].strip() else {}
        noise = up.noise or named_noise(tag, attributes, up.main)
        if tag in INLINE:
            stack.append(Node(tag, up.path, noise, up.main))
        else:
            label = f"{tag}.{re.sub('[0-9]+', '#', attributes.get('class', ''))}#{re.sub('[0-9]+', '#', attributes.get('id', ''))}"
            node = Node(tag, xxhash.xxh64_intdigest(f"{up.path}>{label}") >> 1, noise, up.main or tag in ("article", "main"))
            visit("break", up, None)
            visit("open", node, up)
            stack.append(node)
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            at = stop.start() if stop else end


def page_content(blocks: Blocks) -> int:
    """Digest of what a page says, whatever stands around it: the text of its article or main
    element, else its longest blocks outside noise that make up half of that text."""
    texts = blocks.texts()
    if not blocks.main:
        half, longest = sum(map(len, texts)) / 2, []
        for text in sorted(texts, key=lambda t: (-len(t), t)):
            if half <= 0:
                break
            longest.append(text)
            half -= len(text)
        texts = longest
    return xxhash.xxh64_intdigest("\n".join(texts)) >> 1


def page_nodes(page: str) -> tuple[int, list[tuple[int, int, int]]]:
    """The content of a page and (path, presentation, content) of every path of its block
    elements: digests of its child tags and of the text below it."""
    blocks = Blocks()
    children: dict[int, list[str]] = {}
    parents: dict[int, int] = {}
    texts: dict[int, list[str]] = {}

    def visit(kind, node, value):
        if kind == "text" and not node.noise:
            blocks.add(node, value)
        elif kind != "text":
            blocks.border()
        if kind == "open":
            blocks.main |= node.main and not node.noise
            children.setdefault(value.path, []).append(node.tag)
            children.setdefault(node.path, [])
            parents[node.path] = value.path
        elif kind == "text" and node.tag not in RAW:
            words = value.split()
            if words:
                texts.setdefault(node.path, []).extend(words)

    walk(page, visit)
    below = {path: xxhash.xxh64() for path in children}
    for path, words in texts.items():
        digest = " ".join(words)
        while path in below:
            below[path].update(f"{len(digest)}:{digest}")
            if path not in parents:
                break
            path = parents[path]
    return page_content(blocks), [(path, xxhash.xxh64_intdigest(" ".join(tags)) >> 1, below[path].intdigest() >> 1) for path, tags in children.items() if path]


def main_text(page: str, low: set[int]) -> str:
    """The text of a page without noise and without branches at the paths in low, a block a
    paragraph. If the page has an article or main element, all of it that isn't noise."""
    blocks = Blocks()
    removed: set[int] = set()

    def visit(kind, node, value):
        if kind == "text":
            if not node.noise and node.path not in removed:
                blocks.add(node, value)
            return
        blocks.border()
        if kind == "open":
            blocks.main |= node.main and not node.noise
            if not node.main and (value.path in removed or node.path in low):
                removed.add(node.path)

    walk(page, visit)
    return "\n\n".join(blocks.texts())


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, path, importance) of every node of every host's merged tree."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                if page:
                    digest, (says, found) = xxhash.xxh64_intdigest(page) >> 1, page_nodes(page)
                    rows += [(h, says, digest, *n) for n in found]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["host", "says", "page", "path", "presentation", "content"])

    rows = bounded_batches(pages).select(host(F.col("url")).alias("host"), "html").mapInArrow(nodes, "host string, says long, page long, path long, presentation long, content long")
    seen = rows.groupBy("host", "says", "path").agg(F.min(F.struct("page", "presentation", "content")).alias("one")).select("host", "path", "one.presentation", "one.content")

    def spread(value: str) -> DataFrame:
        """Entropy parts: contents m and the sum of c ln c over the values, for each host and path."""
        counts = seen.groupBy("host", "path", value).agg(F.count(F.lit(1)).alias("c"))
        return counts.groupBy("host", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))

    def relative(m: Column, s: Column) -> Column:
        return F.when(m > 1, (F.log(m) - s / m) / F.log(m)).otherwise(F.lit(1.0))

    presentation, content = spread("presentation"), spread("content")
    own = presentation.join(content.select("host", "path", F.col("s").alias("s2")), ["host", "path"])
    own = staged(own.select("host", "path", "m", ((relative(F.col("m"), F.col("s")) + relative(F.col("m"), F.col("s2"))) / 2).alias("own")), "style-nodes")
    # The path over all hosts: the hosts' figures weighted by contents, from nodes that can tell.
    told = own.where("m > 1").groupBy("path").agg((F.sum(F.col("m") * F.col("own")) / F.sum("m")).alias("all"))
    drawn = (F.col("m") * F.col("own") + DRAWN * F.coalesce("all", F.lit(1.0))) / (F.col("m") + DRAWN)
    return own.join(told, "path", "left").select("host", "path", drawn.alias("importance"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    low = style_trees(pages).where(F.col("importance") < LEAST).groupBy("host").agg(F.collect_list("path").alias("low"))
    low = staged(low.withColumnRenamed("host", "_host"), "low-branches")
    joined = pages.select("page_id", "url", "html").withColumn("_own_host", host(F.col("url")))
    joined = joined.join(low, F.col("_own_host") == F.col("_host"), "left").select("page_id", "url", "html", "low")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(page, set(low or ())) if page else "" for page, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
