"""Main text of web pages: site style trees decide which branches are noise."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bound_batches, fresh, texts_of, written

#: Branches under this importance (0 to 1) are noise; those whose names speak against them, under the second.
MIN_IMPORTANCE = 0.3
MIN_NAMED_IMPORTANCE = 0.6
#: Noise branches of a host that go with each of its pages; and into how many parts the pages of a host with more are dealt.
MOST_PATHS, SALTS = 1000, 16
#: How much of a node's importance each of its styles hands on to what is below it.
GAMMA = 0.9
#: Levels of a style tree; what lies deeper counts for its ancestor there.
LEVELS = 24

# Elements of HTML by their part in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
NEVER = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "object", "canvas", "audio", "video", "map", "search", "fieldset"} | RAW
HELD = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li", "pre"}
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
SCOPE = {"ul", "ol", "dl", "table", "select", "html", "body", "article", "section", "div", "blockquote", "main"}
NOISE_NAMES = {
    "ad", "ads", "adv", "alert", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "cta", "discussion", "disqus", "footer",
    "gdpr", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "privacy", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share",
    "sharing", "sidebar", "sidebars", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets",
}
STRONG_NAMES = {"ad", "ads", "advert", "advertisement", "comment", "comments", "commentlist", "disqus", "sponsored"}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "details", "center", "ins", "figure"}
NOISE_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}

#: Classes of adverts and reader comments, as they are written out; names that are read as comments.
STRONG_CLASSES = {
    "ad", "ad-banner", "ad-block", "ad-box", "ad-container", "ad-slot", "ad-unit", "ad-wrapper", "ads", "adsbygoogle", "advert", "advertisement", "comment", "comment-list", "comment-section", "commentlist", "comments",
    "comments-area", "comments-section", "sponsored",
}
COMMENT_NAMES = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond"}
#: Longer labels are told apart by their hash.
LONGEST_LABEL = 80

# What never gives back a character that it has taken, so a failure costs one pass; a quote that is not closed is a character like others.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|[^<]++|<", re.S)
_NAME = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[|·•©]+|[.!?;]+(?=\s|$)")


@dataclass
class Node:
    """An element. label names it in the style tree: its tag, id and classes, digits left out; path: labels of the block elements from the root to it, LEVELS at most.

    noise: 3 by its tag or role, 2 if it is a container with a name of adverts or reader comments, 1 by another name, else 0. whole: whether such a name stands by itself, as an id or class; strong: whether
    one of its classes is in STRONG_CLASSES; comment: whether it has a name of comments. main: whether it is in an article or main element. held: whether it has a heading or paragraph in it. named: whether it
    or what it is in has noise. block: the nearest block element, itself included; scoped: the nearest element that may end others or be ended by them.
    """

    tag: str
    label: str
    noise: int
    main: bool
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)
    held: bool = False
    whole: bool = False
    strong: bool = False
    comment: bool = False
    path: str = ""
    depth: int = 0
    named: bool = False
    block: Node | None = None
    scoped: Node | None = None

    def __post_init__(self) -> None:
        up = self.parent
        self.path, self.depth = (up.path, up.depth) if up is not None else ("", 0)
        if self.tag in BLOCK and self.depth < LEVELS:
            self.path, self.depth = f"{self.path}>{self.label}" if self.depth else self.label, self.depth + 1
        self.named = self.noise > 0 or up is not None and up.named
        self.block = self if self.tag in BLOCK or up is None else up.block
        self.scoped = self if self.tag in SCOPE or self.tag in _CLOSABLE or up is None else up.scoped


_CLOSABLE = set().union(*CLOSED_BY.values())


def _node(tag: str, attributes: str, parent: Node | None) -> Node:
    names: list[str] = []
    classes: list[str] = []
    hidden, role = False, ""
    if attributes.strip(" /\t\n\r"):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                names += value.split()
                classes += value.split() if name == "class" else []
            elif name == "role":
                role = value.lower().strip()
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                hidden = True
    main = parent is not None and (parent.main or _is_main(parent))
    words = {w.lower() for n in names for w in _WORD.findall(n)}
    noise = 0
    if tag in NEVER or role in NOISE_ROLES or hidden or (tag == "header" and not main):
        noise = 3
    elif words & STRONG_NAMES and tag in CONTAINERS:
        noise = 2
    elif words & NOISE_NAMES and tag not in ("html", "body", "main", "article") or "header" in words and tag not in ("html", "body") and not main:
        noise = 1
    label = re.sub(r"\d+|>", "#", ".".join([tag, *sorted({n.lower() for n in names})]))
    if len(label) > LONGEST_LABEL:
        label = f"{tag}.~{xxhash.xxh3_64_hexdigest(label.encode())}".translate(_LETTERS)
    out = Node(tag, label, noise, main or role == "main", parent, whole=not NOISE_NAMES.isdisjoint(n.lower() for n in names), strong=not STRONG_CLASSES.isdisjoint(n.lower() for n in classes), comment=bool(words & COMMENT_NAMES))
    if tag in HELD:
        while parent is not None and not parent.held:
            parent.held, parent = True, parent.parent
    return out


#: Digits of a hash as letters, as labels have none.
_LETTERS = str.maketrans("0123456789", "ghijklmnop")


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main")


def parse(page: str) -> Node:
    """The tree of a page; tolerates missing end tags, stray end tags, quotes and tags that are not closed, and markup inside scripts. Linear in the page: no step goes back over what a former one has read."""
    root = _node("html", "", None)
    open_, at, n = root, 0, len(page)
    opened = Counter({"html": 1})
    tags = _TAG
    last = page.rfind(">")

    def close(node: Node) -> Node:
        """Leaves all elements up to node and it."""
        nonlocal open_
        while True:
            gone, open_ = open_, open_.parent
            opened[gone.tag] -= 1
            if gone is node:
                return open_

    while at < n:
        m = tags.match(page, at) if at < last and page[at] == "<" else None
        if m is None and at < last and tags is _TAG and _NAME.match(page, at):
            tags = _LOOSE_TAG  # its value's quote takes all that is left: from here on a tag ends at the first >
            continue
        if m is None:
            m = _OTHER.match(page, at)
            at = m.end()
            if m[0][0] != "<" or m[0] == "<":
                open_.children.append(m[0])
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if opened[tag] > 0 and tag != "html":
                node = open_
                while node.tag != tag:
                    node = node.parent
                close(node)
            elif tag == "p":
                open_.children.append(_node("p", "", open_))
            continue
        if tag == "html":
            continue
        if tag in BLOCK and open_.block.tag == "p":
            close(open_.block)
        if tag in CLOSED_BY:
            node = open_.scoped
            while node is not None and node.tag not in SCOPE and node.tag not in CLOSED_BY[tag]:
                node = node.parent and node.parent.scoped
            while node is not None and node.tag in CLOSED_BY[tag] and node.parent is not None:
                node = close(node).scoped if open_ is not node.parent else None
                node = node if node is open_ else None
        new = _node(tag, m[3], open_)
        open_.children.append(new)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or n
            continue
        open_ = new
        opened[tag] += 1
    return root


def blocks(root: Node, below: dict[int, tuple[Node, list[str]]] | None = None) -> list[tuple[Node, str]]:
    """The text blocks of a tree in page order, each with the block element that holds it; references decoded, white space single.

    below, if given, takes each block element by its identity, with the labels of what is directly in it, "#text" for its own blocks.
    """
    out: list[tuple[Node, str]] = []
    held: list[str] = []

    def opened(node: Node) -> None:
        if below is not None:
            below[id(node)] = node, []

    def flush(owner: Node) -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((owner, text))
            if below is not None:
                below[id(owner)][1].append("#text")

    stack: list[tuple[Node, int]] = [(root, 0)]
    owners = [root]
    opened(root)
    while stack:
        node, k = stack.pop()
        if k < len(node.children):
            stack.append((node, k + 1))
            child = node.children[k]
            if isinstance(child, str):
                held.append(child)
            elif child.tag == "br":
                held.append(" ")
            elif child.tag in RAW:
                continue
            else:
                if child.tag in BLOCK:
                    flush(owners[-1])
                    if below is not None:
                        below[id(owners[-1])][1].append(child.label)
                    owners.append(child)
                    opened(child)
                stack.append((child, 0))
        elif node.tag in BLOCK:
            flush(owners[-1])
            if node is not root:
                owners.pop()
    flush(root)
    return out


class Verdicts:
    """What is noise on a page by tags, roles and names, found from the root down, a step a node.

    Tags and roles always count. Names count outside of articles (outside of the main element, if there is no article): those of adverts and comments, and others if they are a whole id or class or if the element holds no
    heading or paragraph. In articles only the classes of STRONG_CLASSES count, on containers, and on articles within: words of an id or class may be the article's own. No name counts around the first article (or
    main element) that is not reader comments; what is named noise elsewhere is so with all articles in it.
    """

    def __init__(self, root: Node):
        self.by_tag: set[int] = set()
        self.by_name: set[int] = set()
        first, has_article = None, False
        stack = [(root, False)]
        order: list[Node] = []
        while stack:
            node, out = stack.pop()
            order.append(node)
            out = out or node.noise == 3 or (node.tag in ("article", "section") or node.tag in CONTAINERS) and node.comment
            if _is_main(node) and not out and (first is None or node.tag == "article" and not has_article):
                first, has_article = node, node.tag == "article"
            stack.extend((c, out) for c in reversed(node.children) if not isinstance(c, str))
        around, node = set(), first
        while node is not None:
            around.add(id(node))
            node = node.parent
        inside: set[int] = set()
        for node in order:
            up = id(node.parent)
            if up in inside or node.tag == "article" or _is_main(node) and not has_article:
                inside.add(id(node))
            if up in self.by_tag or node.noise == 3:
                self.by_tag.add(id(node))
            if up in self.by_name or id(node) in self.by_tag or id(node) not in around and self._named(node, up in inside):
                self.by_name.add(id(node))

    @staticmethod
    def _named(node: Node, inside: bool) -> bool:
        if inside:
            return node.strong and (node.noise == 2 or node.tag == "article")
        if node.tag == "article":
            return node.comment
        return node.noise == 2 or node.noise == 1 and (node.whole or not node.held)


def main_text(page: str, noise_paths: set[str] | None = None) -> str:
    """The main text of a page. noise_paths: branches of its host that the style tree holds to be noise.

    Elements that are menus, headers, footers, sidebars, notices, adverts, forms, comments or not text at all by their
    tag, role or names go first, as ``Verdicts`` says (names that would leave nothing are disregarded). Then go the branches that the tree holds to be noise, within an article except its plain
    headings and paragraphs outside other noise, unless nothing would be left, or nothing of an article. If then an article or main
    element has text, the rest outside goes. Each branch is judged over the host, however much of a page it holds, so what differs between pages stays below a fixed label.
    """
    root = parse(page)
    found, verdicts = blocks(root), Verdicts(root)
    kept = [(n, t) for n, t in found if id(n) not in verdicts.by_name] or [(n, t) for n, t in found if id(n) not in verdicts.by_tag]
    inner = lambda some: [(n, t) for n, t in some if n.main or _is_main(n)]
    if noise_paths:
        cut = _cut(root, noise_paths)
        left = [(n, t) for n, t in kept if id(n) not in cut]
        if inner(left) or left and not inner(kept):
            kept = left
    return "\n\n".join(t for _, t in inner(kept) or kept)


def _cut(root: Node, noise_paths: set[str]) -> set[int]:
    """Elements whose own text the style tree takes out: those of a noise path, and within an article those below one, plain headings and paragraphs apart."""
    out: set[int] = set()
    below: set[int] = set()
    stack = [root]
    while stack:
        node = stack.pop()
        stack.extend(c for c in node.children if not isinstance(c, str))
        inside, whole = node.main or _is_main(node), node.path in noise_paths
        plain = node.tag in PROSE and "." not in node.label
        if inside and node.main and (id(node.parent) in below or whole and not plain):
            below.add(id(node))
        own = whole or f"{node.path}>#text" in noise_paths
        if own and (not inside or node.main and (id(node) in below or not whole and not plain)):
            out.add(id(node))
    return out


def tree_features(page: str) -> list[tuple[str, str, int, float, bool]]:
    """What a page adds to its host's style tree: (path, kind, hash, share, named), each once.

    ``node``: the page has the path. ``style``: the labels in an element at the path, in order. ``edge``: what share of the
    labels of such a style the path takes in its parent. ``text``: a piece of text, between marks, of a block at the path; texts have paths of their own.
    """
    below: dict[int, tuple[Node, list[str]]] = {}
    out: set[tuple[str, str, int, float, bool]] = set()
    digest = lambda text: xxhash.xxh3_64_intdigest(text.encode()) - 2**63
    for node, text in blocks(parse(page), below):
        path = node.path + ">#text"
        out.add((path, "node", 0, 0.0, node.named))
        out.update((path, "text", digest(piece), 0.0, False) for piece in map(str.strip, _MARKS.split(text)) if piece)
    for node, labels in below.values():
        path, style = node.path, digest(">".join(labels))
        out.add((path, "node", 0, 0.0, node.named))
        out.add((path, "style", style, 0.0, False))
        last = path.count(">") + 1 == LEVELS
        out.update((f"{path}>{label}", "edge", style, labels.count(label) / len(labels), False) for label in set(labels) if not last or label == "#text")
    return sorted(out)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


_FEATURES = "host string, path string, kind string, what long, share double, named boolean"


def _features(pages: DataFrame) -> DataFrame:
    """What all different pages add to the style trees of their hosts. Pages are compressed while they are compared."""
    bound_batches(pages.sparkSession)
    pages = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.bool_())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            texts = texts_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in texts], pa.binary())], ["host", "size", "html"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            rows: list[tuple] = []
            for host, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = codec.decompress(data, n, asbytes=True).decode() if n else ""
                rows += [(host, *x) for x in tree_features(page)]
                if len(rows) > 100_000:
                    yield made(rows)
                    rows = []
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return pages.mapInArrow(packed, "host string, size long, html binary").distinct().mapInArrow(features, _FEATURES)


def _prefixes() -> Column:
    """at: the path and all paths that it lies in."""
    parts = F.split("path", ">")
    return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ">"))).alias("at")


def branch_importance(pages: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """host, path, importance, m, named of every path of the style trees of all hosts; paths of text end in ``#text``.

    Trees of one host are merged by path. With m different pages that have a path, the presentation importance of an element is
    the entropy of its styles to base m; the content importance of its text is one minus the mean entropy of
    its pieces over the pages, to base m and weighted by the pages that hold them: a piece on one page counts 1, one on all pages 0. Both are 1 if m is 1. An element with l styles has the
    importance (1 - gamma^l) x its presentation + gamma^l x that of what is in it, each by its mean share of a style.

    That is linear in all that is below, so it takes no walk of the trees: the weight of a path in an ancestor is the
    product of the shares between them, taken from sums of their logarithms, and an importance is a sum by (host, ancestor). Of a
    host nothing comes together but by partial sums.
    """
    counts = _features(pages).groupBy("host", "path", "kind", "what").agg(F.count("*").alias("n"), F.max("share").alias("share"), F.max("named").alias("named"))
    only = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    n = F.col("n")
    nodes = counts.groupBy("host", "path").agg(
        only("node", n).alias("m"), only("style", n).alias("elements"), only("style", n * F.ln("n")).alias("repeats"), only("style", F.lit(1)).alias("styles"),
        only("edge", n * F.col("share")).alias("part"), only("text", n * F.ln("n")).alias("shared"), only("text", n).alias("pieces"), F.max("named").alias("named"),
    )
    nodes = written(nodes.filter(F.col("m").isNotNull()).withColumn("up", F.regexp_replace("path", ">[^>]*$", "")), "nodes")
    base = F.ln(F.greatest("m", F.lit(2)))
    presentation = F.least(F.lit(1.0), (F.ln("elements") - F.col("repeats") / F.col("elements")) / base)
    content = F.when(F.col("m") == 1, 1.0).otherwise(1 - F.coalesce(F.col("shared") / F.col("pieces"), F.lit(0.0)) / base)
    kept = F.pow(F.lit(gamma), F.col("styles"))
    own = F.when(F.col("elements").isNull(), content).otherwise((1 - kept) * F.when(F.col("m") == 1, 1.0).otherwise(presentation))
    above = nodes.select("host", F.col("path").alias("up"), (F.col("styles") * F.ln(F.lit(gamma)) - F.ln("elements")).alias("handed"))
    steps = nodes.join(above, ["host", "up"], "left").select("host", "path", "m", "named", own.alias("own"), F.when(F.col("up") == F.col("path"), 0.0).otherwise(F.ln("part") + F.col("handed")).alias("step"))
    steps = written(steps, "steps")
    depths = steps.select("host", "path", _prefixes()).join(steps.select("host", F.col("path").alias("at"), "step"), ["host", "at"]).groupBy("host", "path").agg(F.sum("step").alias("depth"))
    placed = written(steps.drop("step").join(depths, ["host", "path"]), "placed")
    tops = placed.select("host", F.col("path").alias("at"), F.col("depth").alias("top"))
    weighed = placed.select("host", "path", "own", "depth", _prefixes()).join(tops, ["host", "at"]).groupBy("host", F.col("at").alias("path")).agg(F.sum(F.col("own") * F.exp(F.col("depth") - F.col("top"))).alias("importance"))
    return placed.select("host", "path", "m", "named").join(weighed, ["host", "path"])


def noise_rows(pages: DataFrame, min_importance: float = MIN_IMPORTANCE, min_named: float = MIN_NAMED_IMPORTANCE) -> DataFrame:
    """host and path, a row per noise branch, from the style trees of all pages of each host: paths (texts' too) under which nothing has the least importance, they themselves neither.

    The least is ``min_named`` for a branch that is, or lies in, one whose tag, role or names speak against it, else ``min_importance``. Few pages
    may agree by chance: of what is left to 1, importance gets 2^(1-m) in addition, so that with the usual threshold two pages
    are too few and on three a branch must be all but the same. No pages give no rows.
    """
    rows = branch_importance(pages).withColumn("importance", F.col("importance") + (1 - F.col("importance")) * F.pow(F.lit(2.0), 1 - F.col("m")))
    most = rows.select("host", "path", "importance", "named", _prefixes()).groupBy("host", "at").agg(F.max("importance").alias("most"), F.max(F.when(F.col("path") == F.col("at"), F.col("named"))).alias("named"))
    return most.filter(F.col("most") < F.when(F.col("named"), min_named).otherwise(min_importance)).select("host", F.col("at").alias("path"))


def noise_branches(pages: DataFrame, min_importance: float = MIN_IMPORTANCE, min_named: float = MIN_NAMED_IMPORTANCE) -> DataFrame:
    """host and the list of its noise branches (``noise_rows``), to be looked at; ``extract`` gathers those of hosts with few of them only."""
    return noise_rows(pages, min_importance, min_named).groupBy("host").agg(F.collect_list("path").alias("paths"))


def _page_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key and each different path of a page, its texts' paths too."""
    for batch in batches:
        for host, key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, stack = set(), [parse(page)]
            while stack:
                node = stack.pop()
                stack.extend(c for c in node.children if not isinstance(c, str))
                own |= {node.path, f"{node.path}>#text"}
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array([key] * n, pa.string()), pa.array(sorted(own), pa.string())], ["host", "key", "path"])


def _own_noise(pages: DataFrame, noise: DataFrame) -> DataFrame:
    """host, key and the noise branches that occur on a page, for pages (host, key, html) of hosts with many: a list is as long as its page, whatever its host has.

    Branches of a host are on most of its pages, so the rows of noise are laid out SALTS times and pages deal themselves over them.
    """
    salted = noise.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    paths = pages.mapInArrow(_page_paths, "host string, key string, path string").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return paths.join(salted, ["host", "path", "salt"]).groupBy("host", "key").agg(F.collect_set("path").alias("paths"))


def extract(pages: DataFrame, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """``pages`` (url, html) with text and n_chars (code points): the main text of each whole page.

    Blocks in page order, joined by an empty line; see ``main_text`` and ``noise_branches``.

    Null and empty html, and pages without text, give an empty string. Null urls and urls without host are one host.
    Rows that are repeated count once for the trees and are extracted each. An empty table stays empty. Columns
    named text or n_chars are replaced, all others are kept. Up to MOST_PATHS noise branches of a host are one list, sent with its pages; of a host with more, each
    page gets those that occur on it, which gives the same text.
    """
    bound_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    noise = written(noise_rows(pages, min_importance), "noise")
    counts = written(noise.groupBy("host").agg((F.count("*") > MOST_PATHS).alias("many")), "noisy-hosts")
    names, at = pages.columns, pages.columns.index("html")
    own, paths, key, more = (fresh(c, names) for c in ("_host", "_paths", "_key", "_more"))
    gathered = noise.join(counts.filter("NOT many"), "host").groupBy("host").agg(F.collect_list("path").alias("paths"))
    both = pages.withColumn(own, host_of(F.col("url").cast("string"))).join(gathered.toDF(own, paths), own, "left")
    many = counts.filter("many").select("host")
    if not many.isEmpty():
        whole = F.coalesce(F.col("html").cast("string"), F.lit(""))
        hosted = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.sha2(whole, 256).alias("key"), whole.alias("html"))
        found = written(_own_noise(hosted.join(many, "host", "left_semi"), noise.join(many, "host", "left_semi")), "own-noise")
        both = both.withColumn(key, F.sha2(whole, 256)).join(found.toDF(own, key, more), [own, key], "left").withColumn(paths, F.coalesce(paths, more))
    both = both.select(*names, paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", set(paths) if paths else None) for page, paths in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return both.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
