"""Main text of web pages by wrapper induction.

Each page becomes a tree of block elements; like siblings in a row fold into one node, so a tree is as small as
the page's layout. A host's reference tree is the layout that most of its distinct pages have; each other layout
of the host is aligned with it by simple tree matching (the largest set of node pairs that keeps parents, order
and labels; what stays alone joins a like sibling). A node's text is constant if at least `share` of the host's distinct pages (and `least` of them) have
that same text at the node that it aligns with: constant nodes are template, what varies is content.

What varies from page to page and still is no content has to be told by the page's own marks: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, hidden parts and reader comments, by element, role, or a class
or id of which every part is a word for them (`cookie-notice`, but not `notice-board`). Where there is an article (else
a main part) only that is looked at; its headings stay. Text is decoded, white space in a block becomes one blank, and
blocks are joined by line feeds in page order.

Scale: pages are parsed once, where they lie, in time linear in their length. Layouts and constants are small tables
that Spark aggregates per host (partial sums first, so a host with a third of all pages is no hot key); a layout's
constants are at most its nodes, as a share over one half leaves one text a node; they are broadcast if there are at
most `broadcast_rows`, and joined by host and layout otherwise.

Defined results: a null or empty html gives an empty text; a null url has the empty host; copies of a page count
once in its host; hosts of under `least` distinct pages have no template; a quote that never closes is an ordinary
character; elements may nest to any depth, of which the layout has MOST_DEPTH levels (what is deeper belongs to its last node), and a layout of more than
MOST_NODES nodes is made coarser; a tag that never ends takes the
rest of the page; repeated rows are each returned; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import stored, table, text_of

SHARE, LEAST, BROADCAST_ROWS = 0.6, 3, 100_000
#: Limits of a layout, not of content: what lies beyond shares nodes.
MOST_DEPTH, MOST_SIBLINGS, MOST_NODES = 200, 300, 2000

MARKUP = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
BLANKS, NAME, EQUALS, BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
#: Elements whose inside is no page text.
RAW = {x: re.compile(f"</{x}(?![a-zA-Z0-9-])", re.I) for x in ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object")}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | {"html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "head", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "body", "html", "head", "title"}
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}, "body": {"head", "title"}}
SCOPE = {"div", "section", "article", "ul", "ol", "table", "dl", "body"}
AWAY = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "search"}
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
AWAY_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "aside", "header", "masthead", "topbar", "footer", "foot", "bottombar", "comment", "comments", "respond", "reply", "replies", "disqus",
    "share", "sharing", "newsletter", "subscribe", "subscription", "signup", "login", "widget", "widgets", "toolbar",
}
#: Words that may stand beside those in a class or id.
BESIDE = {"site", "page", "main", "global", "top", "bottom", "left", "right", "primary", "secondary", "bar", "box", "list", "item", "items", "area", "wrap", "wrapper", "container", "inner", "outer", "block", "links", "link", "buttons", "button", "icons", "posts", "articles", "form", "section", "reader", "user", "thread", "body", "js", "c", "w", "l", "m"}
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def _names(value: str) -> bool:
    """A class or id value that names a region away: all parts of one of its tokens are words for such regions, or
    stand beside one."""
    for token in value.split():
        parts = {w.lower() for w in SPLIT.split(token) if w}
        if parts & AWAY_WORDS and parts <= AWAY_WORDS | BESIDE:
            return True
    return False


@lru_cache(maxsize=4096)
def _marks(tag: str, attributes: tuple[tuple[str, str], ...]) -> tuple[bool, bool]:
    """(never content, main part) of an element by its own marks."""
    got = {k: html.unescape(v) for k, v in attributes}
    role = got.get("role", "").lower()
    hidden = "hidden" in got or re.search(r"display\s*:\s*none", got.get("style", "")) is not None
    own = tag not in HEADINGS | {"html", "body", "main"} and (_names(got.get("class", "")) or _names(got.get("id", "")))
    return tag in AWAY or role in AWAY_ROLES or own or hidden, tag == "main" or role == "main"


class Node:
    __slots__ = ("tag", "away", "main", "children", "parent", "path", "depth")

    def __init__(self, tag: str, away: bool, main: bool, parent: Node | None):
        self.tag, self.away, self.main, self.parent, self.children, self.path = tag, away, main, parent, [], ""
        self.depth = parent.depth + 1 if parent else 0


def _attributes(text: str, at: int, gone: set[str]) -> tuple[int, list[tuple[str, str]]]:
    """(end of the tag, its attributes), from behind the tag's name; gone: quotes that don't come again."""
    out, n = [], len(text)
    while True:
        at = BLANKS.match(text, at).end()
        if at >= n:
            return n, out
        if text[at] == ">":
            return at + 1, out
        name = NAME.match(text, at)
        at, value = name.end(), ""
        if equals := EQUALS.match(text, at):
            at = equals.end()
            close, quote = -1, text[at : at + 1]
            if quote in ('"', "'") and quote not in gone:
                close = text.find(quote, at + 1)
                if close < 0:
                    gone.add(quote)
            if close >= 0:
                value, at = text[at + 1 : close], close + 1
            else:
                bare = BARE.match(text, at)
                value, at = bare[0], bare.end()
        out.append((name[0].lower(), value))


def parse(text: str) -> Node:
    """The tree of elements; text pieces are strings among an element's children."""
    root = Node("", False, False, None)
    now, at, opened, gone = root, 0, {}, set()

    def leave(upto: Node) -> Node:
        """Closes all from the open element to this one."""
        x = now
        while x is not upto:
            opened[x.tag] -= 1
            x = x.parent
        opened[x.tag] -= 1
        return x.parent

    while m := MARKUP.search(text, at):
        if m.start() > at:
            now.children.append(text[at : m.start()])
        tag = m[2]
        if tag is None:
            mark = "-->" if m[0] == "<!--" else ">"
            end = text.find(mark, m.end())
            at = end + len(mark) if end >= 0 else len(text)
            continue
        tag = tag.lower()
        at, attributes = _attributes(text, m.end(), gone)
        if m[1]:
            if opened.get(tag):
                x = now
                while x.tag != tag:
                    x = x.parent
                now = leave(x)
            continue
        if tag in RAW:
            end = RAW[tag].search(text, at)
            at = _attributes(text, end.end(), gone)[0] if end else len(text)
            continue
        ends = ({"p"} if tag in ENDS_P else set()) | CLOSES.get(tag, set())
        if any(opened.get(x) for x in ends):
            x, stop = now, None
            while x is not root and x.tag not in SCOPE - ends:
                stop = x if x.tag in ends else stop
                x = x.parent
            now = leave(stop) if stop is not None else now
        away, main = _marks(tag, tuple((k, v) for k, v in attributes if k in ("class", "id", "role", "hidden", "style")))
        x = Node(tag, away, main, now)
        now.children.append(x)
        if tag not in VOID and text[at - 2 : at] != "/>":
            now = x
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(text):
        now.children.append(text[at:])
    return root


def _regions(root: Node) -> list[Node]:
    """Articles, else main parts, else all: the outermost that aren't away."""
    def find(root: Node, want) -> list[Node]:
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.away:
                continue
            if want(node):
                found.append(node)
            else:
                stack += [x for x in reversed(node.children) if isinstance(x, Node)]
        return found

    for want in (lambda n: n.tag == "article", lambda n: n.main, lambda n: n.tag == "body"):
        if found := find(root, want):
            return found
    return [root]


def _blocks_in(node: Node, path: str) -> Iterator[Node]:
    """The block elements under a node with no other between; inline elements pass their path on."""
    stack = [iter(node.children)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, Node):
                if x.tag in BLOCKS:
                    yield x
                else:
                    x.path = path
                    stack.append(iter(x.children))
                    break
        else:
            stack.pop()


def _all_under(node: Node) -> Iterator[Node]:
    stack = [x for x in node.children if isinstance(x, Node)]
    while stack:
        x = stack.pop()
        yield x
        stack += [y for y in x.children if isinstance(y, Node)]


def fold_tree(node: Node, path: str = "", most: int = MOST_SIBLINGS) -> tuple[list, int]:
    """([label, children] of the block elements, its nodes). Of a run of like children, and of all like children past
    the first `most` nodes, the largest stays and stands for all. Sets each block's path; what is `MOST_DEPTH` blocks deep
    keeps all under it in one node."""
    node.path, folded, sizes, last = path, [], [], {}
    if path.count("/") >= MOST_DEPTH:
        for x in _all_under(node):
            x.path = path
        return [node.tag + "!" * node.away, []], 1
    for x in _blocks_in(node, path):
        label = x.tag + "!" * x.away
        k = last.get(label) if len(folded) >= most else len(folded) - 1 if folded and folded[-1][0] == label else None
        if k is None:
            k = last[label] = len(folded)
            folded.append([label, []])
            sizes.append(0)
        own, size = fold_tree(x, f"{path}/{k}", most)
        if size > sizes[k]:
            folded[k][1], sizes[k] = own[1], size
    return [node.tag + "!" * node.away, folded], 1 + sum(sizes)


def blocks_of(text: str | None) -> tuple[str, list[dict]]:
    """(layout, content blocks (path, text) by the page's own marks)."""
    root = parse(text or "")
    tree, size = fold_tree(root)
    if size > MOST_NODES:
        tree, _ = fold_tree(root, most=0)
    layout = json.dumps(tree, separators=(",", ":"))
    out: list[dict] = []
    buffer: list[str] = []

    def flush(path: str) -> None:
        line = " ".join("".join(buffer).split())
        buffer.clear()
        if line:
            out.append({"path": path, "text": line})

    def walk(node: Node, path: str) -> None:
        stack = [(iter(node.children), path, False)]  # what is left of an element, the path of its text, a block?
        while stack:
            left, path, _ = stack[-1]
            for x in left:
                if isinstance(x, str):
                    buffer.append(html.unescape(x))  # each piece by itself: markup inside a reference ends it
                elif x.away:
                    flush(path)
                    if x.tag == "header" and inside:
                        headings(x)
                elif x.tag in BLOCKS:
                    flush(path)
                    stack.append((iter(x.children), x.path, True))
                    break
                elif x.tag == "br":
                    buffer.append(" ")
                else:
                    stack.append((iter(x.children), path, False))
                    break
            else:
                if stack.pop()[2]:
                    flush(path)

    def headings(header: Node) -> None:
        stack = [header]
        while stack:
            node = stack.pop()
            if node.tag in HEADINGS:
                walk(node, node.path)
                flush(node.path)
            else:
                stack += [x for x in reversed(node.children) if isinstance(x, Node)]

    for region in _regions(root):
        inside = region.tag == "article"
        walk(region, region.path)
        flush(region.path)
    return layout, out


def matching(a: list, b: list) -> tuple[int, list[tuple[str, str]]]:
    """Simple tree matching of two folded trees: (pairs, [(path in a, path in b)])."""

    def same(x: list, p: str, q: str) -> tuple[int, list[tuple[str, str]]]:
        below = [same(y, f"{p}/{k}", f"{q}/{k}") for k, y in enumerate(x[1])]
        return 1 + sum(n for n, _ in below), [(p, q), *(z for _, pairs in below for z in pairs)]

    def match(x: list, y: list, p: str, q: str) -> tuple[int, list[tuple[str, str]]]:
        if x[0] != y[0]:
            return 0, []
        if x == y:
            return same(x, p, q)
        n, m = len(x[1]), len(y[1])
        sub = [[match(x[1][i], y[1][j], f"{p}/{i}", f"{q}/{j}") for j in range(m)] for i in range(n)]
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + sub[i][j][0])
        pairs, i, j, rest = [(p, q)], n, m, []
        while i and j:
            if sub[i - 1][j - 1][0] and best[i][j] == best[i - 1][j - 1] + sub[i - 1][j - 1][0]:
                pairs += sub[i - 1][j - 1][1]
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
                rest.append(i)
            else:
                j -= 1
        for i in [*rest, *range(i)]:  # a node stands for all its like siblings, so what is left joins one that it is like
            like = next((z for z in sub[i] if z[0]), None)
            pairs += like[1] if like else []
        return 1 + best[n][m], pairs

    return match(a, b, "", "")


def parsed(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """(page_id, url, host, digest, layout, blocks)."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = [blocks_of(x) for x in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], kind)], ["page_id", "url", "host", "digest", "layout", "blocks"])

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    picked = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), host.alias("host"), F.xxhash64(text_of(page)).alias("digest"), text_of(page).alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, host string, digest long, layout string, blocks array<struct<path:string,text:string>>")


def constants(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, shape, path, text_hash): texts that are constant at a node, under each layout's own path. pages: parsed."""
    distinct = pages.groupBy("host", "shape", "digest").agg(F.max("layout").alias("layout"))
    sizes = distinct.groupBy("host", "shape").agg(F.count("*").alias("count"), F.max("layout").alias("layout"))
    of_host = sizes.groupBy("host").agg(F.sum("count").alias("n"), F.max(F.struct("count", "layout")).alias("top")).where(F.col("n") >= least)
    pairs = sizes.join(of_host, "host").select("host", "shape", "layout", F.col("top.layout").alias("reference"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "shape", "path", "slot"]
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for h, k, x, y in zip(*(c.to_pylist() for c in b.columns)):
                for p, q in matching(json.loads(x), json.loads(y))[1]:
                    for column, value in zip(rows, (h, k, p, q)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, (pa.string(), pa.int64(), pa.string(), pa.string()))], names)

    slots = pairs.mapInArrow(align, "host string, shape long, path string, slot string")
    nodes = pages.select("host", "shape", "digest", F.explode("blocks").alias("b")).select("host", "shape", "digest", F.col("b.path").alias("path"), F.xxhash64("b.text").alias("text_hash"))
    # each distinct page counts once: copies meet here, as partial aggregates
    once = nodes.groupBy("host", "shape", "path", "text_hash", "digest").agg(F.lit(1).alias("one")).groupBy("host", "shape", "path", "text_hash").count()
    at_slot = once.join(slots, ["host", "shape", "path"])
    often = at_slot.groupBy("host", "slot", "text_hash").agg(F.sum("count").alias("m")).where(F.col("m") >= least).join(of_host.select("host", "n"), "host").where(F.col("m") >= share * F.col("n"))
    return often.select("host", "slot", "text_hash").join(slots, ["host", "slot"]).select("host", "shape", "path", "text_hash").distinct()


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", share: float = SHARE, least: int = LEAST, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars)."""
    cut = stored(parsed(pages, key, url, page).withColumn("shape", F.xxhash64("layout")), "parsed")
    fixed = stored(constants(cut, share, least), "constants").groupBy("host", "shape").agg(F.collect_set(F.struct("path", "text_hash")).alias("fixed"))
    n = fixed.agg(F.coalesce(F.sum(F.size("fixed")), F.lit(0))).first()[0]
    if n:
        marked = cut.join(F.broadcast(fixed) if n <= broadcast_rows else fixed, ["host", "shape"], "left")
        varying = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("fixed", F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("text_hash"))), F.lit(False)))
    else:
        marked, varying = cut, F.col("blocks")
    text = F.array_join(F.transform(varying, lambda b: b["text"]), "\n")
    return marked.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
