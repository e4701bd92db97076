"""Main text of web pages, with site templates removed.

Each page is parsed into a tree, and every element's subtree is hashed with the
page's host: menus, footers and forms like all others.  Spark counts in how many
different contents of a host each hash occurs.  A page's content is its article
or, without one, the deepest subtree that holds more than four fifths of its own
text (what is no link), so copies of an article count once.  Subtrees that occur in ``MIN_SHARE`` of a host's
contents, in ``MIN_PAGES`` at least, are its template and go, wherever they
stand; what holds the page's content stays, and so do paragraphs and headings
of an ``<article>`` or ``<main>``.  Outside these, where more than four fifths
of a page's own text would go, only what is mostly links goes: near copies are
no template.

Of what is left the article is taken: ``<article>``, else ``<main>``, else the
body.  Hosts of few pages show no template, and on larger ones menus may vary;
so elements that are boilerplate by their tag, and those with a class, id or
role that names it as a whole (``site-footer``, not ``search-algorithms``), go
as well.

The recurring hashes are broadcast if there are at most ``MAX_BROADCAST``;
beyond that each page meets its own in a join on the hash, whose hot keys
adaptive execution splits.

Text: blocks in page order joined by a newline, white space inside a block as
one space, character references decoded.  Null or empty html gives an empty
text, a null url a host of its own.  Repeated rows give repeated rows and are
one content.  Very long or deep pages are walked without recursion, one page at
a time.  Empty tables give empty results; only id, url and html are read,
whatever the other columns are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._base import col, small, stash

MIN_PAGES, MIN_SHARE, MAX_BROADCAST = 3, 0.02, 1 << 20

# Elements by role, after the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("caption tbody td tfoot th thead tr body html".split())
_DROP = frozenset("nav aside footer form script style noscript template svg math iframe object embed applet canvas audio video map button select textarea input dialog menu head title noembed noframes search".split())
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Words in class, id and role that name boilerplate, and words that may stand beside them in a name.
_NAMES = frozenset("ad adbox ads adsense adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookiebanner cookiebar cookies copyright disqus dropdown footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharebar sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription subnav toolbar topbar widget widgets complementary contentinfo alert".split())
_BESIDE = frozenset("site page main top bottom left right global primary secondary list box bar block area container wrapper wrap inner outer section link links button buttons item items slot unit icon icons post posts article articles form group row col column first last sticky fixed the".split())
_HEADER_NAMES = frozenset(("header", "masthead"))
_FOREIGN = frozenset("comment comments reply replies related recommended promo sponsored widget ad advert".split())
_NEVER = frozenset(("html", "body", "main"))

_START = re.compile(r"<(?:(!--)|([/]?)([A-Za-z][^\s/>]*)|([!?]))")
_STOP = re.compile(r"""=\s*(["'])|>""")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}


class Node:
    """An element: its hash, the length of its text, and of the text in links."""

    __slots__ = ("tag", "attrs", "kids", "key", "size", "linked")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.kids, self.key, self.size, self.linked = tag, attrs, [], 0, 0, 0


def parse(html: str) -> Node:
    """A tree of elements and text; every element is closed in the end."""
    root = Node("", "")
    stack, open_tags = [root], {}
    at, n = 0, len(html)
    quote_free = {'"': n + 1, "'": n + 1}  # beyond these places no such quote follows

    def push(node: Node) -> None:
        stack[-1].kids.append(node)
        stack.append(node)
        open_tags[node.tag] = open_tags.get(node.tag, 0) + 1

    def pop() -> None:
        open_tags[stack.pop().tag] -= 1

    while at < n:
        m = _START.search(html, at)
        if not m:
            stack[-1].kids.append(html[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        if m[1]:
            end = html.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if m[4]:
            end = html.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        end = m.end()
        while True:
            stop = _STOP.search(html, end)
            if not stop:
                end = n
                break
            if not stop[1]:
                end = stop.start()
                break
            close = -1
            if stop.end() < quote_free[stop[1]]:
                close = html.find(stop[1], stop.end())
                if close < 0:
                    quote_free[stop[1]] = stop.end()
            end = stop.end() if close < 0 else close + 1
        attrs = html[m.end() : end]
        at = min(end + 1, n)
        tag = m[3].lower()
        if m[2]:
            if open_tags.get(tag):
                # an end tag of an inline element doesn't reach out of the block that it stands in
                if tag not in _BLOCK:
                    k = len(stack) - 1
                    while stack[k].tag != tag and stack[k].tag not in _BLOCK:
                        k -= 1
                    if stack[k].tag != tag:
                        continue
                while stack[-1].tag != tag:
                    pop()
                pop()
            elif tag == "br":
                stack[-1].kids.append(" ")
            continue
        if tag in _CLOSES_P and open_tags.get("p"):
            k = len(stack) - 1
            while stack[k].tag not in _BLOCK:
                k -= 1
            if stack[k].tag == "p":
                while len(stack) > k:
                    pop()
        if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
            same = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}[tag]
            holders = ("ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot", "select", "div", "section", "article", "body", "")
            while any(open_tags.get(t) for t in same):
                k = len(stack) - 1
                while stack[k].tag not in same and stack[k].tag not in holders and not (tag in ("td", "th") and stack[k].tag == "tr"):
                    k -= 1
                if stack[k].tag not in same:
                    break
                while len(stack) > k:
                    pop()
        if tag in _VOID:
            stack[-1].kids.append(Node(tag, "") if tag == "hr" else " " if tag == "br" else "")
            continue
        push(Node(tag, attrs))
        if tag in _RAW:
            close = _RAW_END[tag].search(html, at)
            end = close.start() if close else n
            if tag in ("textarea", "title"):
                stack[-1].kids.append(html[at:end])
            pop()
            stop = html.find(">", end)
            at = n if not close or stop < 0 else stop + 1
    return root


def _attributes(node: Node) -> tuple[list[str], bool]:
    """The names of class, id and role, and whether the element is hidden."""
    if not node.attrs or node.attrs.isspace():
        return [], False
    names: list[str] = []
    hidden = False
    for m in _ATTR.finditer(node.attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            names += value.split()
        elif name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "")
        else:
            hidden = hidden or value == "true"
    return names, hidden


def _named(names: list[str]) -> frozenset[str]:
    """The words for boilerplate in names that say nothing else."""
    found: set[str] = set()
    for name in names:
        words = set(_NAME.findall(name))
        if words <= _NAMES | _BESIDE:
            found |= words & _NAMES
    return frozenset(found)


def seal(root: Node) -> None:
    """Hashes every subtree from its tag, names, own text and children's hashes; sizes count text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if type(k) is Node]
    for node in reversed(order):
        parts, size, linked = [node.tag, *sorted(_attributes(node)[0])], 0, 0
        for k in node.kids:
            if type(k) is Node:
                parts.append(f"#{k.key}")
                size += k.size
                linked += k.linked
            elif not k.isspace():
                parts.append(k.strip())
                size += len(k)
        node.key, node.size, node.linked = xxh64_intdigest("\x00".join(parts).encode()), size, size if node.tag == "a" else linked


def content(root: Node) -> list[Node]:
    """The way from the root to the page's content: its largest ``<article>``, else ``<main>``.

    Without either, the deepest subtree that holds more than four fifths of the page's own text (what is no link).
    """
    above: dict[int, Node] = {}
    best: dict[str, Node] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        for k in node.kids:
            if type(k) is Node:
                above[id(k)] = node
                if k.tag in ("article", "main") and (k.tag not in best or k.size > best[k.tag].size):
                    best[k.tag] = k
                todo.append(k)
    if node := best.get("article") or best.get("main"):
        way = [node]
        while id(way[-1]) in above:
            way.append(above[id(way[-1])])
        return way[::-1]
    way = [root]
    while kid := next((k for k in way[-1].kids if type(k) is Node and 5 * (k.size - k.linked) > 4 * (root.size - root.linked)), None):
        way.append(kid)
    return way


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return url or ""


def site_keys(root: Node, site: int) -> set[int]:
    """Hashes of all of this page's elements with text, each with its host's."""
    out, todo = set(), [root]
    while todo:
        node = todo.pop()
        if node.size and node.tag and node.tag not in _NEVER:
            out.add(_mixed(node.key, site))
        todo += [k for k in node.kids if type(k) is Node]
    return out


def _mixed(key: int, site: int) -> int:
    h = ((key ^ site) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def _boilerplate(node: Node, inside: bool) -> bool:
    """Whether tag or names say so; ``inside`` an article its header stays."""
    if node.tag in _DROP:
        return True
    names, hidden = _attributes(node)
    if hidden:
        return node.tag not in _NEVER
    named = _named(names)
    if node.tag in _NEVER:
        return False
    if node.tag == "article":
        return bool(named & _FOREIGN)
    if node.tag == "header" or named and named <= _HEADER_NAMES:
        return not inside
    return bool(named) and node.tag not in _HEADINGS


def template(root: Node, recurring, site: int) -> set[int]:
    """``id()`` of the topmost elements that are the site's template on this page."""
    kept = {id(x) for x in content(root)}
    gone: list[Node] = []
    own = 0  # text outside articles that is no link and doesn't go by its tag or names
    todo = [(root, False, False)]
    while todo:
        node, article, out = todo.pop()
        if node.size and node.tag and node.tag not in _NEVER and id(node) not in kept and not (article and node.tag in _PLAIN) and recurring(_mixed(node.key, site)):
            gone.append(node)
            own += 0 if article or out or _boilerplate(node, False) else node.size - node.linked
            continue
        article = article or node.tag in ("article", "main")
        out = out or node is not root and _boilerplate(node, False)
        for k in node.kids:
            if type(k) is Node:
                todo.append((k, article, out))
            elif not article and not out and node.tag != "a" and not k.isspace():
                own += len(k)
    lost = sum(x.size - x.linked for x in gone if not _boilerplate(x, False))
    if 5 * lost > 4 * own:
        gone = [x for x in gone if 2 * x.linked > x.size or _boilerplate(x, False)]
    return {id(x) for x in gone}


def main_text(html: str | None, recurring, site: int) -> str:
    """The page's article; ``recurring`` tells whether a hash with its host's is one of the site's template."""
    if not html:
        return ""
    root = parse(html)
    seal(root)
    gone = template(root, recurring, site)
    articles: list[Node] = []
    mains: list[Node] = []
    bodies: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node is not root and (id(node) in gone or _boilerplate(node, False)):
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if node.tag == "main" or "main" in _attributes(node)[0]:
            mains.append(node)
        if node.tag == "body":
            bodies.append(node)
        todo += [k for k in reversed(node.kids) if type(k) is Node]
    tops, inside = (articles, True) if articles else (mains[:1], True) if mains else (bodies[:1] or [root], False)
    lines: list[str] = []
    for top in tops:
        lines += _blocks(top, inside, gone)
    return "\n".join(lines)


def _blocks(top: Node, inside: bool, gone: set[int]) -> list[str]:
    lines: list[str] = []
    open_text: list[str] = []

    def flush() -> None:
        line = " ".join("".join(open_text).split())
        if line:
            lines.append(line)
        open_text.clear()

    # (node, headings only) or None for the end of a block
    work: list = [(top, False)]
    while work:
        x = work.pop()
        if x is None:
            flush()
            continue
        node, only = x
        if type(node) is str:
            if not only:
                open_text.append(unescape(node) if "&" in node else node)
            continue
        if node is not top and (id(node) in gone or _boilerplate(node, inside)):
            continue
        if not only and inside and (node.tag == "header" or node.attrs and _named(_attributes(node)[0]) & _HEADER_NAMES):
            only = True  # of an article's own header the headings are text
        elif only and node.tag in _HEADINGS:
            only = False
        if node.tag in _BLOCK:
            flush()
            work.append(None)
        work += [(k, only) for k in reversed(node.kids)]
    flush()
    return lines


def recurring_subtrees(pages: DataFrame, min_pages: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    """Of ``pages(rid, url, html)``: ``(rid, site, main, k)`` of every page, and ``key`` of all hosts' templates."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, keys, sites, mains = [0], [], [], []
            for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                root, site = parse(h or ""), xxh64_intdigest(host(u).encode())
                seal(root)
                keys += site_keys(root, site)
                ends.append(len(keys))
                sites.append(_mixed(site, 0))
                mains.append(_mixed(content(root)[-1].key, 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sites, pa.int64()), pa.array(mains, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.int64()))], ["rid", "site", "main", "k"])

    keyed = pages.mapInArrow(hashes, "rid long, site long, main long, k array<bigint>")
    met = keyed.select("site", "main", F.explode("k").alias("key")).distinct()
    counts = met.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    sites = keyed.select("site", "main").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("of"))
    often = counts.join(small(stash(sites, "sites")), "site").where(F.col("n") >= F.col("of") * min_share).select("key").distinct()
    return keyed, stash(often, "templates")


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``(id, url, text)`` of every row."""
    spark = pages.sparkSession
    rows = pages.select(col(id_col).alias("id"), col(url).alias("u"), col(html).cast("string").alias("h"))
    rid = F.xxhash64("id", "u", "h").alias("rid")
    keyed, often = recurring_subtrees(rows.select(rid, "u", "h"), min_pages, min_share)
    held = spark.sparkContext.broadcast(np.sort(often.toPandas()["key"].to_numpy(np.int64))) if often.count() <= max_broadcast else None

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = frozenset(held.value.tolist()) if held else frozenset()
        for b in batches:
            own = b.column(3).to_pylist() if not held else None
            out = []
            for k, (u, h) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                known = shared if held else frozenset(own[k] or ())
                out.append(main_text(h, known.__contains__, xxh64_intdigest(host(u).encode())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    schema = f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string"
    if held:
        found = rows.mapInArrow(texts, schema)
    else:
        met = keyed.select("rid", F.explode("k").alias("key")).join(often, "key").groupBy("rid").agg(F.collect_set("key").alias("k"))
        found = rows.withColumn("rid", rid).join(stash(met, "page-templates"), "rid", "left").select("id", "u", "h", "k").mapInArrow(texts, schema)
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url), "text")
