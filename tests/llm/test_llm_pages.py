"""Main text against a plain version over random sites, and pages that must keep their text."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from lodestone.llm import html_text


class Tree(HTMLParser):
    """Well-formed pages as ``[tag, attributes, children]``."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.stack = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def size(node, links=True) -> int:
    if isinstance(node, str):
        return 0 if node.isspace() else len(node)
    return 0 if node[0] == "a" and not links else sum(size(k, links) for k in node[2])


def walk(node):
    yield node
    for k in node[2]:
        if not isinstance(k, str):
            yield from walk(k)


def way(node, to):
    if node is to:
        return [node]
    for k in node[2]:
        if not isinstance(k, str) and (found := way(k, to)):
            return [node, *found]
    return []


def content(root):
    for tag in ("article", "main"):
        if found := [x for x in walk(root) if x[0] == tag]:
            return way(root, max(found, key=size))
    out = [root]
    while inner := [k for k in out[-1][2] if not isinstance(k, str) and 5 * size(k, False) > 4 * size(root, False)]:
        out.append(inner[0])
    return out


def foreign(node) -> bool:
    return node[0] in html_text._DROP or node[0] == "header" or bool({"cookie-notice", "site-footer", "comments", "ad"} & set(node[1].get("class", "").split()))


def plain(pages):
    """``{id: text}``; ``pages`` are (id, host, html)."""
    trees = {i: Tree(h).root for i, _, h in pages}
    met, contents = defaultdict(set), defaultdict(set)
    for i, host, _ in pages:
        key = repr(content(trees[i])[-1])
        contents[host].add(key)
        for x in walk(trees[i]):
            met[host, repr(x)].add(key)
    out = {}
    for i, host, _ in pages:
        root, kept = trees[i], content(trees[i])

        def often(x, host=host):
            n = len(met[host, repr(x)])
            return n >= html_text.MIN_PAGES and n >= html_text.MIN_SHARE * len(contents[host])

        def may_go(x, article, kept=kept, often=often):
            return size(x) > 0 and x[0] not in ("", "html", "body", "main") and not any(x is k for k in kept) and not (article and x[0] in html_text._PLAIN) and often(x)

        gone, own = [], 0

        def look(x, article, out_):
            nonlocal own
            for k in x[2]:
                if isinstance(k, str):
                    own += 0 if article or out_ or x[0] == "a" else size(k)
                elif may_go(k, article):
                    gone.append(k)
                    own += 0 if article or out_ or foreign(k) else size(k, False)
                else:
                    look(k, article or k[0] in ("article", "main"), out_ or foreign(k))

        look(root, False, False)
        if 5 * sum(size(x, False) for x in gone if not foreign(x)) > 4 * own:
            gone = [x for x in gone if 2 * size(x, False) < size(x) or foreign(x)]

        def dropped(x, gone=gone):
            return foreign(x) or any(x is g for g in gone)

        def tops(x, tag):
            found = []
            for k in x[2]:
                if not isinstance(k, str) and not dropped(k):
                    found += [k] if k[0] == tag else tops(k, tag)
            return found

        lines, line = [], []

        def flush():
            if text := " ".join("".join(line).split()):
                lines.append(text)
            line.clear()

        def blocks(x):
            for k in x[2]:
                if isinstance(k, str):
                    line.append(k)
                elif not dropped(k):
                    if k[0] in html_text._BLOCK:
                        flush()
                    blocks(k)
                    if k[0] in html_text._BLOCK:
                        flush()

        for top in tops(root, "article") or tops(root, "main")[:1] or tops(root, "body")[:1]:
            blocks(top)
            flush()
        out[i] = "\n".join(lines)
    return out


def sites(seed: int) -> list[tuple[int, str, str]]:
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    pages = []
    for site in range(6):
        menus = ["<nav><ul>" + "".join(f'<li><a href="/{k}">{prose(1)}</a></li>' for k in range(rnd.randint(2, 6))) + "</ul></nav>" for _ in range(rnd.choice((1, 4)))]
        menus += ["<div><ul>" + "".join(f"<li><a>{prose(2)}</a></li>" for _ in range(5)) + "</ul></div>" for _ in range(2)]
        boxes = [f"<div><p>{prose(6)}</p></div>", f'<div class="cookie-notice">{prose(5)}</div>', f"<section><h2>{prose(2)}</h2><p>{prose(8)}</p></section>"]
        shared = prose(20)
        for _ in range(rnd.choice((4, 30, 80))):
            body = f"<h1>{prose(4)}</h1>" + "".join(f"<p>{prose(rnd.randint(3, 30))}</p>" for _ in range(rnd.randint(1, 4)))
            if rnd.random() < 0.3:
                body += f"<p>{shared}</p>"
            body += rnd.choice(boxes) if rnd.random() < 0.5 else ""
            kind = rnd.random()
            body = f"<article>{body}</article>" if kind < 0.5 else f"<main>{body}</main>" if kind < 0.65 else f"<div>{body}</div>"
            html = f"<html><body>{rnd.choice(menus)}{rnd.choice(boxes) if rnd.random() < 0.5 else ''}{body}<aside>{prose(4)}</aside><footer>{prose(3)}</footer></body></html>"
            pages += [(len(pages) + k, f"h{site}.example", html) for k in range(rnd.choice((1, 1, 1, 5)))]
    return pages


@pytest.mark.parametrize("seed", [1, 2])
def test_random_sites_against_plain_version(spark, seed):
    pages = sites(seed)
    want = plain(pages)
    df = spark.createDataFrame([(i, f"http://{h}/{i}", t, 1, "x") for i, h, t in pages], "page_id long, url string, html string, `a.b` int, rid string")
    for bound in (html_text.MAX_BROADCAST, 0):
        got = {r.page_id: r.text for r in html_text.extract(df, max_broadcast=bound).collect()}
        assert got == want
    without = {i: html_text.main_text(t, frozenset().__contains__, 0) for i, _, t in pages}
    assert sum(without[i] != want[i] for i in want) > len(want) // 10  # recurrence decides


def test_names_are_whole(spark):
    none = frozenset().__contains__
    for kept in (
        '<body class="no-comments"><article><p>text</p></article></body>', '<body id="search"><p>text</p></body>', '<article><p data-id="share">text</p></article>',
        '<article><section id="search-algorithms">text</section></article>', '<article><div class="social-science">text</div></article>', '<main class="widget"><p>text</p></main>',
        "<body><main><article><p>text</p></article></main></body>", '<html class="modal"><body><p>text</p></body></html>',
    ):
        assert html_text.main_text(kept, none, 0) == "text", kept
    for gone in ('<div class="site-footer">x</div>', '<div class="main comments-list">x</div>', '<p id=share>x</p>', '<div role="navigation">x</div>', "<div hidden>x</div>", "<nav>x</nav>"):
        assert html_text.main_text(f"<article><p>text</p>{gone}</article>", none, 0) == "text", gone


def test_copies_are_no_template(spark):
    """A group of copies and one of near copies on one host keep their text, with an article and without."""
    rows = []
    for k in range(20):
        rows.append((k, "http://a.example/x", f"<body><ul><li><a>m{k}</a></li></ul><div><p>{'same text ' * 20}</p><p>{'more of it ' * 20}</p></div></body>"))
        rows.append((100 + k, "http://b.example/x", f"<body><div><p>{'same text ' * 20}</p><p>{'more of it ' * 20}</p><p>own {k}</p></div></body>"))
        rows.append((200 + k, "http://c.example/x", f"<body><article><h1>t{k}</h1><p>{'same text ' * 20}</p></article></body>"))
    got = Counter()
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert "same text same text" in r.text
        got[r.page_id // 100] += "more of it" in r.text
    assert got[0] == got[1] == 20


def test_rows_twice_are_one_content(spark):
    box = "<div><p>box</p></div>"
    rows = [(1, "http://a.example/", f"<body>{box}<p>{'own text here ' * 3}</p></body>")] * 12
    assert {r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"box\nown text here own text here own text here"}
