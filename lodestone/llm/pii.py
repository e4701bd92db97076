"""Personal data by patterns and a skip-chain conditional random field.

Patterns find mail addresses, IP addresses, payment cards and phone numbers;
what they find stays.  The field labels all tokens with digits or an at sign.
Tokens of a pattern match have its label; the others' labels are inferred from
three kinds of potentials: a token's shape, the labels of tokens that stand
together (linear chain), and, over any distance, equal or similar tokens (skip
edges: digits that end a run of seven or more alike, or equal local parts).
Loopy belief propagation runs over each document's graph, all graphs of a batch
at once.  A token outside the matches is reported if a label's belief is at
least ``BELIEF``; neighbouring tokens of one label become one span.  So a phone
number that a pattern misses, because an address stands right behind it, is
found by the shapes of its parts, and a number written in another way by its
link to a match.

All potentials are counted over all documents: shapes in ``BUCKETS`` hashed
buckets by label, label pairs of neighbours, and how often linked tokens of
matches agree; tokens outside matches count as unlabelled, but for those that a skip
edge ties to a match, whose label is open.  A shape tells
whether an address's parts or a card number's check digit are right, so numbers
that only look like one are unlabelled by themselves.  The counts have a fixed
size, so they may go to the driver.  Skip edges lead from each occurrence to the
next, not between all pairs, so a document's graph is linear in its tokens, and
so is the work for very long texts.

Places are code points.  Null text counts as empty.  Of equally likely labels
the first of KINDS counts.  Repeated rows give repeated rows (and count as often
in the potentials), empty tables empty results; only the id and the text are
read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._base import col

KINDS = ("email", "ip", "card", "phone")
BUCKETS, BELIEF, ROUNDS, DAMPING = 1 << 16, 0.9, 20, 0.3
#: How much a label's share of all tokens weighs in its share of a shape's.
_PRIOR = 1.0
_O = len(KINDS)
#: Digits that one span of a kind can have; addresses are one token.
_MOST = (0, 0, 19, 15)
_ANY = re.compile("[0-9@]").search
# The patterns of the four kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)").match
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_RUN = re.compile("[0-9]+").finditer
_PART = re.compile(r"[A-Za-z0-9@._%+()-]+").finditer
_DIGITS = str.maketrans("", "", " ().-+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN(text, at + 1)):
                yield start, m.end()
                end = m.end()
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for run in _RUN(text):
        if run.start() >= end and (m := _IP(text, run.start())):
            end = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD(text):
        digits = m[0].translate(_DIGITS)
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind as in KINDS, then start."""
    if not _ANY(text):
        return []
    return [(k, *x) for k, find in enumerate((_emails, _ips, _cards, _phones)) for x in find(text)]


def shape(token: str) -> str:
    """Runs of digits by length, letters as one sign, other characters as they are; a mark behind what can't be valid."""
    out = re.sub("[0-9]+", lambda m: f"{min(len(m[0]), 20)}d", re.sub("[A-Za-z]+", "A", token))
    digits = token.translate(_DIGITS)
    wrong = digits.isdecimal() and (
        16 <= len(digits) <= 19 and "." not in token and not luhn(digits) or token.count(".") == 3 and any(len(p) > 3 or int(p) > 255 for p in token.split(".") if p.isdecimal())
    )
    return out[:24] + "!" * wrong


def _bucket(token: str) -> int:
    return xxh64_intdigest(shape(token).encode()) % BUCKETS


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, end, label)`` of the text's tokens by start: of those in matches their kind, of others ``_O``."""
    taken = sorted((s, e, k) for k, s, e in base)
    out, at, reach = [], 0, (0, _O)
    for m in _PART(text):
        if not _ANY(m[0]):
            continue
        token = m[0].strip(".%-")
        if not token:
            continue
        start = m.start() + m[0].find(token)
        end = start + len(token)
        while at < len(taken) and taken[at][0] < end:
            if taken[at][1] > reach[0]:
                reach = taken[at][1], taken[at][2]
            at += 1
        out.append((start, end, reach[1] if reach[0] > start else _O))
    return out


def _edges(text: str, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges of tokens that stand together, and skip edges from each occurrence to the next like it."""
    chain = [(k, k + 1) for k, (a, b) in enumerate(zip(found, found[1:], strict=False)) if b[0] - a[1] <= 2]
    last: dict[tuple, int] = {}
    skip = []

    def link(key: tuple, k: int) -> None:
        if key in last:
            skip.append((last[key], k))
        last[key] = k

    run: list[int] = []
    for k, (s, e, _) in enumerate(found):
        token = text[s:e]
        if "@" in token:
            local = token.split("@")[0].lower()
            if len(local) >= 4:
                link(("@", local), k)
        if run and (s - found[run[-1]][1] > 1 or not _number(token)):
            _ends(text, found, run, link)
            run = []
        if _number(token):
            run.append(k)
    _ends(text, found, run, link)
    return chain, skip


def _number(token: str) -> bool:
    return token.translate(_DIGITS).isdecimal()


def _ends(text: str, found: list[tuple[int, int, int]], run: list[int], link) -> None:
    """Links the tokens of a run of numbers, from its end on, by the run's last seven digits."""
    digits = "".join(text[found[k][0] : found[k][1]].translate(_DIGITS) for k in run)
    if len(digits) >= 7:
        size = 0
        for k in reversed(run):
            if size >= 7:
                break
            link((digits[-7:], size), k)
            size += len(text[found[k][0] : found[k][1]].translate(_DIGITS))


class Potentials:
    """Log potentials from counts: shapes[bucket, label], pairs[label, label], agree and differ of linked tokens."""

    def __init__(self, shapes: np.ndarray, pairs: np.ndarray, agree: float, differ: float):
        share = (shapes.sum(axis=0) + 1.0) / (shapes.sum() + _O + 1)
        self.node = np.log((shapes + _PRIOR * share) / (shapes.sum(axis=1, keepdims=True) + _PRIOR))
        p = pairs + pairs.T + 1.0
        p /= p.sum()
        self.chain = np.log(p) - np.log(p.sum(axis=1, keepdims=True)) - np.log(p.sum(axis=0, keepdims=True))
        self.skip = np.full((_O + 1, _O + 1), np.log((differ + 1.0) / (agree + differ + 2.0) / _O))
        np.fill_diagonal(self.skip, np.log((agree + 1.0) / (agree + differ + 2.0)))


def beliefs(unary: np.ndarray, edges: np.ndarray, kind: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Marginals of all nodes by sum-product message passing with damping, all messages at once.

    ``edges`` are pairs of nodes, ``weights[kind]`` their log potentials, first node by second.
    """
    if not len(edges):
        total = unary
    else:
        n = len(edges)
        source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        w = np.concatenate([weights[kind], weights[kind].transpose(0, 2, 1)])
        back = np.r_[np.arange(n, 2 * n), np.arange(n)]
        messages = np.zeros((2 * n, unary.shape[1]))
        total = unary
        for _ in range(ROUNDS):
            inward = (total[source] - messages[back])[:, :, None] + w
            top = inward.max(axis=1)
            new = top + np.log(np.exp(inward - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            messages = (1 - DAMPING) * new + DAMPING * messages
            total = unary.copy()
            np.add.at(total, target, messages)
    out = np.exp(total - total.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def label(texts: list[str | None], bases: list[list[tuple[int, int, int]]], potentials: Potentials) -> list[list[tuple[int, int, int]]]:
    """The spans ``(kind, start, end)`` that the field adds to each text's matches."""
    graphs = [nodes(t, b) if t and _ANY(t) else [] for t, b in zip(texts, bases, strict=True)]
    first = np.cumsum([0, *map(len, graphs)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not first[-1]:
        return out
    edges, kinds = [], []
    for t, found, at in zip(texts, graphs, first.tolist(), strict=False):
        if found:
            for kind, pairs in enumerate(_edges(t, found)):
                edges += [(at + a, at + b) for a, b in pairs]
                kinds += [kind] * len(pairs)
    unary = potentials.node[[_bucket(t[s:e]) for t, found in zip(texts, graphs, strict=True) for s, e, _ in found]]
    given = np.array([k for found in graphs for *_, k in found])
    held = np.flatnonzero(given != _O)
    unary[held] = -30.0
    unary[held, given[held]] = 0.0
    marginals = beliefs(unary, np.array(edges, np.int64).reshape(-1, 2), np.array(kinds, np.int64), np.stack([potentials.chain, potentials.skip]))
    best, sure = marginals.argmax(axis=1), marginals.max(axis=1) >= BELIEF
    for d, found in enumerate(graphs):
        for k, (s, e, kind) in enumerate(found, int(first[d])):
            if kind == _O and best[k] != _O and sure[k]:
                spans = out[d]
                if spans and spans[-1][0] == best[k] and s - spans[-1][2] <= 2 and sum(map(str.isdecimal, texts[d][spans[-1][1] : e])) <= _MOST[best[k]]:
                    spans[-1] = (spans[-1][0], spans[-1][1], e)
                else:
                    spans.append((int(best[k]), s, e))
    return out


def train(docs: DataFrame, text: str = "text") -> Potentials:
    """Counts over all documents; at most ``BUCKETS * 5 + 27`` numbers come back, of those the ones that aren't 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[tuple[int, int, int]] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if not t or not _ANY(t):
                    continue
                found = nodes(t, base_spans(t))
                chain, skip = _edges(t, found)
                open_ = {x for i, j in skip for x, y in ((i, j), (j, i)) if found[x][2] == _O != found[y][2]}
                for k, (s, e, kind) in enumerate(found):
                    if k not in open_:
                        sums[0, _bucket(t[s:e]), kind] += 1
                for i, j in chain:
                    if i not in open_ and j not in open_:
                        sums[1, found[i][2], found[j][2]] += 1
                for i, j in skip:
                    if found[i][2] != _O and found[j][2] != _O:
                        sums[2, int(found[i][2] == found[j][2]), 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[n] for k in sums], pa.int64()) for n in range(3)] + [pa.array(list(sums.values()), pa.int64())], ["w", "a", "b", "c"])

    rows = docs.select(col(text).cast("string")).mapInArrow(count, "w long, a long, b long, c long").groupBy("w", "a", "b").agg(F.sum("c").alias("c")).collect()
    shapes, pairs, linked = np.zeros((BUCKETS, _O + 1)), np.zeros((_O + 1, _O + 1)), [0, 0]
    for w, a, b, c in rows:
        if w == 0:
            shapes[a, b] = c
        elif w == 1:
            pairs[a, b] = c
        else:
            linked[a] = c
    return Potentials(shapes, pairs, linked[1], linked[0])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_()), ("match", pa.string())])


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, spans)``: (kind, start, end, added, match) by kind as in KINDS, then start."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            bases = [base_spans(t or "") for t in texts]
            added = label(texts, bases, held.value)
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "added": new, "match": t[s:e]} for k, s, e, new in sorted([(*x, False) for x in base] + [(*x, True) for x in more])] for t, base, more in zip(texts, bases, added, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(_SPAN))], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(col(id_col).alias("id"), col(text).cast("string").alias("t")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,added:boolean,match:string>>")
    return out.select(F.col("id").alias(id_col), "spans")
