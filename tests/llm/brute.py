"""Plain Python versions of what the operators must give."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    wins = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    held = {p for k in range(len(w) - 4) if wins[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held), len(w) < 10 or 100 * len(held) > 20 * len(w)


def distance(p: list[int], q: list[int]) -> float | None:
    """Jensen-Shannon distance of two histograms."""
    a, b = sum(p), sum(q)
    if not a or not b:
        return None
    total = 0.0
    for x, y in zip(p, q, strict=True):
        x, y = x / a, y / b
        total += (x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0)
    return math.sqrt(max(total / 2, 0.0))


def classes(text: str) -> list[int]:
    """Characters by class: small, white space, capitals, beyond ASCII, digits, usual marks, the rest."""
    kinds = ("abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", None, "0123456789", "-.,;:!?'\"()")
    out = [0] * 7
    for c in text:
        out[3 if c > "\x7f" else next((k for k, x in enumerate(kinds) if x and c in x), 6)] += 1
    return out


def good(docs: list[tuple[object, str | None, str | None]], common: int, reference: int, guard: int, class_bound: float, word_bound: float) -> list[bool]:
    """The verdict on each ``(id, text, lang)``."""
    words, chars = defaultdict(Counter), defaultdict(lambda: [0] * 7)
    for _, text, lang in docs:
        words[lang or ""].update(WORD.findall(text or ""))
        chars[lang or ""] = [a + b for a, b in zip(chars[lang or ""], classes(text or ""), strict=True)]
    out = []
    for _, text, lang in docs:
        w, ref = WORD.findall(text or ""), words[lang or ""]
        ok = not quality(text)[5]
        if ok and len(w) >= guard and ref.total() >= reference:
            top = sorted(ref, key=lambda x: (-ref[x], x.encode()))[:common]
            own = Counter(w)
            far = distance(classes(text), chars[lang or ""]) or 0
            odd = distance([*(own[x] for x in top), len(w) - sum(own[x] for x in top)], [*(ref[x] for x in top), ref.total() - sum(ref[x] for x in top)]) or 0
            ok = far <= class_bound and odd <= word_bound
        out.append(ok)
    return out


def secrets(text: str | None) -> list[tuple[int, int, str, int]]:
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, "assign", m.end())] * (len(m[2]) >= 6)
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def personal(text: str | None) -> list[tuple[str, int, int]]:
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int | None, str | None]]) -> dict[int, tuple]:
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(LOWER))
    wins: dict[tuple, set] = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else []:
            wins[tuple(w[k : k + 13])] |= {str(i)} if i is not None else set()
    lens, out = {len(k) for k in wins}, {}
    for i, t in docs:
        w, found = words(t), set()
        hit = [0] * len(w)
        for n in lens:
            for k in range(len(w) - n + 1):
                if (q := tuple(w[k : k + n])) in wins:
                    found |= wins[q]
                    hit[k : k + n] = [1] * n
        h = sum(hit)
        out[i] = len(w), h, sorted(found), h > 0 and 20 * h >= len(w)
    return out


def fingerprint(text: str | None) -> int:
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def shingles(text: str | None) -> frozenset[str]:
    """The five-word shingles of a text; all of a shorter one is one."""
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def first_of_copies(rows: list[tuple[int, str | None]]) -> list[int]:
    """The least id of each group of texts that a similarity of 0.8 or more connects; by all pairs."""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if sets[a] == sets[b] or 9 * n >= 4 * (len(sets[a]) + len(sets[b])) and n:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted(i for i in parent if find(i) == i)


def components(prints: dict) -> dict:
    """The least key that each key reaches over at most two differing bits."""
    parent = {i: i for i in prints}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    keys = sorted(prints)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def without_repeats(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str | None]]:
    """Lines, removed lines and text by id; ids are unique here."""
    first: dict[tuple, tuple[int, int]] = {}
    for i, t in sorted(docs):
        if t is None:
            continue
        lines = t.split("\n")
        for k in range(max(1, len(lines) - 2)):
            w = tuple(lines[k : k + 3])
            if any(WORD.search(x) for x in w):
                first.setdefault(w, (i, k))
    out = {}
    for i, t in docs:
        if t is None:
            out[i] = 0, 0, None
            continue
        lines, gone = t.split("\n"), set()
        for k in range(max(1, len(lines) - 2)):
            w = tuple(lines[k : k + 3])
            if first.get(w, (i, k)) != (i, k):
                gone |= set(range(k, min(k + 3, len(lines))))
        left = [x for k, x in enumerate(lines) if k not in gone]
        out[i] = len(lines), len(gone), "\n".join(left)
    return out
