"""Byte-level BPE encoding and decoding through a minimal acyclic transducer.

The most frequent words of all documents are compiled, with the ids that their
merges give, into a minimal acyclic automaton with shared suffixes.  Each arc
carries the number of words before it, so the sum along a word's path is the
word's rank, and the rank addresses its ids.  The automaton is one flat file,
which Spark hands to the executors from the shared folder and each worker maps
into memory.

Texts are cut into the vocabulary's pieces a batch at a time, and all pieces of
a batch walk the automaton together, a byte a step.  Pieces that aren't in it
are merged exactly, all new ones of a batch together, and only those are
remembered.  Texts with characters whose kind isn't known here (neither Western
letters nor marks) are cut by the vocabulary's own pattern.

Null text encodes to no ids and decodes to an empty text.  The special token's
string in a text becomes its id, as the tokenizers library has it.  Very long
pieces merge in time n log n.  Of equally frequent words all are in the lexicon
or none.  Repeated rows give repeated rows, empty tables empty results; only the
id and the text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import col, new_path, stash
from .merges import Merges, placed
from .words import SHORT, Memory, flat, gather, in_order, slices

#: Words in the lexicon, and bytes of its longest word.
LEXICON, LONGEST = 131_072, 32
_SLICE = 4 << 20
_COUNTED, _SHORT, _STEPS = 1 << 18, 40, 64
# The piece pattern of the byte-level vocabulary, with the white space that the library's engine knows.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, byte strings and merges of a tokenizers file."""

    def __init__(self, spec: bytes):
        j = json.loads(spec)
        model, to_byte = j["model"], byte_of_char()
        self.ids = {bytes(to_byte[c] for c in t): k for t, k in model["vocab"].items() if all(c in to_byte for c in t)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        raw = [tuple(bytes(to_byte[c] for c in x) for x in m) for m in pairs]
        self.ranks = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(raw)}
        self.packed = {pair: rank << 24 | new for pair, (rank, new) in self.ranks.items()}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.bytes = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, k in [*self.ids.items(), *((s.encode(), k) for s, k in self.special.items())]:
            self.bytes[k] = t
        self.single = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        """Merges the pair of least rank, the leftmost first, until none is left."""
        ids = [k for k in map(self.single.__getitem__, piece) if k >= 0]
        n = len(ids)
        if n <= _SHORT:
            get, none = self.packed.get, 1 << 62
            found = [get(pair, none) for pair in zip(ids, ids[1:])]
            while found and (best := min(found)) != none:
                k = found.index(best)
                ids[k] = best & 0xFFFFFF
                del ids[k + 1], found[k]
                if k:
                    found[k - 1] = get((ids[k - 1], ids[k]), none)
                if k < len(found):
                    found[k] = get((ids[k], ids[k + 1]), none)
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], k, m[1]) for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if (m := self.ranks.get(pair))]
        heapq.heapify(heap)
        while heap:
            rank, k, new = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j < 0 or self.ranks.get((ids[k], ids[j]), (-1, 0)) != (rank, new):
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (m := self.ranks.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, m[1]))
        return [k for k in ids if k >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The flat automaton: header, states' first arcs, arcs (label, target, words before), ids by rank.

    Words are added in sorted order; when a branch is finished its states are
    replaced by equal ones already there, so suffixes are shared.
    """
    register: dict[tuple, int] = {}
    finished: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def finish(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(finished)
            finished.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # for each state of the open branch: final, arcs
    last = b""
    order = sorted(words)
    for word in order:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            state = path.pop()
            path[-1][1].append((last[len(path) - 1], finish(state)))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        state = path.pop()
        path[-1][1].append((last[len(path) - 1], finish(state)))
    root = finish(path[0])
    below: list[int] = []
    for final, arcs in finished:  # targets come before their sources
        below.append(final + sum(below[t] for _, t in arcs))
    first, rows = [0], []
    for final, arcs in finished:
        n = int(final)
        for label, target in arcs:
            rows.append((label, target, n))
            n += below[target]
        first.append(len(rows))
    ids = [words[w] for w in order]
    label, target, before = (np.array([r[k] for r in rows], "<u4") for k in range(3))
    source = np.repeat(np.arange(len(finished), dtype="<u4"), np.diff(first))
    # an arc is found by its state and byte in one of two tables
    keys = source << np.uint32(8) | label
    bits, tables = placed(lambda bits: [arc_slot(keys, k, bits) for k in (0, 1)], len(keys))
    parts = [np.array([f for f, _ in finished], "u1"), target, before, np.cumsum([0, *map(len, ids)]).astype("<u4"), np.array([k for x in ids for k in x], "<u4")]
    for t in tables:
        parts += [np.where(t >= 0, keys[np.maximum(t, 0)], np.uint32(0xFFFFFFFF)).astype("<u4") if len(keys) else np.full(len(t), 0xFFFFFFFF, "<u4"), t.astype("<i4")]
    head = struct.pack("<6I", root, len(finished), len(rows), len(ids), sum(map(len, ids)), bits)
    return head + b"".join(p.tobytes() + bytes(-len(p.tobytes()) % 8) for p in parts)


def arc_slot(keys: np.ndarray, side: int, bits: int) -> np.ndarray:
    """An arc's place in one of the two tables."""
    k = keys ^ (keys >> np.uint32(15)) if side else keys
    return (k * np.uint32((0x9E3779B1, 0x85EBCA77)[side])) >> np.uint32(32 - bits)


class Lexicon:
    """A compiled automaton in any buffer, such as a mapped file."""

    def __init__(self, data):
        self.root, self.states, arcs, self.words, ids, self.bits = struct.unpack_from("<6I", data)
        at, view, parts = 24, memoryview(data), []
        size = 1 << self.bits
        for code, count in (("u1", self.states), ("<u4", arcs), ("<u4", arcs), ("<u4", self.words + 1), ("<u4", ids), ("<u4", size), ("<i4", size), ("<u4", size), ("<i4", size)):
            n = count * np.dtype(code).itemsize
            parts.append(np.frombuffer(view[at : at + n], code))
            at += n + -n % 8
        self.final, self.target, self.before, self.at, self.ids = parts[:5]
        self.keys, self.arcs = parts[5::2], parts[6::2]

    def walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of every word, -1 for those that aren't in the lexicon; all words go a byte a step."""
        out = np.full(len(starts), -1, np.int64)
        live = np.flatnonzero(ends - starts <= LONGEST)
        at, stop = starts[live], ends[live]
        state, rank = np.full(len(live), self.root, np.uint32), np.zeros(len(live), np.uint32)
        while len(live):
            over = at == stop
            if over.any():
                k = np.flatnonzero(over & (self.final[state] > 0))
                out[live[k]] = rank[k]
                on = ~over
                live, at, stop, state, rank = live[on], at[on], stop[on], state[on], rank[on]
                if not len(live):
                    break
            key = state << np.uint32(8) | data[at]
            slot = arc_slot(key, 0, self.bits)
            arc = np.where(self.keys[0][slot] == key, self.arcs[0][slot], -1)
            rest = np.flatnonzero(arc < 0)
            slot = arc_slot(key[rest], 1, self.bits)
            arc[rest] = np.where(self.keys[1][slot] == key[rest], self.arcs[1][slot], -1)
            on = arc >= 0
            arc = arc[on]
            live, at, stop, state, rank = live[on], at[on] + 1, stop[on], self.target[arc], rank[on] + self.before[arc]
        return out

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None."""
        rank = int(self.walk(np.frombuffer(word + bytes(SHORT), np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0])
        return None if rank < 0 else self.ids[self.at[rank] : self.at[rank + 1]].tolist()


#: Kinds of characters: 0 white space, 1 letters, 2 numbers, 3 others, 9 not known here.
_KINDS = np.full(256, 9, np.uint8)
_KINDS[:128] = 3
_KINDS[[9, 10, 11, 12, 13, 32]] = 0
_KINDS[[c for c in range(128) if chr(c).isalpha()]] = 1
_KINDS[48:58] = 2
#: By the first byte less 0xC2 and the second less 0x80: letters up to U+024F, all beyond Latin-1 are; U+0085 and U+00A0 are white space.
_TWO = np.ones((8, 64), np.uint8)
_TWO[0] = [9 if c in (0x85, 0xA0) else 1 if chr(c).isalpha() else 2 if chr(c).isnumeric() else 3 for c in range(0x80, 0xC0)]
_TWO[1] = [1 if chr(c).isalpha() else 3 for c in range(0xC0, 0x100)]
#: Third bytes behind E2 80 and E2 82: general punctuation without its white space and directions, currency signs.
_THREE = np.full((2, 64), 9, np.uint8)
_THREE[0, 0x0B:0x28] = 3
_THREE[0, 0x30:0x40] = 3
_THREE[1, 0x20:0x40] = 3


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of every byte's character; ``data`` has zeros behind it."""
    kind = _KINDS[data]
    lead = np.flatnonzero(data >= 0xC2)
    first, second, third = data[lead], data[lead + 1], data[lead + 2]
    two = first <= 0xC9
    k = _TWO[first[two] - 0xC2, second[two] & 63]
    kind[lead[two]] = kind[lead[two] + 1] = k
    three = (first == 0xE2) & ((second == 0x80) | (second == 0x82))
    k = _THREE[(second[three] == 0x82).astype(np.int64), third[three] & 63]
    kind[lead[three]] = kind[lead[three] + 1] = kind[lead[three] + 2] = k
    return kind


def cut_pieces(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the vocabulary's pieces, and the numbers of texts whose pieces must be found otherwise.

    Runs of letters, of numbers and of other marks are pieces, with a blank before them if there is one; of white
    space before them all but its last character is one; letters of a contraction go with an apostrophe that
    neither a blank nor a mark precedes.
    """
    n = len(data) - SHORT
    kind = _kinds(data)[:n]
    text = data[:n]
    opens = np.zeros(n + 1, bool)
    opens[ends] = True
    first, last = opens[:-1], opens[1:]
    space = kind == 0
    before = np.empty(n, np.uint8)
    before[:1], before[1:] = 9, kind[:-1]
    blank = np.zeros(n, bool)
    blank[1:] = text[:-1] == 32
    blank &= ~first
    start = space & (first | (before != 0))
    start[:-1] |= space[:-1] & ~space[1:] & ~last[:-1]
    start |= ~space & (first | (before != kind)) & ~blank
    quote = np.flatnonzero((text == 39) & (first | (before == 1) | (before == 2) | ((before == 0) & ~blank)))
    if len(quote):
        left = ends[np.searchsorted(ends, quote, "right")] - quote  # bytes of the text from here on
        a, b = data[quote + 1], data[quote + 2]
        one = (left > 1) & ((a == 115) | (a == 116) | (a == 109) | (a == 100))
        two = (left > 2) & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        size = np.where(one, 2, np.where(two, 3, 0))
        on = size > 0
        quote, size, left = quote[on], size[on], left[on]
        start[quote + 1] = False
        goes_on = size < left
        behind = (quote + size)[goes_on]
        start[behind] |= ~space[behind]
    starts = np.flatnonzero(start)
    odd = np.unique(np.searchsorted(ends, np.flatnonzero(kind == 9), "right")) - 1
    return starts, np.r_[starts[1:], n] if len(starts) else starts, odd


class Encoder:
    """Ids of texts by batch: pieces walk the lexicon, and what it lacks is merged and remembered."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.pattern = regex.compile(_PIECES).findall
        self.single = np.array(vocabulary.single, np.int32)
        left, right, new = (np.array(x, np.int64) for x in zip(*((a, b, new) for (a, b), (_, new) in sorted(vocabulary.ranks.items(), key=lambda x: x[1][0])), strict=True))
        self.merges = Merges(left, right, new)
        self.memory = Memory(self._new, first=lexicon.ids)
        self.walked = self.met = 0

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by merging, and their numbers."""
        size = ends - starts
        counts, parts = np.zeros(len(size), np.int64), []
        for low, high in pairwise((0, 4, 6, 8, 10, 12, SHORT, 2 * SHORT)):
            at = np.flatnonzero((size > low) & (size <= high))
            if len(at):
                cells = np.arange(high)
                rows = np.where(cells < size[at, None], self.single[data[np.minimum(starts[at, None] + cells, len(data) - 1)]], -1)
                ids, counts[at] = self.merges.run(rows)
                parts.append((at, ids))
        at = np.flatnonzero(size > 2 * SHORT)
        found = [self.vocabulary.merge(data[i:j].tobytes()) for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        counts[at] = [len(x) for x in found]
        parts.append((at, np.array([k for x in found for k in x], np.uint32)))
        return in_order(parts, counts), counts

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one behind the other, and their numbers."""
        rank = self.lexicon.walk(data, starts, ends)
        known = rank >= 0
        self.walked, self.met = self.walked + int(known.sum()), self.met + len(rank)
        at, n = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        at[known] = self.lexicon.at[rank[known]]
        n[known] = self.lexicon.at[rank[known] + 1] - self.lexicon.at[rank[known]]
        rest = ~known
        at[rest], n[rest] = self.memory.look(data, starts[rest], ends[rest])
        return gather(self.memory.ids, at, n), n

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text by the vocabulary's own pattern, with its special tokens."""
        cut, special = self.vocabulary.cut, self.vocabulary.special
        out = [np.empty(0, np.uint32)]
        for k, part in enumerate(cut.split(text) if cut else [text]):
            if k % 2:
                out.append(np.array([special[part]], np.uint32))
            elif part:
                data, ends = flat(pa.array(self.pattern(part)))
                out.append(self._ids(data, ends[:-1], ends[1:])[0])
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and each text's number of ids."""
        data, ends = flat(texts)
        starts, stops, odd = cut_pieces(data, ends)
        raw = data.tobytes()
        special = [m.start() for t in self.vocabulary.special for m in re.finditer(re.escape(t.encode()), raw)]
        odd = np.union1d(odd, np.searchsorted(ends, special, "right") - 1).astype(np.int64)
        if len(odd):
            strange = np.zeros(len(ends) - 1, bool)
            strange[odd] = True
            own = ~strange[np.searchsorted(ends, starts, "right") - 1]
            starts, stops = starts[own], stops[own]
        ids, n = self._ids(data, starts, stops)
        total = np.r_[0, np.cumsum(n)][np.searchsorted(starts, ends)]
        counts = np.diff(total)
        if not len(odd):
            return ids, counts
        parts, last = [], 0
        for d in odd.tolist():
            whole = self._whole(raw[ends[d] : ends[d + 1]].decode())
            parts += [ids[last : total[d]], whole]
            last, counts[d] = total[d], len(whole)
        return np.concatenate([*parts, ids[last:]]), counts

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, text: str = "text", size: int = LEXICON) -> list[str]:
    """The most frequent words of all texts, at most ``size``, with the blank before them.

    A word is letters between blanks; words of more than LONGEST bytes are aside.  Words come by steps of their
    count's logarithm, and only whole steps come.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in sums if w.isalpha()]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(map(sums.__getitem__, words)), pa.int64())], ["p", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                sums.update((t or "").split(" "))
                if len(sums) >= _COUNTED:
                    yield out()
                    sums.clear()
        yield out()

    counts = docs.select(col(text).cast("string")).mapInArrow(count, "p string, c long")
    counts = counts.where(F.octet_length("p") < LONGEST).groupBy("p").agg(F.sum("c").alias("c")).where("c > 1")
    counts = stash(counts.select("p", F.floor(F.log2("c") * _STEPS).cast("int").alias("step")), "words")
    # a sorted limit would send its number of rows from every partition to the driver; the steps are a few hundred
    steps = sorted(counts.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    least, held = 1 << 30, 0
    for step, n in steps:
        if held + n > size:
            break
        least, held = step, held + n
    return sorted(" " + r.p for r in counts.where(F.col("step") >= least).select("p").collect())


def share(spark: SparkSession, data: bytes) -> str:
    """Writes ``data`` to the shared folder and has Spark hand it to every executor; returns its name there."""
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    path = f"{new_path(spark, 'lexicon')}/{name}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(data)
    out.close()
    if not any(str(f).endswith(name) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


_encoders: dict[str, Encoder] = {}


def _encoder(spec, name: str) -> Encoder:
    """One encoder for each worker and lexicon."""
    if name not in _encoders:
        _encoders.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _encoders[name] = Encoder(Vocabulary(spec.value), Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
    return _encoders[name]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", lexicon: int = LEXICON) -> DataFrame:
    """``(id, ids array<int>, decoded string)`` of every row; ``path`` names the vocabulary file on the driver."""
    spark = docs.sparkSession
    with open(path, "rb") as f:
        raw = f.read()
    vocabulary = Vocabulary(raw)
    marks = [x + chr(c) for c in range(128) for x in ("", " ")]
    data = compile_lexicon({p.encode(): vocabulary.merge(p.encode()) for p in [*marks, *frequent_words(docs, text, lexicon)]})
    name, spec = share(spark, data), spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(spec, name)
        for b in batches:
            first = 0
            for texts in slices(b.column(1), _SLICE):
                ids, n = e.encode(texts)
                ends = np.r_[0, np.cumsum(n)]
                decoded = [e.decode(ids[i:j]) for i, j in pairwise(ends.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])
                first += len(texts)

    rows = docs.select(col(id_col).alias("id"), col(text).cast("string").alias("t")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")
    return rows.select(F.col("id").alias(id_col), "ids", "decoded")
