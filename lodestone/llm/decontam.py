"""Benchmark decontamination by a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item, or a whole shorter item.
Its shingles of five words are ordered by rarity.  A window is contained only
as a whole, so its prefix is one shingle, the rarest: a document meets a window
only where it has that shingle.  Where they meet, the shingle's place fixes the
window's start; windows that would cross the ends of the document are out by
length and position, and the rest is verified word by word.

The benchmark is the stated query set.  Up to ``MAX_BLOCKS`` blocks of
``BLOCK_BYTES`` of text are broadcast, one held at a time, ranked by rarity over
all documents, and each task runs its documents against all of them, so neither
the benchmark nor a hot passage moves through a shuffle.  A larger one is a
table: its windows, ranked by rarity in the benchmark, are joined with the
shingles of the documents that a bitmap of the prefixes lets through, and what
meets is verified where the document's text is.

Null texts have no words.  Items of one id are one item; items without an id
match but are not counted or named.  Repeated rows give repeated rows, empty
tables empty results (an empty benchmark hits nothing).  Very long texts are
taken alone.  Other columns are carried along by ``drop_contaminated`` whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import boxed, col, stash, text_hash
from .words import word_hashes

WINDOW, SHINGLE, PERCENT_INVERSE = 13, 5, 20
BLOCK_BYTES, MAX_BLOCKS = 8 << 20, 8
#: Bits of the bitmap for each prefix, and its bytes at most.
_BITS, _MAX_BITMAP = 16, 64 << 20
_SLICE = 4 << 20
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = b"|"


def words(text: bytes) -> list[bytes]:
    """Lower-cased words: digits, letters and everything beyond ASCII."""
    return text.translate(_FOLD).split()


def _shingles(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = (out ^ ids[at + k].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


class Block:
    """The windows of some items, with their shingles by width and, once ranked, the join's prefix lists."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.vocab: dict[bytes, int] = {_END: -2}
        numbers: dict[tuple[int, ...], int] = {}
        owners: list[set[str]] = []
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]
            for s in range(max(1, len(ids) - WINDOW + 1)) if ids else ():
                k = numbers.setdefault(tuple(ids[s : s + WINDOW]), len(owners))
                if k == len(owners):
                    owners.append(set())
                if item is not None:
                    owners[k].add(item)
        self.lens = np.array([len(t) for t in numbers], np.int64)
        self.ids = np.full((len(numbers), WINDOW), -1, np.int64)
        for k, t in enumerate(numbers):
            self.ids[k, : len(t)] = t
        names = sorted(set().union(*owners)) if owners else []
        place = {n: k for k, n in enumerate(names)}
        self.names = names
        self.owner_ptr = np.cumsum([0, *map(len, owners)])
        self.owner = np.array([place[n] for o in owners for n in sorted(o)], np.int64)
        self.tables: dict[int, np.ndarray] = {}
        self.own: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in sorted({min(SHINGLE, n) for n in self.lens.tolist()}):
            wins = np.flatnonzero(np.minimum(self.lens, SHINGLE) == width)
            win = np.repeat(wins, self.lens[wins] - width + 1)
            off = np.concatenate([np.arange(n - width + 1) for n in self.lens[wins]])
            h = _shingles(self.ids.ravel(), win * WINDOW + off, width)
            self.tables[width] = np.unique(h)
            self.own[width] = win, off, h

    def rank(self, counts: dict[int, np.ndarray]) -> None:
        """Keeps of each window the shingle that the documents have least often."""
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for width, (win, off, h) in self.own.items():
            often = counts[width][np.searchsorted(self.tables[width], h)]
            order = np.lexsort((off, h, often, win))
            first = order[np.r_[True, win[order][1:] != win[order][:-1]]]
            first = first[np.argsort(h[first], kind="stable")]
            keys, at = np.unique(h[first], return_index=True)
            self.prefix[width] = keys, np.r_[at, len(first)], win[first], off[first]
        self.own = self.tables = {}

    def _met(self, ids: np.ndarray, width: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' shingles that are among ``keys``, and which."""
        n = len(ids) - width + 1
        if n <= 0 or not len(keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = ids >= 0
        whole = known[:n].copy()
        for k in range(1, width):
            whole &= known[k : n + k]
        at = np.flatnonzero(whole)
        h = _shingles(ids, at, width)
        where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        ok = keys[where] == h
        return at[ok], where[ok]

    def count(self, tokens: list[bytes]) -> dict[int, np.ndarray]:
        ids = self._ids(tokens)
        return {w: np.bincount(self._met(ids, w, t)[1], minlength=len(t)) for w, t in self.tables.items()}

    def _ids(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, tokens, repeat(-1)), np.int64, len(tokens))

    def match(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all occurrences in ``tokens``, and their windows."""
        ids = self._ids(tokens)
        starts, wins = [], []
        for width, (keys, ptr, win, off) in self.prefix.items():
            at, which = self._met(ids, width, keys)
            n = ptr[which + 1] - ptr[which]
            entry = np.repeat(ptr[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
            w, s = win[entry], np.repeat(at, n) - off[entry]
            fits = (s >= 0) & (s + self.lens[w] <= len(ids))
            w, s = w[fits], s[fits]
            for k in range(WINDOW):
                same = (k >= self.lens[w]) | (ids[np.minimum(s + k, len(ids) - 1)] == self.ids[w, k])
                w, s = w[same], s[same]
            starts.append(s)
            wins.append(w)
        return (np.concatenate(starts), np.concatenate(wins)) if starts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _bytes(benchmark: DataFrame, item: str, item_text: str) -> tuple[DataFrame, int]:
    """The different items ``(i, t)`` and the bytes of their texts."""
    items = benchmark.select(col(item).cast("string").alias("i"), col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    return items, items.agg(F.sum(F.octet_length("t"))).first()[0] or 0


def _hashes(tokens: list[bytes]) -> np.ndarray:
    """Hashes of words that lie in a list."""
    data = np.frombuffer(b"".join(tokens) + bytes(16), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    return word_hashes(data, np.r_[0, ends[:-1]] if len(ends) else ends, ends)


def windows(items: DataFrame) -> DataFrame:
    """``(w, n, item, h)`` of every window of ``items(i, t)``: its words, their number, its item, and its shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = words(t.encode())
                h = _hashes(w)
                for s in range(max(1, len(w) - WINDOW + 1)) if w else ():
                    part = w[s : s + WINDOW]
                    width = min(SHINGLE, len(part))
                    rows.append((b" ".join(part).decode("utf-8", "replace"), len(part), i, _shingles(h, s + np.arange(len(part) - width + 1), width).view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64())))], ["w", "n", "item", "h"])

    return items.mapInArrow(run, "w string, n int, item string, h array<bigint>")


def joined(docs: DataFrame, items: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, th, n_words, n_hit, items)`` of the documents in which a window occurs; for a benchmark of any size."""
    spark = docs.sparkSession
    found = stash(windows(items), "windows")
    named = stash(found.select("w", "item").distinct(), "window-items")
    single = found.dropDuplicates(["w"]).select("w", "n", F.posexplode("h").alias("off", "h"))
    often = found.select("w", "h").dropDuplicates(["w"]).select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    rarest = F.min(F.struct("c", "h", "off")).alias("x")
    prefix = stash(single.join(often, "h").groupBy("w", "n").agg(rarest).select("w", "n", "x.h", "x.off"), "prefixes")
    bits = max(12, min((prefix.count() * _BITS).bit_length(), (8 * _MAX_BITMAP).bit_length() - 1))
    place = F.shiftrightunsigned("h", 64 - bits)
    marks = prefix.select(F.shiftrightunsigned(place, 6).alias("i"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toPandas()
    bitmap = np.zeros(1 << max(0, bits - 6), np.uint64)
    bitmap[marks["i"].to_numpy(np.int64)] = marks["b"].to_numpy(np.int64).view(np.uint64)
    held, sizes = spark.sparkContext.broadcast(bitmap), sorted({min(SHINGLE, r.n) for r in prefix.select("n").distinct().collect()})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = held.value
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for k, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                h = _hashes(words(t or b""))
                for width in sizes:
                    if len(h) >= width:
                        s = _shingles(h, np.arange(len(h) - width + 1), width)
                        at = s >> np.uint64(64 - bits)
                        on = np.flatnonzero(marks[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
                        out[0].append(np.full(len(on), k))
                        out[1].append(s[on].view(np.int64))
                        out[2].append(on)
            row, h, pos = (np.concatenate([np.empty(0, np.int64), *x]) for x in out)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(h), pa.array(pos)], ["id", "th", "h", "pos"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(col(id_col).alias("id"), text_hash(col(text)).alias("th"), col(text).cast("string").alias("t"))
    met = texts.mapInArrow(emit, f"id {kind}, th long, h long, pos long").distinct().join(prefix, "h").where("pos >= off")
    wanted = stash(met.groupBy("id", "th").agg(F.collect_set(F.struct((F.col("pos") - F.col("off")).alias("s"), "n", "w")).alias("m")), "met")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, hits, found = [], [], []
            for t, m in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                w = words(t or b"")
                step, own = np.zeros(len(w) + 1, np.int64), set()
                for x in m:
                    s, n = x["s"], x["n"]
                    if s + n <= len(w) and b" ".join(w[s : s + n]) == x["w"].encode():
                        step[s] += 1
                        step[s + n] -= 1
                        own.add(x["w"])
                sizes.append(len(w))
                hits.append(int((np.cumsum(step[:-1]) > 0).sum()))
                found.append(sorted(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["id", "th", "n_words", "n_hit", "w"])

    keys = wanted.select(F.col("id").alias("i"), F.col("th").alias("k"), "m")
    both = texts.dropDuplicates(["id", "th"]).join(keys, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("k"))).select("id", "th", "t", "m")
    sure = stash(both.mapInArrow(verify, f"id {kind}, th long, n_words long, n_hit long, w array<string>").where("n_hit > 0"), "hits")
    told = sure.select("id", "th", F.explode("w").alias("w")).join(named.where("item is not null"), "w").groupBy("id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    told = told.select(F.col("id").alias("i"), F.col("th").alias("k"), "items")
    none = F.array().cast("array<string>")
    return sure.join(told, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("k")), "left").select("id", "th", "n_words", "n_hit", F.coalesce("items", none).alias("items"))


def _slices(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t or b"")
        size += len(held[-1])
        if size >= _SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _tokens(texts: list[bytes]) -> list[bytes]:
    return b" | ".join(t.translate(_FOLD) for t in texts).split()


def _each(blocks: list) -> Iterator[Block]:
    for b in blocks:
        yield b.value
        if len(blocks) > 1 and hasattr(b, "_value"):
            del b._value  # one block at a time


def inspect(texts: list[bytes], blocks: list) -> Iterator[tuple[int, int, list[str]]]:
    """For each text its words, hit words and the items that occur in it."""
    tokens = _tokens(texts)
    ends = np.r_[np.flatnonzero(np.fromiter(map(_END.__eq__, tokens), bool, len(tokens))), len(tokens)]
    begins = np.r_[0, ends[:-1] + 1]
    step = np.zeros(len(tokens) + 1, np.int64)
    found: dict[int, set[str]] = {}
    for block in _each(blocks):
        s, w = block.match(tokens)
        np.add.at(step, s, 1)
        np.add.at(step, s + block.lens[w], -1)
        doc = np.searchsorted(begins, s, "right") - 1
        for key in np.unique(doc * len(block.lens) + w).tolist():
            d, k = divmod(key, len(block.lens))
            found.setdefault(d, set()).update(block.names[x] for x in block.owner[block.owner_ptr[k] : block.owner_ptr[k + 1]])
    hits = np.r_[0, np.cumsum(np.cumsum(step[:-1]) > 0)]
    for k, (b, e) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        yield e - b, int(hits[e] - hits[b]), sorted(found.get(k, ()))


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and PERCENT_INVERSE * n_hit >= n_words


def index(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast blocks of the benchmark, ranked by the rarity of their shingles over all of ``docs``."""
    spark = docs.sparkSession
    items, total = _bytes(benchmark, item, item_text)
    n = -(-total // block_bytes) or 1
    raw = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        raw.append(spark.sparkContext.broadcast(Block([(i, t.encode()) for i, t in part.collect()])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for texts in _slices(b.column(0).cast(pa.binary()).to_pylist()):
                tokens = _tokens(texts)
                for k, block in enumerate(_each(raw)):
                    for w, c in block.count(tokens).items():
                        sums[k, w] = sums.get((k, w), 0) + c
        for (k, w), c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(np.full(len(at), w)), pa.array(at), pa.array(c[at])], ["b", "w", "i", "c"])

    seen = docs.select(col(text).cast("string")).mapInArrow(count, "b long, w long, i long, c long").groupBy("b", "w", "i").agg(F.sum("c").alias("c"))
    ranked = []
    for k, held in enumerate(raw):
        block = held.value
        counts = {w: np.zeros(len(t), np.int64) for w, t in block.tables.items()}
        for w, i, c in (seen if n == 1 else seen.where(F.col("b") == k)).select("w", "i", "c").collect():  # at most the block's own shingles
            counts[w][i] = c
        block.rank(counts)
        ranked.append(spark.sparkContext.broadcast(block))
    return ranked


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, items (sorted strings), contaminated."""
    items, total = _bytes(benchmark, item, item_text)
    if total > max_blocks * block_bytes:
        return _by_join(docs, items, id_col, text)
    blocks = index(docs, benchmark, text, item, item_text, block_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for texts in _slices(b.column(1).cast(pa.binary()).to_pylist()) for r in inspect(texts, blocks)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([contaminated(r[0], r[1]) for r in rows], pa.bool_())], ["id", "n_words", "n_hit", "items", "contaminated"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col).alias("id"), col(text).cast("string").alias("t")).mapInArrow(scan, f"id {kind}, n_words long, n_hit long, items array<string>, contaminated boolean").withColumnRenamed("id", id_col)


def _word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).cast("long")


def _by_join(docs: DataFrame, items: DataFrame, id_col: str, text: str) -> DataFrame:
    """``contamination`` through the join of tables."""
    hits = joined(docs, items, id_col, text).select(F.col("id").alias("i"), F.col("th").alias("k"), "n_hit", "items")
    rows = docs.select(col(id_col).alias("id"), text_hash(col(text)).alias("th"), _word_count(col(text).cast("string")).alias("n_words"))
    out = rows.join(hits, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("k")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    dirty = (n_hit > 0) & (PERCENT_INVERSE * n_hit >= F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), dirty.alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; the id only tells rows apart in a large join."""
    items, total = _bytes(benchmark, item, item_text)
    if total > max_blocks * block_bytes:
        hits = joined(docs, items, id_col, text).where(PERCENT_INVERSE * F.col("n_hit") >= F.col("n_words")).select(F.col("id").alias("i"), F.col("th").alias("k"))
        rows = docs.select(boxed(docs), col(id_col).alias("id"), text_hash(col(text)).alias("th"))
        return rows.join(hits, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("k")), "left_anti").select("row.*")
    blocks = index(docs, benchmark, text, item, item_text, block_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([not contaminated(r[0], r[1]) for texts in _slices(b.column(1).cast(pa.binary()).to_pylist()) for r in inspect(texts, blocks)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep)], ["row"])

    rows = docs.select(boxed(docs), col(text).cast("string").alias("t"))
    return rows.mapInArrow(scan, rows.select("row").schema).select("row.*")
