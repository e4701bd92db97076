"""Token ids in grammar-compressed shards (Re-Pair).

Documents are ordered by id, encoded, and cut into shards of about
``SHARD_IDS`` ids.  Within a shard the frequent pairs of neighbouring symbols
are replaced by nonterminals, again and again, until no pair stands
``MIN_PAIRS`` times or more.  While more than ``PER_ROUND`` pairs are frequent,
a round replaces those of the upper ranks; then it replaces all, and the rounds
that follow count only pairs with a symbol of the round before, as no other can
have become more frequent.  Occurrences go from left to right without overlap.
A shard stores its rules (two symbols each), the expansion length of every
nonterminal, the remaining sequence and its documents' lengths, so any range of
ids can be decoded without the rest.

Shards are rows of a Parquet folder, one binary column for each part, since
Spark's writer is the way to shared storage that survives lost tasks.  The
ids' place in the whole corpus follows from the sums of the writing tasks.

Words are encoded once and remembered by their bytes; a batch is cut into words
and looked up as a whole.  Null text encodes to no ids before the end id.
Order: id, null first, then the text's hash; rows that tie there are equal.
Very long texts are one document of a shard that is as long.  Empty tables give
an empty folder; only id and text are read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._base import new_path, small, stash, text_hash
from .bpe import byte_of_char
from .merges import Merges
from .words import SHORT, Memory, cut, flat, gather, in_order, lowered, slices

END_ID, SHARD_IDS, MIN_PAIRS, PER_ROUND = 1, 1 << 20, 8, 8192
_SLICE, _SLOT_BITS = 4 << 20, 20
_SCHEMA = "part int, shard int, docs binary, lens binary, rules binary, spans binary, seq binary, n_ids long"


class WordEncoder:
    """Ids of texts as the tokenizers library has them, word by word.

    The vocabulary's rules never look across ASCII blanks, nor from letters to a
    mark behind them, and only behind an apostrophe from a mark to letters; no
    character composes across these places.  So texts are cut there.  A word of
    small Latin letters is one piece, and all such words of a batch that are new
    are merged together; other words go to the library.  Capitals count as small
    ones if an ASCII character follows, so that no mark composes with them.
    """

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        model = json.loads(spec)["model"]
        ids, char_of = model["vocab"], {b: c for c, b in byte_of_char().items()}
        ending = model["end_of_word_suffix"]
        self.inner, self.final = (np.array([ids[char_of[b] + x] for b in range(256)], np.int32) for x in ("", ending))
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(*(np.array([ids[x] for x in side]) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])))
        self.memory = Memory(self._new)

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and their numbers."""
        size = ends - starts
        most = 2 * SHORT
        cells = np.minimum(starts[:, None] + np.arange(most + 1), len(data) - 1)
        inside = np.arange(most + 1) < size[:, None]
        c = data[cells]
        c[~inside] = 97
        letter, lead = (c >= 97) & (c <= 122), c == 0xC3
        behind = np.zeros_like(lead)
        behind[:, 1:] = lead[:, :-1]
        fine = behind & (c >= 0x9F) & (c <= 0xBF) & (c != 0xB7) | ~behind & (letter | lead)
        plain = fine.all(axis=1) & (size <= most)
        counts = np.zeros(len(size), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in pairwise((0, 4, 6, 8, 10, 12, SHORT, most)):
            at = np.flatnonzero(plain & (size > low) & (size <= high))
            if not len(at):
                continue
            rows = np.where(inside[at, :high], self.inner[c[at, :high]], -1)
            rows[np.arange(len(at)), size[at] - 1] = self.final[c[at, size[at] - 1]]
            ids, counts[at] = self.merges.run(rows)
            parts.append((at, ids))
        at = np.flatnonzero(~plain)
        found = [self.tokenizer.encode(data[i:j].tobytes().decode(), add_special_tokens=False).ids for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        counts[at] = [len(x) for x in found]
        parts.append((at, np.array([k for x in found for k in x], np.uint32)))
        return in_order(parts, counts), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and each text's number of ids."""
        data, ends = flat(texts)
        plain = b"<|" not in data.tobytes()  # a special token's string holds letters and marks
        if plain:
            lowered(data)
        opens, closes = cut(data, ends, marks=plain)
        at, n = self.memory.look(data, opens, closes)
        total = np.r_[0, np.cumsum(n)]
        return gather(self.memory.ids, at, n), np.diff(total[np.searchsorted(opens, ends)])


def compress(ids: np.ndarray, min_pairs: int = MIN_PAIRS, per_round: int = PER_ROUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rules, lengths, sequence)``: nonterminal k stands for ``rules[k]``; its id is the first free one plus k.

    ``sequence`` has that first free id before its symbols.
    """
    seq = ids.astype(np.uint32)
    base = int(seq.max(initial=0)) + 1
    rules: list[np.ndarray] = []
    free = base
    whole = True
    while whole and len(seq) > 1:
        pairs = _pairs(seq)
        keys, counts = _often(pairs, min_pairs)
        whole = len(keys) > per_round
        if whole:
            keys = keys[np.argpartition(-counts, per_round)[:per_round]]
        seq, fresh, made = _replace(seq, *_among(keys, pairs), keys, free)
        rules.append(made)
        free += len(made)
    # all frequent pairs have gone at once; from here on only pairs with a symbol of the last round can be frequent
    while rules and len(rules[-1]):
        near = np.zeros(len(seq) + 1, bool)
        near[fresh] = near[fresh - 1] = True  # place -1 is the one added
        near = np.flatnonzero(near[: len(seq) - 1])
        pairs = _pairs(seq, near)
        keys, _ = _often(pairs, min_pairs)
        at, which = _among(keys, pairs)
        seq, fresh, made = _replace(seq, near[at], which, keys, free)
        rules.append(made)
        free += len(made)
    pair = np.concatenate(rules) if rules else np.empty(0, np.uint64)
    table = np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], axis=1).astype("<u4")
    return table, expansion_lengths(table, base), np.r_[np.uint32(base), seq].astype("<u4")


def _pairs(seq: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Neighbouring symbols as one number, at all places or some."""
    left, right = (seq[:-1], seq[1:]) if at is None else (seq[at], seq[at + 1])
    return left.astype(np.uint64) << np.uint64(32) | right


def _often(pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs that stand ``least`` times or more, and how often."""
    ordered = np.sort(pairs)
    cuts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True]) if len(pairs) else np.zeros(1, np.int64)
    counts = np.diff(cuts)
    some = np.flatnonzero(counts >= least)
    return ordered[cuts[some]], counts[some]


def _among(keys: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that are among ``keys``, and which; a table of slots finds a pair in one step."""
    where = np.full(len(pairs), -1, np.int64)
    left, bits = np.arange(len(keys)), _SLOT_BITS
    while len(left):  # keys that share a slot get tables of their own
        table = np.full(1 << bits, -1, np.int32)
        table[_slot(keys[left], bits)] = left
        found = table[_slot(pairs, bits)]
        held = (found >= 0) & (keys[found] == pairs)
        where[held] = found[held]
        left, bits = left[table[_slot(keys[left], bits)] != left], bits - 1
    at = np.flatnonzero(where >= 0)
    return at, where[at]


def _replace(seq: np.ndarray, at: np.ndarray, which: np.ndarray, keys: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence with its pairs ``keys[which]`` at places ``at`` replaced, where the new symbols stand, and the rules made."""
    # of overlapping occurrences every other one from the left
    count = np.arange(len(at))
    run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], count, 0)) if len(at) else count
    odd = (count - run) % 2 == 0
    at, which = at[odd], which[odd]
    used = np.bincount(which, minlength=len(keys)) > 0
    seq[at] = (np.cumsum(used) - 1 + free).astype(np.uint32)[which]
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    return seq[keep], at - np.arange(len(at)), keys[used]


def _slot(pairs: np.ndarray, bits: int) -> np.ndarray:
    return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """A rule's symbols come before it, in earlier rounds or as ids, so one pass by doubling settles all."""
    lengths = np.ones(len(rules), np.int64)
    todo = np.arange(len(rules))
    known = np.zeros(len(rules), bool)
    while len(todo):
        left, right = rules[todo, 0].astype(np.int64) - base, rules[todo, 1].astype(np.int64) - base
        ready = ((left < 0) | known[np.maximum(left, 0)]) & ((right < 0) | known[np.maximum(right, 0)])
        now = todo[ready]
        lengths[now] = sum(np.where(x[ready] < 0, 1, lengths[np.maximum(x[ready], 0)]) for x in (left, right))
        known[now] = True
        todo = todo[~ready]
    return lengths.astype("<u4")


def expand(rules: np.ndarray, seq: np.ndarray, base: int) -> np.ndarray:
    """The ids of a sequence, level by level."""
    seq = seq.astype(np.int64)
    while len(at := np.flatnonzero(seq >= base)):
        wide = np.ones(len(seq), np.int64)
        wide[at] = 2
        out = np.repeat(seq, wide)
        begin = np.cumsum(wide)[at] - 2
        pair = rules[seq[at] - base]
        out[begin], out[begin + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq.astype("<u4")


def decode_range(rules: np.ndarray, lengths: np.ndarray, seq: np.ndarray, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a shard; only the symbols that cover them are expanded."""
    base, body = int(seq[0]), seq[1:].astype(np.int64)
    size = np.where(body < base, 1, lengths[np.maximum(body - base, 0)] if len(lengths) else 1).astype(np.int64)
    ends = np.cumsum(size)
    count = max(0, min(count, int(ends[-1]) - start)) if len(ends) else 0
    if not count:
        return np.empty(0, "<u4")
    lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + count, "left"))
    ids = expand(rules, body[lo : hi + 1], base)
    skip = start - int(ends[lo] - size[lo])
    return ids[skip : skip + count]


_encoders: dict[int, WordEncoder] = {}


def _shard(part: int, shard: int, ids: np.ndarray, names: pa.Array, lens: np.ndarray) -> pa.RecordBatch:
    rules, spans, seq = compress(ids)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([names], ["id"]))
    blobs = [sink.getvalue().to_pybytes(), lens.astype("<u4").tobytes(), rules.tobytes(), spans.tobytes(), seq.tobytes()]
    columns = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs), pa.array([len(ids)], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["part", "shard", "docs", "lens", "rules", "spans", "seq", "n_ids"])


def write_shards(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Writes all documents in ascending id order; ``path`` names the vocabulary file on the driver."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    spec, key = docs.sparkSession.sparkContext.broadcast(raw), zlib.crc32(raw.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = WordEncoder(spec.value)
        e = _encoders[key]
        shard, size = 0, 0
        held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids, names, lens = zip(*held, strict=True)
            return _shard(part, shard, np.concatenate(ids), pa.concat_arrays(names), np.concatenate(lens))

        for b in batches:
            first = 0
            for texts in slices(b.column(1), _SLICE):
                names = b.column(0).slice(first, len(texts))
                first += len(texts)
                ids, lens = e.encode(texts)
                ids, lens = np.insert(ids, np.cumsum(lens), end_id), lens + 1
                total = np.r_[0, np.cumsum(lens)]
                at = 0
                while at < len(lens):  # a shard ends with the document that fills it
                    to = min(int(np.searchsorted(total, total[at] + shard_ids - size)), len(lens))
                    held.append((ids[total[at] : total[to]], names.slice(at, to - at), lens[at:to]))
                    size, at = size + int(total[to] - total[at]), to
                    if size >= shard_ids:
                        yield flush()
                        shard, size, held = shard + 1, 0, []
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    order = [F.col("i").asc_nulls_first(), text_hash(F.col("t"))]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _SCHEMA).write.parquet(out)


def read_shards(spark: SparkSession, out: str, id_col: str = "doc_id", packed: bool = False) -> DataFrame:
    """``(id, start, ids array<int>)`` of every document, decoded from the folder; ``packed`` gives ids as little-endian bytes."""
    shards = spark.read.schema(_SCHEMA).parquet(out)
    # one sum for each writing task, of which the driver has kept more than that already
    sums = sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect())
    before = np.cumsum([0, *(n for _, n in sums)]).tolist()
    parts = spark.createDataFrame([(p, n) for (p, _), n in zip(sums, before, strict=False)], "part int, zero long")
    earlier = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("part", "shard", "n_ids").select("part", "shard", earlier.alias("earlier")).join(F.broadcast(parts), "part").select("part", "shard", (F.col("zero") + F.col("earlier")).cast("long").alias("start"))
    rows = shards.join(small(stash(starts, "starts")), ["part", "shard"]).select("docs", "lens", "rules", "seq", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, lens, rules, seq, start in zip(*(c for c in b.columns), strict=True):
                with pa.ipc.open_stream(docs.as_buffer()) as r:
                    names = r.read_all().column("id").combine_chunks()
                n = np.frombuffer(lens.as_buffer(), "<u4").astype(np.int64)
                s = np.frombuffer(seq.as_buffer(), "<u4")
                ids = expand(np.frombuffer(rules.as_buffer(), "<u4").reshape(-1, 2), s[1:], int(s[0])).view("<i4")
                ends = np.r_[0, np.cumsum(n)]
                begin = ends[:-1] + start.as_py()
                for lo in range(0, len(n), 1024):
                    hi = min(lo + 1024, len(n))
                    cuts, part = (ends[lo : hi + 1] - ends[lo]).astype(np.int32), ids[ends[lo] : ends[hi]]
                    values = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cuts * np.int32(4)), pa.py_buffer(part)]) if packed else pa.ListArray.from_arrays(pa.array(cuts), pa.array(part))
                    yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo), pa.array(begin[lo:hi]), values], [id_col, "start", "ids"])

    return rows.mapInArrow(run, f"`{id_col}` long, start long, ids {'binary' if packed else 'array<int>'}")


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", packed: bool = False) -> DataFrame:
    """All documents through the files and back."""
    out = new_path(docs.sparkSession, "shards")
    write_shards(docs, path, out, id_col, text)
    return read_shards(docs.sparkSession, out, id_col, packed)
