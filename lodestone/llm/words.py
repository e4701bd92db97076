"""Words of whole batches of texts, and an exact memory of what each word stands for.

Texts lie one behind the other in one byte array, as Arrow holds them.  A word
is a run of bytes that are no ASCII white space; it never crosses from one text
into the next.  A word may be cut further, where letters and marks meet.  Words of up to ``SHORT`` bytes are known by their first and last
eight bytes and their length, which is all of them, so a memory of such keys
never confuses two words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

SHORT = 16
#: Kinds of bytes: 0 white space, 1 letters, 2 marks, 3 the apostrophe, 4 others.
_KIND = np.full(256, 4, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[33:127] = 2
_KIND[[c for c in range(128) if chr(c).isalpha()]] = 1
_KIND[48:58] = 4
_KIND[39] = 3
_MEET = np.zeros(256, bool)
_MEET[[1 << 4 | 2, 1 << 4 | 3, 2 << 4 | 1]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1] * (SHORT - 7), np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column with ``SHORT`` zeros behind them, and each text's end, from 0; null counts as empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    out = np.zeros(ends[-1] - ends[0] + SHORT, np.uint8)
    if len(out) > SHORT:
        out[:-SHORT] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return out, ends - ends[0]


def slices(column: pa.Array, size: int) -> list[pa.Array]:
    """Parts of a string column of about ``size`` bytes, of one text at least."""
    ends = flat_ends(column)
    cuts = [0]
    while cuts[-1] < len(column):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + size, "right")) - 1))
    return [column.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def flat_ends(column: pa.Array) -> np.ndarray:
    """Where each text of a column ends in its bytes, after a leading zero."""
    import pyarrow.compute as pc

    return np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]


def cut(data: np.ndarray, ends: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; with ``marks``, a word ends where an ASCII letter and an ASCII mark meet.

    An apostrophe stays with the letters behind it.
    """
    n = len(data) - SHORT
    kind = _KIND[data[:n]]
    word = kind != 0
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    if marks:
        two = kind[:-1] << 4 | kind[1:]
        edge[1:-1] |= _MEET[two]
    opens, closes = edge[:-1], edge[1:].copy()
    opens[1:] |= ~word[:-1]
    opens &= word
    closes[:-1] |= ~word[1:]
    closes &= word
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def lowered(data: np.ndarray) -> None:
    """Makes Latin capitals small where an ASCII byte follows; the last bytes of ``data`` are zeros."""
    ascii_next = data[1:] < 128
    big = (data[:-1] >= 65) & (data[:-1] <= 90) & ascii_next
    data[:-1][big] += 32
    wide = (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] <= 0x9E) & (data[1:-1] != 0x97) & ascii_next[1:]
    data[1:-1][wide] += 32


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, last bytes and length of words of up to SHORT bytes."""
    n = ends - starts
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    return eight[starts] & _MASK[n], np.where(n > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0)), n.astype(np.uint64)


def _mixed(first: np.ndarray, last: np.ndarray, length: np.ndarray) -> np.ndarray:
    h = (first ^ (first >> np.uint64(29))) * _K1 + (last ^ length) * _K2
    return (h ^ (h >> np.uint64(32))) * _K1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    long = np.flatnonzero(ends - starts > SHORT)
    out = _mixed(*_numbers(data, starts, np.minimum(ends, starts + SHORT)))
    out[long] = np.fromiter((xxh64_intdigest(data[a:b].tobytes()) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    return out


class Memory:
    """Remembers the ids of words; ``make(data, starts, ends)`` gives those of words that aren't known.

    It returns the ids, one word's behind the other's, and their number for each word.
    Two places for each hash hold a key of three numbers and where its ids lie; a word that finds both taken
    replaces the first.  When ``most`` ids are held, all is forgotten but ``first``, ids that are held in front.
    """

    def __init__(self, make: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], bits: int = 21, most: int = 1 << 23, first: np.ndarray | None = None):
        self.make, self.bits, self.most = make, bits, most
        self.first = np.empty(0, np.uint32) if first is None else first
        self.clear()

    def clear(self) -> None:
        # first bytes, last bytes, length, place of the ids << 32 | their number
        self.table = np.zeros((1 << self.bits, 4), np.uint64)
        self.ids, self.used = np.concatenate([self.first, np.empty(1 << 20, np.uint32)]), len(self.first)

    def _keep(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Puts the ids of new words away; place << 32 | number of each."""
        ids, n = self.make(data, starts, ends)
        end = self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used : end] = ids
        at = self.used + np.cumsum(n) - n
        self.used = end
        return at.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)

    def look(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, where its ids lie in ``self.ids`` and how many; good until the next call."""
        if self.used - len(self.first) > self.most:
            self.clear()
        size = ends - starts
        small = np.flatnonzero(size <= SHORT)
        whole = len(small) == len(size)
        s, e = (starts, ends) if whole else (starts[small], ends[small])
        first, last, length = _numbers(data, s, e)
        h = _mixed(first, last, length)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        row = self.table.take(slot, axis=0)
        found = row[:, 3].copy()
        miss = np.flatnonzero((row[:, 0] != first) | (row[:, 1] != last) | (row[:, 2] != length))
        if len(miss):
            row = self.table.take(slot[miss] ^ 1, axis=0)
            there = (row[:, 0] == first[miss]) & (row[:, 1] == last[miss]) & (row[:, 2] == length[miss])
            found[miss[there]] = row[there, 3]
            miss = miss[~there]
        if len(miss):
            miss = miss[np.argsort(h[miss], kind="stable")]
            a, b, c = first[miss], last[miss], length[miss]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]
            one = miss[new]
            at = self._keep(data, s[one], e[one])
            found[miss] = at[np.cumsum(new) - 1]
            put = slot[one]
            put = np.where(self.table[put, 2] == 0, put, np.where(self.table[put ^ 1, 2] == 0, put ^ 1, put))
            self.table[put] = np.stack([first[one], last[one], length[one], at], axis=1)
        if not whole:
            out = np.zeros(len(size), np.uint64)
            out[small] = found
            long = np.flatnonzero(size > SHORT)
            out[long] = self._keep(data, starts[long], ends[long])
            found = out
        return (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.int64)


def in_order(parts: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray) -> np.ndarray:
    """Ids of words that were made in parts: each has its words' numbers and their ids, one behind the other."""
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint32)
    for at, ids in parts:
        n = counts[at]
        out[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return out


def gather(ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``ids[at[k] : at[k] + n[k]]`` for every k, one behind the other."""
    total = np.cumsum(n)
    return ids[np.repeat(at - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
