"""Byte-pair merges of many words at once.

Each row of a matrix is a word's symbols.  A step merges in every row the pair
of least rank, the leftmost first, until no row has a pair that merges; that is
the order in which a single word's merges go.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NONE = np.int32((1 << 31) - 1)
_KEYS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def placed(slots_of: Callable[[int], list[np.ndarray]], n: int) -> tuple[int, list[np.ndarray]]:
    """Places for ``n`` keys in two tables, so that each is found by two looks: the tables' bits and their key numbers, -1 where none.

    ``slots_of(bits)`` gives every key's slot in either table.  A key that finds its slot taken moves its holder to the holder's other one.
    """
    bits = max(4, int(2 * n).bit_length() - 1)
    while True:
        slots = [x.tolist() for x in slots_of(bits)]
        held = [[-1] * (1 << bits), [-1] * (1 << bits)]
        if all(_settle(k, slots, held) for k in range(n)):
            return bits, [np.array(h, np.int32) for h in held]
        bits += 1


def _settle(k: int, slots: list[list[int]], held: list[list[int]]) -> bool:
    side = 0
    for _ in range(500):
        at = slots[side][k]
        k, held[side][at] = held[side][at], k
        if k < 0:
            return True
        side = 1 - side
    return False


class Merges:
    """``left[r], right[r]`` merge to ``new[r]``; r is the rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, new: np.ndarray):
        self.new = new.astype(np.int32)
        pairs = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits, tables = placed(lambda bits: [self._slot(pairs, k, bits) for k in (0, 1)], len(pairs))
        self.ranks = [np.where(t >= 0, t, NONE) for t in tables]
        self.pairs = [np.where(t >= 0, pairs[t], np.uint64(0)) if len(pairs) else np.zeros(len(t), np.uint64) for t in tables]

    def _slot(self, pairs: np.ndarray, side: int, bits: int) -> np.ndarray:
        h = (pairs ^ (pairs >> np.uint64(29))) * _KEYS[side]
        return ((h ^ (h >> np.uint64(31))) * _KEYS[1 - side] >> np.uint64(64 - bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they don't merge; a negative symbol merges with nothing."""
        pairs = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = self._slot(pairs, 0, self.bits)
        out = np.where(self.pairs[0][at] == pairs, self.ranks[0][at], NONE)
        rest = np.nonzero(out == NONE)
        pairs = pairs[rest]
        at = self._slot(pairs, 1, self.bits)
        out[rest] = np.where(self.pairs[1][at] == pairs, self.ranks[1][at], NONE)
        return out

    def run(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of all rows, one behind the other, and each row's number; rows are filled up with -1."""
        out = np.full(rows.shape, -1, np.int32)
        live, s = np.arange(len(rows)), rows.astype(np.int32)
        r = self.rank(s[:, :-1], s[:, 1:])
        while len(live):
            if not r.shape[1]:
                out[live, : s.shape[1]] = s
                break
            k = r.argmin(axis=1)
            best = r[np.arange(len(live)), k]
            on = best < NONE
            out[live[~on], : s.shape[1]] = s[~on]
            live, s, r, k, best = live[on], s[on], r[on], k[on], best[on]
            row, wide = np.arange(len(live)), s.shape[1] - 1
            s[row, k] = self.new[best]
            column, at = np.arange(wide), k[:, None]
            s = np.where(column > at, s[:, 1:], s[:, :-1])
            r = np.where(column[:-1] >= at, r[:, 1:], r[:, :-1])
            left = np.flatnonzero(k > 0)
            r[left, k[left] - 1] = self.rank(s[left, k[left] - 1], s[left, k[left]])
            right = np.flatnonzero(k < wide - 1)
            r[right, k[right]] = self.rank(s[right, k[right]], s[right, k[right] + 1])
        kept = out >= 0
        return out[kept], kept.sum(axis=1)
