"""SHA-256 of every key with every tail in array arithmetic.

A key of whole blocks is compressed once; of its message with a tail of eight
bytes only the last block is left, whose words follow from the tail alone, so
they are shared by all keys.  Each of the 64 rounds is then 34 array operations
over a block of digests.  hashlib takes about twice as long, most of it
for setting up a digest.
"""

from __future__ import annotations

import numpy as np

#: Digests in one array: large enough for a call's own cost, small enough for twelve arrays in a core's cache.
BLOCK = 1 << 15
#: Tails in one array: their 64 words are in the cache, too.
TAILS = 1 << 12
TAIL = 8


def _roots() -> tuple[np.ndarray, np.ndarray]:
    """The first 32 bits of the fractions of the cube roots of the first 64 primes, and of the square roots of the first eight."""
    primes = [p for p in range(2, 312) if all(p % q for q in range(2, p))]

    def root(v: int, n: int) -> int:
        low, high = 0, v
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if mid**n <= v else (low, mid - 1)
        return low & 0xFFFFFFFF

    return np.array([root(p << 96, 3) for p in primes], np.uint32), np.array([root(p << 64, 2) for p in primes[:8]], np.uint32)


_K, _START = _roots()
_SHIFTS = {n: np.array(n, np.uint32) for n in (2, 5, 6, 7, 9, 10, 11, 14)}


def _schedule(words: list[np.ndarray]) -> list[np.ndarray]:
    """A block's 64 words from its first 16, each with its round's constant."""
    w = list(words)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + w[t - 7] + ((x >> 7 | x << 25) ^ (x >> 18 | x << 14) ^ x >> 3) + ((y >> 17 | y << 15) ^ (y >> 19 | y << 13) ^ y >> 10))
    return [x + k for x, k in zip(w, _K, strict=True)]


def _turned(v: np.ndarray, right: tuple[int, int, int], left: tuple[int, int, int], out: np.ndarray, spare: np.ndarray) -> None:
    """The exclusive or of three rotations of ``v``, their right and left parts nested."""
    for shift, steps, to in ((np.right_shift, right, out), (np.left_shift, left, spare)):
        shift(v, _SHIFTS[steps[0]], to)
        for n in steps[1:]:
            np.bitwise_xor(to, v, to)
            shift(to, _SHIFTS[n], to)
    np.bitwise_xor(out, spare, out)


def _rounds(state: np.ndarray, words: list[np.ndarray], room: list[np.ndarray]) -> list[np.ndarray]:
    """The eight words after the 64 rounds, without the state that is still to be added; they are arrays of ``room``."""
    a, b, c, d, e, f, g, h, x, y, t, u = room
    for v, s in zip(room, state, strict=False):
        v[...] = s
    np.bitwise_xor(b, c, y)
    for k in words:
        _turned(e, (14, 5, 6), (5, 14, 7), t, u)  # rotations by 6, 11, 25
        np.add(h, t, h)
        np.bitwise_xor(f, g, u)
        np.bitwise_and(u, e, u)
        np.bitwise_xor(u, g, u)
        np.add(h, u, h)
        np.add(h, k, h)
        np.add(d, h, d)
        _turned(a, (9, 11, 2), (11, 9, 10), t, u)  # by 2, 13, 22
        np.add(h, t, h)
        np.bitwise_xor(a, b, x)
        np.bitwise_and(y, x, y)
        np.bitwise_xor(y, b, y)
        np.add(h, y, h)
        x, y = y, x
        a, b, c, d, e, f, g, h = h, a, b, c, d, e, f, g
    return [a, b, c, d, e, f, g, h]


def states(keys: list[bytes]) -> np.ndarray:
    """The hash states ``(8, keys)`` after keys of one length, a multiple of 64 bytes."""
    words = np.frombuffer(b"".join(keys), ">u4").astype(np.uint32).reshape(len(keys), -1, 16)
    state = np.repeat(_START[:, None], len(keys), 1)
    for k in range(words.shape[1]):
        state = state + np.array(_rounds(state, _schedule(list(words[:, k].T)), list(np.empty((12, len(keys)), np.uint32))))
    return state


def last_block(tails: bytes, key_bytes: int) -> list[np.ndarray]:
    """The words of the last blocks of keys of ``key_bytes`` with tails of eight bytes each."""
    first, second = np.frombuffer(tails, ">u4").astype(np.uint32).reshape(-1, 2).T
    bits = 8 * (key_bytes + TAIL)
    rest = [0x80000000, *[0] * 11, bits >> 32, bits & 0xFFFFFFFF]
    return _schedule([first.copy(), second.copy(), *(np.array([v], np.uint32) for v in rest)])


def room() -> np.ndarray:
    """Memory for the rounds of a block: twelve arrays that begin at cache lines, at other ones each."""
    row = 4 * BLOCK + 17 * 64
    raw = np.empty(12 * row + 64, np.uint8)
    at = -raw.ctypes.data % 64
    return raw[at : at + 12 * row].view(np.uint32).reshape(12, -1)


def first_words(state: np.ndarray, last: list[np.ndarray], space: np.ndarray) -> np.ndarray:
    """``(keys, tails)``: the first four bytes of each digest as a little endian number; the array is of ``space``."""
    shape = state.shape[1], len(last[0])
    arrays = [x[: shape[0] * shape[1]].reshape(shape) for x in space]
    out = _rounds(state[:, :, None], last, arrays)[0]
    return np.add(out, state[0][:, None], out).byteswap(inplace=True)
