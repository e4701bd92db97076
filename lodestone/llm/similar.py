"""Near copies by pigeonhole blocks of shingle sets.

A text is the set of its five-word shingles; two texts are near copies if their
sets have a Jaccard similarity of ``SHARE`` (4/5) or more, so they differ in at
most a ninth of the sum of their sizes.  Each set is cut into more blocks than
so many differences can spoil, and every block is a join key: similar sets have
one alike, so no pair is missed, and every link is verified by counting the
shingles that both have.  The number of blocks grows with the sets, in bands of
sizes, where a fixed number of bits would be too narrow to tell texts apart
(short near copies differ by up to 17 of 64 bits).

Equal sets collapse first.  Whatever holds a block meets the least of its
holders first; each set is verified against the one that it shares most with.
Only blocks whose holders are not connected by that are looked at again: there
the sets' fingerprints are compared, which hold a parity bit for the shingles of
each hash and so differ in at most as many bits as the sets do in shingles.
Each set is verified against the nearest fingerprint outside its group, until
that links few more; then all pairs of unconnected sets whose fingerprints are
near enough are.  So the pairs that are looked at as rows are in proportion to
the sets, and a group of near copies is compared in memory only; a block of more
than ``BUCKET`` holders is dealt into parts that meet two by two.

Null, empty or blank text: the empty set, equal to itself only.  Texts of fewer
than five words are one shingle.  Very long texts are sets like others, held
one batch of texts at a time.  Null ids, repeated rows, ties and clashing names
go as in ``simhash.keep_one``; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._base import col, connected_components, only, small, stash, text_hash
from .words import SHORT, cut, flat, slices, word_hashes

WIDTH, SHARE, BUCKET, SALTS = 5, (4, 5), 4096, 16
#: Words of fingerprints that are compared at once.
_WORDS = 1 << 20
_SLICE = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The different shingles' hashes of each text, in order."""
    for part in slices(texts, _SLICE):
        data, ends = flat(part)
        data[:-SHORT] = _LOWER[data[:-SHORT]]
        opens, closes = cut(data, ends)
        hashes = word_hashes(data, opens, closes)
        first = np.searchsorted(opens, ends)
        n = np.diff(first)
        count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
        stop = np.cumsum(count)
        at = np.repeat(first[:-1] - (stop - count), count) + np.arange(stop[-1])
        left = np.minimum(np.repeat(first[1:], count) - at, width)
        out = left.astype(np.uint64)
        for k in range(width):
            step = (out ^ hashes[np.minimum(at + k, max(len(hashes) - 1, 0))]) * _MIX
            out = np.where(k < left, step ^ (step >> np.uint64(29)), out)
        for a, b in zip((stop - count).tolist(), stop.tolist(), strict=True):
            yield np.unique(out[a:b])


def _sig(s: np.ndarray) -> int:
    return xxh64_intdigest(s.tobytes())


def fingerprint(s: np.ndarray) -> bytes:
    """A parity bit for the shingles of each hash, three bits or more for a shingle.

    Sets' fingerprints differ in at most as many bits as the sets do in shingles, also if the longer is folded.
    """
    bits = 1 << max(6, (3 * len(s)).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(prints: list[bytes]) -> np.ndarray:
    """Fingerprints as rows of equal length, the longer ones folded to the shortest."""
    least = min(map(len, prints)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least), axis=0) for x in prints])


def _bands(top: int = 1 << 31) -> tuple[np.ndarray, np.ndarray]:
    """Bands of set sizes: their first sizes, and the blocks of each.

    A band's blocks serve the pairs whose smaller set it holds.  Such sets differ in at most a ninth of the sum of
    their sizes, which leaves one block alike at least; a few blocks more make up for those that stay empty.
    """
    edges, blocks = [1], []
    while edges[-1] < top:
        edges.append(max(edges[-1] + 1, edges[-1] * 8 // 5))
        last = edges[-1] - 1
        spoilt = _differing(last, last * SHARE[1] // SHARE[0])
        blocks.append(spoilt + 3 + spoilt // 12 if spoilt else 0)
    return np.array(edges, np.int64), np.array(blocks, np.int64)


def _differing(a, b):
    """In how many shingles similar sets of ``a`` and ``b`` differ at most."""
    return (a + b) * (SHARE[1] - SHARE[0]) // sum(SHARE)


EDGES, BLOCKS = _bands()


def block_keys(s: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The keys of a set's blocks and the number of those that aren't empty, for its own band and for the one below if a similar set can be there.

    Shingles fall into blocks by their hash, a key tells a block's number and all that is in it.  Similar sets have
    more blocks alike than their differences spoil.  An empty block is no key, unless a set has so many of them that
    they may be all that it shares.
    """
    n = len(s)
    band = int(np.searchsorted(EDGES, n, "right")) - 1
    mixed = (s ^ (s >> np.uint64(31))) * _MIX
    for at in (band, band - 1):
        if at < 0 or not (count := int(BLOCKS[at])) or at < band and n * SHARE[0] > (int(EDGES[band]) - 1) * SHARE[1]:
            continue
        number = ((s >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        opens = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        held, sums = number[opens], np.add.reduceat(mixed, opens)
        if count - len(held) >= count - _differing(n, n * SHARE[1] // SHARE[0]):
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), held, assume_unique=True)
            numbers, sums = np.concatenate([held, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        else:
            numbers = held
        keys = (sums ^ ((numbers + np.uint64(1)) * _MIX + np.uint64(count))) * _MIX
        yield keys ^ (keys >> np.uint64(32)), len(held)


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, kind), *arrays])))


def signatures(texts: DataFrame, width: int) -> DataFrame:
    """``texts(id, th, text)`` as ``(id, th, sig, fp)``; fp is the fingerprint, given where a task meets a set first."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sigs, prints = [], []
            for s in shingle_sets(b.column(2), width):
                sigs.append(sig := _sig(s))
                prints.append(None if sig in seen else fingerprint(s))
                seen.add(sig)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _long(sigs), pa.array(prints, pa.binary())], ["id", "th", "sig", "fp"])

    return texts.mapInArrow(run, f"id {kind}, th long, sig long, fp binary")


def blocks(texts: DataFrame, width: int) -> DataFrame:
    """``(h, sig, n)`` for every block of a set, once for each set and task; ``n`` is its size and, in the lower half, its blocks that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            held: list[np.ndarray] = [np.empty(0, np.uint64)]
            sigs, sizes = [0], [0]
            for s in shingle_sets(b.column(0), width):
                sig = _sig(s)
                if not len(s) or sig in seen:
                    continue
                seen.add(sig)
                for keys, full in block_keys(s):
                    held.append(keys)
                    sigs.append(sig)
                    sizes.append(len(s) << 32 | full)
            n = np.array([len(x) for x in held], np.int64)
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(held)), _long(np.repeat(np.array(sigs, np.uint64), n)), pa.array(np.repeat(np.array(sizes, np.int64), n))], ["h", "sig", "n"])

    return texts.select("text").mapInArrow(run, "h long, sig long, n long")


def _sizes_fit(a: Column, b: Column) -> Column:
    a, b = F.shiftright(a, 32), F.shiftright(b, 32)
    return F.least(a, b) * SHARE[1] >= F.greatest(a, b) * SHARE[0]


def _enough(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets with so many blocks alike can be similar: each shingle that only one has spoils one block at most."""
    low = F.lit((1 << 32) - 1)
    full = F.greatest(a.bitwiseAND(low), b.bitwiseAND(low))
    return (full - shared) * sum(SHARE) <= (F.shiftright(a, 32) + F.shiftright(b, 32)) * (SHARE[1] - SHARE[0])


def verified(pairs: DataFrame, texts: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """The pairs ``(src, dst)`` of similar sets; ``named(sig, th)`` tells a text of each set.

    The sets of a pair's two sides meet at the source, which SALTS places share; there its set comes first.
    """
    salt = F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")
    roles = pairs.select("src", salt.alias("salt"), F.col("dst").alias("sig"), F.lit(1).alias("role")).unionByName(pairs.select("src", salt.alias("salt"), F.col("src").alias("sig"), F.lit(0).alias("role")).distinct())
    roles = stash(roles.join(named, "sig").select("src", "salt", "sig", "role", "th"), "roles")
    wanted = stash(roles.select("th").distinct(), "wanted")
    found = texts.select("th", "text").join(small(wanted), "th", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            ths, out = [], []
            for th, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), width), strict=True):
                if th not in seen:
                    seen.add(th)
                    ths.append(th)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ths, pa.int64()), pa.array(out, pa.binary())], ["th", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, own = None, np.empty(0, np.uint64)
        for b in batches:
            out = []
            for at, sig, role, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                other = np.frombuffer(s, np.uint64)
                if role == 0:
                    src, own = at, other
                elif at == src:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if both * sum(SHARE) >= (len(own) + len(other)) * SHARE[0]:
                        out.append((at, sig))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["src", "dst"])

    placed = found.mapInArrow(sets, "th long, s binary").join(small(roles), "th").select("src", "salt", "sig", "role", "s")
    met = placed.repartition("src", "salt").sortWithinPartitions("src", "salt", "role").select("src", "sig", "role", "s")
    return stash(met.mapInArrow(compare, "src long, dst long").distinct(), "similar")


def _across(sigs: np.ndarray, sizes: np.ndarray, roots: np.ndarray, prints: list[bytes], every: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs ``(src, dst, bits)`` of one block's holders in different groups whose fingerprints are near enough: all, or each set's nearest.

    The largest group only answers.
    """
    groups, at, counts = np.unique(roots, return_inverse=True, return_counts=True)
    asks = np.flatnonzero(at != counts.argmax())
    rows = _folded(prints)
    step = max(1, _WORDS // rows.size)
    for k in range(0, len(asks), step):
        i = asks[k : k + step]
        bits = np.bitwise_count(rows[i][:, None] ^ rows[None]).sum(axis=2, dtype=np.int64)
        a, b = sizes[i][:, None], sizes[None]
        bad = (bits > _differing(a, b)) | (at[i][:, None] == at[None]) | (np.minimum(a, b) * SHARE[1] < np.maximum(a, b) * SHARE[0])
        if every:
            x, y = np.nonzero(~bad)
        else:
            bits[bad] = np.iinfo(np.int64).max
            y = bits.argmin(axis=1)
            x = np.flatnonzero(~bad[np.arange(len(i)), y])
            y = y[x]
        if len(x):
            yield sigs[i[x]], sigs[y], bits[x, y]


def across(rows: DataFrame, every: bool) -> DataFrame:
    """``(src, dst, bits)`` of ``rows(h, sig, n, root, fp)``, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            sigs, sizes, roots = (table.column(c).to_numpy() for c in ("sig", "n", "root"))
            for found in _across(sigs, sizes, roots, table.column("fp").to_pylist(), every):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["src", "dst", "bits"])

        for b in batches:
            h = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                if held and h[at] != key:
                    yield from done()
                    held = []
                if to > at:
                    key = h[at]
                    held.append(b.slice(at, to - at))
        if held:
            yield from done()

    met = rows.select("h", "sig", "n", "root", "fp").repartition("h").sortWithinPartitions("h")
    return met.mapInArrow(run, "src long, dst long, bits long")


def dealt(rows: DataFrame, bucket: int) -> DataFrame:
    """``rows(h, ...)``, where more than ``bucket`` of one ``h`` are dealt into parts; any two parts meet under a key of their own."""
    crowded = stash(rows.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / bucket).alias("parts")).where("parts > 1"), "crowded")
    if crowded.isEmpty():
        return rows
    parts = rows.join(crowded, "h").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    key = F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("h")
    return rows.join(crowded, "h", "left_anti").unionByName(parts.select("*", other).select(key, *(c for c in rows.columns if c != "h")))


def links(keyed: DataFrame, verify, prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(src, dst)`` that connect what is similar; ``keyed(h, sig, n)`` may have rows twice, ``prints(sig, fp)`` has every set."""
    by = Window.partitionBy("h").orderBy("sig")
    held = keyed.withColumns({"hub": F.first(F.struct("sig", "n")).over(by.rowsBetween(Window.unboundedPreceding, 0)), "top": F.max("sig").over(Window.partitionBy("h")), "before": F.lag("sig").over(by)})
    held = held.where("hub.sig <> top and (before is null or before <> sig)")
    shared = stash(held.select("h", "sig", "n", F.col("hub.sig").alias("hub"), F.col("hub.n").alias("hn")), "shared")
    stars = stash(shared.where("sig <> hub").groupBy("hub", "sig", "hn", "n").agg(F.count(F.lit(1)).alias("c")), "stars")
    near = stars.where(_sizes_fit(F.col("hn"), F.col("n")) & _enough(F.col("c"), F.col("hn"), F.col("n")))
    best = near.groupBy(F.col("sig").alias("dst")).agg(F.max(F.struct("c", "hub"))["hub"].alias("src"))
    edges = verify(stash(best.select("src", "dst"), "pairs"))
    roots = small(stash(connected_components(edges), "roots"))
    apart = stars.select("hub", "sig").join(roots.select(F.col("node").alias("hub"), F.col("root").alias("a")), "hub", "left").join(roots.select(F.col("node").alias("sig"), F.col("root").alias("b")), "sig", "left")
    apart = stash(apart.where(F.coalesce("a", "hub") != F.coalesce("b", "sig")).select("hub", "sig").distinct(), "apart")
    open_ = stash(shared.join(small(apart), ["hub", "sig"], "left_semi").select("h").distinct(), "open")
    rows = shared.join(small(open_), "h", "left_semi").select("h", "sig", F.shiftright("n", 32).alias("n"))
    rows = stash(dealt(stash(rows.join(prints, "sig").select("h", "sig", "n", "fp"), "unconnected"), bucket), "dealt")
    done, every, linked = None, False, edges.count()
    while True:
        placed = rows.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("h", "sig", "n", F.coalesce("root", "sig").alias("root"), "fp")
        found = across(placed, every)
        if not every:  # of a set's places in several blocks the nearest counts
            found = found.groupBy("src").agg(F.min(F.struct("bits", "dst"))["dst"].alias("dst"))
        chosen = found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        chosen = stash(chosen if done is None else chosen.join(done, ["src", "dst"], "left_anti"), "pairs")
        done = chosen if done is None else done.unionByName(chosen)
        new = verify(chosen)
        if every:
            return edges.unionByName(new)
        last, linked = linked, new.count()
        every = linked * 10 <= last
        if linked:
            edges = edges.unionByName(new)
            roots = small(stash(connected_components(edges), "roots"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """One row of each group of near copies stays: least id (nulls last), then least text hash; all columns of ``docs``."""
    texts = docs.select(col(id_col).alias("id"), text_hash(col(text_col)).alias("th"), col(text_col).cast("string").alias("text"))
    rows = stash(signatures(texts, width), "signatures")
    key = F.struct(F.col("id").isNull().alias("n"), "id", "th")
    least = stash(rows.groupBy("sig").agg(F.min(key).alias("m"), F.max("fp").alias("fp")), "least")
    edges = links(blocks(texts, width), lambda pairs: verified(pairs, texts, least.select("sig", F.col("m.th").alias("th")), width), least.select("sig", "fp"), bucket)
    linked = least.join(connected_components(edges), F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("root", "sig").alias("root"), "m")
    linked = stash(linked, "linked")
    stay = linked.groupBy("root").agg(F.min("m").alias("stay"))
    return only(docs, rows.select("id", "th", "sig"), stash(linked.select("sig", "root").join(stay, "root").select("sig", "stay"), "stay"), id_col, text_col)
