"""SimHash near-duplicates by pigeonhole blocks.

Every text gets a 64-bit fingerprint.  Two fingerprints of at most ``MAX_BITS``
differing bits share at least ``BLOCKS - MAX_BITS`` of ``BLOCKS`` blocks, so
each choice of that many blocks is a join key; pairs that meet are verified by
their Hamming distance.  Copies collapse to one fingerprint before any join.

A bucket of more than ``BUCKET`` fingerprints isn't paired: its members emit
every fingerprint within one bit of themselves, and two members are within two
bits exactly if they share one of those.  At most 65 different fingerprints can
share one, so that way is linear, exact and free of hot keys.

Null, empty or blank text: fingerprint 0, linked like any other.  Repeated rows
and equal texts share a fingerprint and a component.  A null ``doc_id`` counts
in no minimum; a component of nulls only has a null id.  Other columns are not
read, so names that clash with the results do no harm.  Empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._base import col, connected_components, only, stash, text_hash

SHINGLE, SEED, MAX_BITS, BLOCKS, BUCKET = 3, 42, 2, 5, 48
_CASE = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: _LANES[byte]: eight counters of eight bits, one for each bit of the byte.
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of the lower-cased text, repeats included."""
    words = text.translate(_CASE).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist()
    flat = b" ".join(words)
    return np.fromiter(map(xxh64_intdigest, map(flat.__getitem__, map(slice, starts, stops)), repeat(SEED)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in more than half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    lanes = hashes.astype("<u8", copy=False).view(np.uint8).reshape(n, 8)
    counts = np.zeros((8, 8), np.int64)
    blocks = np.arange(0, n, 255)  # a counter of eight bits holds 255
    for k in range(8):
        counts[k] = np.add.reduceat(_LANES[lanes[:, k]], blocks).astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits((2 * counts > n).ravel(), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(b.num_columns - 1).cast(pa.binary())
        prints = np.fromiter((fingerprint(shingle_hashes(t.as_py() or b"")) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints.view(np.int64))], [*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """``(id, [th], fp)`` of every row; ``fp`` holds the 64 bits in a long."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(col(id_col).alias("id"), *([text_hash(col(text_col)).alias("th")] if with_hash else []), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, f"id {kind}, {'th long, ' if with_hash else ''}fp long")


def _block_keys(fp: Column, max_bits: int, blocks: int) -> Column:
    """One key for each choice of ``blocks - max_bits`` blocks: the choice's number and its bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).cast("byte").alias("c"), fp.bitwiseAND(F.lit(signed)).alias("v")))
    return F.array(*keys)


def links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(src, dst)`` that connect all fingerprints ``fp`` within ``max_bits`` bits; ``prints`` is distinct."""
    keyed = prints.select("fp", F.explode(_block_keys(F.col("fp"), max_bits, blocks)).alias("k")).select("fp", "k.c", "k.v")
    hot = stash(keyed.groupBy("c", "v").count().where(F.col("count") > bucket).select("c", "v"), "hot")
    crowded = not hot.isEmpty()
    cold = keyed.join(hot, ["c", "v"], "left_anti") if crowded else keyed
    met = cold.groupBy("c", "v").agg(F.collect_list("fp").alias("a")).where(F.size("a") > 1)
    close = met.select("a", F.explode("a").alias("src")).select("src", F.explode(F.filter("a", lambda y: (y > F.col("src")) & (F.bit_count(y.bitwiseXOR(F.col("src"))) <= max_bits))).alias("dst"))
    if not crowded:
        return close
    if max_bits != 2:
        raise ValueError("the way for crowded buckets is exact for two bits")
    members = keyed.join(hot, ["c", "v"], "left_semi").select("fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b)) for b in range(64)))
    near = members.select("fp", F.explode(flips).alias("v")).groupBy("v").agg(F.collect_list("fp").alias("a")).where(F.size("a") > 1)
    star = near.select(F.array_min("a").alias("src"), F.explode("a").alias("dst")).where("src <> dst")
    return close.unionByName(star)


def components(rows: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """``(fp, component_id)`` for every fingerprint of ``rows(id, fp)``: the least id reachable."""
    least = stash(rows.groupBy("fp").agg(F.min("id").alias("m")), "least")
    roots = connected_components(links(least.select("fp"), max_bits, blocks, bucket))
    linked = stash(least.join(roots.withColumnRenamed("node", "fp"), "fp"), "linked")
    tops = linked.groupBy("root").agg(F.min("m").alias("component_id"))
    named = stash(linked.join(stash(tops, "tops"), "root").select("fp", "component_id"), "named")
    return stash(least.join(named.withColumn("l", F.lit(True)), "fp", "left").select("fp", F.when(F.col("l"), F.col("component_id")).otherwise(F.col("m")).alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """One row for every row of ``docs``: its id, ``fp`` and ``component_id``."""
    rows = stash(fingerprints(docs, id_col, text_col), "prints")
    return rows.join(components(rows, max_bits, blocks, bucket), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component stays: least id (nulls last), then least text hash; all columns of ``docs``."""
    rows = stash(fingerprints(docs, id_col, text_col, with_hash=True), "prints")
    classes = components(rows.withColumn("id", F.struct(F.col("id").isNull().alias("n"), "id", "th")), max_bits)
    stay = classes.select(F.col("fp").alias("sig"), F.col("component_id").alias("stay"))
    return only(docs, rows.select("id", "th", F.col("fp").alias("sig")), stay, id_col, text_col)
