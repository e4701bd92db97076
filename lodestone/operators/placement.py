"""Weighted rendezvous placement and the replication plans that follow from it.

The nodes are a small dimension: they are broadcast behind a check of their
number, and each different key is hashed with all of them once, in Arrow
batches, because a digest through native expressions costs ten of these.  Keys
of whole hash blocks, as digests in hex are, go through array arithmetic.
Beyond ``MAX_NODES`` the nodes are dealt into blocks of an array each and the
per-block winners are ranked per key in a second step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import digests
from ..functions.codecs import bind

MAX_NODES = 1 << 18
MODES = {"none": 0, "chain": 1, "splay": 2, "primary-splay": 3}
ACK_NS = 30 * 1_000_000_000


def little_endian(v: Column) -> Column:
    """Eight bytes of a long, least first."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(v), 16, "0"), F.lit("(..)"), F.lit(1))), ""))


def unit_fold(digest_hex: Column) -> Column:
    """A digest as a number in [0, 1): its first four and last four bytes, little endian, make 52 bits."""
    ends = F.conv(F.concat(F.substring(digest_hex, 1, 8), F.substring(digest_hex, 57, 8)), 16, -10).cast("bigint")
    # each byte: how far it moves to the right, what is kept of it, and where
    moves = ((36, 0xFF, 20), (20, 0xFF, 28), (4, 0xFF, 36), (-12, 0xFF, 44), (24, 0xFF, 0), (8, 0xFF, 8), (-8, 0xF, 16))

    def mantissa(v: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for shift, mask, to in moves:
            moved = F.shiftrightunsigned(v, shift) if shift > 0 else F.shiftleft(v, -shift)
            out = out.bitwiseOR(moved.bitwiseAND(F.lit(mask << to).cast("bigint")))
        return out

    return bind(ends, mantissa).cast("double") / F.lit(float(1 << 52))


def score(object_hash: Column, node_key: Column, weight: Column) -> Column:
    """``-w / ln(u)``; 0 where u isn't inside (0, 1)."""
    digest = F.sha2(F.concat(object_hash.cast("binary"), node_key), 256)
    return bind(bind(digest, unit_fold), lambda u: F.when((u > 0) & (u < 1), -weight / F.ln(u)).otherwise(F.lit(0.0)))


def spread(df: DataFrame, one_split: int = 128 << 20) -> DataFrame:
    """Rows of an input that is at most one split dealt over the cores; larger ones have splits enough."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > one_split:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _ranked(keys: DataFrame, key: str, members: str, rf: int) -> Column:
    rows = F.transform(members, lambda n: F.struct((-score(F.col(key), n["key"], n["weight"])).alias("s"), n["decl_order"].alias("o"), n["node_id"].alias("node_id")))
    return F.slice(F.sort_array(rows), 1, rf)


def _winners(key: bytes, ids: list, weights: np.ndarray, orders: list, tails: list[bytes], rf: int) -> list:
    """The ids of the first ``rf`` nodes for a key; the logarithm is taken again, singly, of those that may be among them."""
    d = np.frombuffer(b"".join([sha256(key + x).digest() for x in tails]), "<u4").reshape(-1, 8)
    u = (d[:, 0].astype(np.int64) << 20 | d[:, 7] & 0xFFFFF) / float(1 << 52)
    with np.errstate(divide="ignore"):
        s = -weights / np.log(u)
    near = range(len(s)) if len(s) <= rf else np.flatnonzero(~(s < np.partition(s, -rf)[-rf] * (1 - 1e-9))).tolist()
    exact = [(weights[k] / math.log(u[k]) if u[k] > 0 else 0.0, orders[k] is not None, orders[k] or 0, ids[k]) for k in near]
    return [x[-1] for x in sorted(exact)[:rf]]


def _ranked_by_blocks(keys: list[bytes], ids: list, weights: np.ndarray, orders: list, tails: list[bytes], rf: int) -> list[list]:
    """``_winners`` of keys of one length, a multiple of 64 bytes, and tails of eight.

    Of every digest the first word is computed in arrays.  It bounds the score, so whole digests and logarithms are taken,
    as in ``_winners``, only of nodes whose word is at least a key's floor: no other can be among its first ``rf``.
    """
    n, space, state = len(ids), digests.room(), digests.states(keys)
    heaviest, ratio = float(weights.max()), float(weights.max() / weights.min())
    width = -(-n // -(-n // digests.TAILS))
    at_once = digests.BLOCK // width
    best: list[list] = [[] for _ in keys]
    floors = np.zeros(len(keys), np.uint32)

    def floor(u: float) -> int:
        return max(0, int(u * (1 - 1e-9) * (1 << 32)) - 1)

    for lo in range(0, n, width):
        last = digests.last_block(b"".join(tails[lo : lo + width]), len(keys[0]))
        for at in range(0, len(keys), at_once):
            words = digests.first_words(state[:, at : at + at_once], last, space)
            if not lo and width > rf:  # rf nodes have this word or more, if the lightest of all then a score that the heaviest reach from its power on
                floors[at : at + at_once] = [floor((int(x) / (1 << 32)) ** ratio) for x in np.partition(words, -rf)[:, -rf]]
            rows, columns = np.nonzero(words >= floors[at : at + at_once, None])
            for i, k in zip((rows + at).tolist(), (columns + lo).tolist(), strict=True):
                d = sha256(keys[i] + tails[k]).digest()
                u = (int.from_bytes(d[:4], "little") << 20 | int.from_bytes(d[28:], "little") & 0xFFFFF) / float(1 << 52)
                best[i].append((weights[k] / math.log(u) if u > 0 else 0.0, orders[k] is not None, orders[k] or 0, ids[k]))
        for i, found in enumerate(best):
            found.sort()
            del found[rf:]
            floors[i] = floor(math.exp(heaviest / found[-1][0])) if len(found) == rf and found[-1][0] < 0 else 0
    return [[x[-1] for x in found] for found in best]


def _all_winners(keys: list[bytes], ids: list, weights: np.ndarray, orders: list, tails: list[bytes], rf: int) -> list[list]:
    """``_winners`` of each key, those of keys of whole blocks together."""
    alike: dict[int, list[int]] = {}
    if all(len(t) == digests.TAIL for t in tails) and np.isfinite(weights).all():
        for i, key in enumerate(keys):
            if len(key) % 64 == 0:
                alike.setdefault(len(key), []).append(i)
    out: list = [None] * len(keys)
    for at in alike.values():
        if len(at) * len(ids) >= digests.BLOCK // 2:  # fewer aren't worth the calls
            for i, found in zip(at, _ranked_by_blocks([keys[i] for i in at], ids, weights, orders, tails, rf), strict=True):
                out[i] = found
    return [_winners(k, ids, weights, orders, tails, rf) if x is None else x for k, x in zip(keys, out, strict=True)]


def _placements(keys: DataFrame, key: str, able: DataFrame, rf: int) -> DataFrame:
    """``(__k, placement)`` of the different ``keys``."""
    spark, kind = keys.sparkSession, able.schema["node_id"].dataType
    rows = able.select("node_id", F.col("weight").cast("double"), "decl_order", "key").collect()
    held = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows]), [r[2] for r in rows], [bytes(r[3]) for r in rows]))
    out = pa.list_(to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_all_winners(b.column(1).to_pylist(), *held.value, rf), out)], ["__k", "placement"])

    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    different = keys.select(F.col(key).alias("__k")).distinct().repartition(parts)  # copies combine before any exchange
    kinds = f"__k {different.schema['__k'].dataType.simpleString()}, placement array<{kind.simpleString()}>"
    return different.select("__k", F.col("__k").cast("binary").alias("b")).mapInArrow(run, kinds)


def place(keys: DataFrame, nodes: DataFrame, rf: int, key: str = "object_hash", max_nodes: int = MAX_NODES) -> DataFrame:
    """``keys`` with ``placement``: up to ``rf`` node ids of eligible nodes, best first; ties by declaration order.

    Raises ValueError for no nodes, a factor below one or no node of positive weight; a null or empty key
    gets a null placement.
    """
    if rf <= 0:
        raise ValueError("the replication factor must be positive")
    able = nodes.where("node_id is not null and weight > 0").select("node_id", "weight", "decl_order", little_endian(F.col("node_id")).alias("key"))
    n = able.count()
    if not n:
        raise ValueError("no node has a positive weight")
    usable = F.col(key).isNotNull() & (F.col(key) != "")
    names = keys.columns
    if n <= max_nodes:
        best = _placements(keys.where(usable), key, able, rf)
    else:
        groups = able.groupBy(F.pmod(F.xxhash64("node_id"), F.lit(-(-n // max_nodes))).alias("b")).agg(F.collect_list(F.struct("node_id", "weight", "decl_order", "key")).alias("members"))
        best = spread(keys).select(key).where(usable).distinct().crossJoin(groups.select("members"))
        best = best.select(key, F.explode(_ranked(best, key, "members", rf)).alias("x")).groupBy(key).agg(F.slice(F.sort_array(F.collect_list("x")), 1, rf).alias("x"))
        best = best.select(F.col(key).alias("__k"), F.transform("x", lambda x: x["node_id"]).alias("placement"))
    return keys.join(best, F.col(key) == F.col("__k"), "left").select(*names, "placement")


def primary(placement: Column) -> Column:
    return F.get(placement, 0)


def position(placement: Column, node: Column) -> Column:
    """A node's rank from 0; -1 outside."""
    return (F.array_position(placement, node) - 1).cast("int")


def next_hop(placement: Column, node: Column) -> Column:
    """The node after ``node`` in the chain; null at its end and outside."""
    at = position(placement, node)
    return F.when(at >= 0, F.get(placement, at + 1))


def edges(mode: str, placement: Column, landing: Column | None = None) -> Column:
    """The plan's transfers as an array of (source, target); source -1 is the client.

    none: the landing node stores alone.  chain: each node hands on to the next.  splay: the first node sends
    to all others; an outside landing node is the hub for the whole placement.  primary-splay: the client sends
    to the landing node and the placement.
    """
    first = landing if landing is not None else primary(placement)
    pair = lambda a, b: F.struct(a.cast("bigint").alias("source"), b.cast("bigint").alias("target"))
    client = F.lit(-1)
    if mode == "none":
        return F.array(pair(client, first))
    if mode == "chain":
        tail = F.slice(placement, F.lit(1), F.greatest(F.size(placement) - 1, F.lit(0)))
        hops = F.transform(tail, lambda x, i: pair(x, F.get(placement, i + 1)))
        return F.concat(F.array(pair(client, first)), F.when(F.array_contains(placement, first), hops).otherwise(F.array().cast("array<struct<source:bigint,target:bigint>>")))
    if mode == "splay":
        return F.concat(F.array(pair(client, first)), F.transform(F.array_except(placement, F.array(first)), lambda x: pair(first, x)))
    if mode == "primary-splay":
        return F.transform(F.array_union(F.array(first), placement), lambda x: pair(client, x))
    raise ValueError(f"unknown mode {mode}")


def resolve_mode(state_mode: Column, requested: Column, is_peer: Column, is_external: Column, order: list[int], client_side: list[int]) -> Column:
    """A peer's request counts, else the cluster's mode; external clients step down to a server-side mode."""
    base = F.coalesce(F.when(is_peer, requested).otherwise(state_mode), F.lit(0))
    return F.when(is_external, downgrade(base, order, client_side)).otherwise(base)


def downgrade(mode: Column, order: list[int], client_side: list[int]) -> Column:
    """The next server-side mode after ``mode`` in the order, around its end; none (0) if there is none."""
    out = mode
    for m in client_side:
        at = order.index(m) + 1 if m in order else 0
        walk = [x for x in order[at:] + order[:at] if x not in client_side]
        out = F.when(mode == m, F.lit(walk[0] if walk else 0)).otherwise(out)
    return out


def effective_durability(mode: Column, rf: Column, cluster: Column) -> Column:
    """Copies that a mode keeps: one for none, else at most the cluster."""
    return F.when(mode == 0, 1).otherwise(F.least(rf, F.greatest(cluster, F.lit(1))))


def degraded(rf: Column, cluster: Column) -> Column:
    return rf > cluster


def acknowledged(edges_ok: DataFrame, by: str) -> DataFrame:
    """Success by request: all of its transfers within thirty seconds."""
    return edges_ok.groupBy(by).agg(F.bool_and(F.col("ok") & (F.col("latency_ns") <= ACK_NS)).alias("ack"))
