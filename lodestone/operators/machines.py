"""Replayable state machines: latency averages, liveness, mode control, back-off and leases.

Each is one step function from a state to the next, on columns.  A batch runs
it over a key's events in order with ``aggregate``; the streaming twins keep
the same state between batches.  The events of a key are collected for the
fold, which bounds a key's history in a batch by a task's memory; beyond that
the twins run the same steps over a stored stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MS, SECOND = 1_000_000, 1_000_000_000
ALIVE, SUSPECT, OFFLINE = 0, 1, 2
MAX_DELAY, MAX_FAILURES, IDLE_NS = 8 * SECOND, 5, 300 * SECOND


def fold(events: DataFrame, key: str, order: list[str], value: list[str], zero: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, out: str = "state") -> DataFrame:
    """``key, out``: the state of each key after its events in order."""
    rows = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *value))).alias("__e"))
    return rows.select(key, (F.aggregate("__e", zero, step, finish) if finish else F.aggregate("__e", zero, step)).alias(out))


def scan(events: DataFrame, key: str, order: list[str], value: list[str], zero: Column, step: Callable[[Column, Column], Column], out: str = "state") -> DataFrame:
    """One row for each event: ``key``, the event's columns and the state after it."""
    rows = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *value))).alias("__e"))
    start = F.struct(zero.alias("s"), F.array().cast(_array_type(events, zero)).alias("a"))
    run = F.aggregate("__e", start, lambda a, x: _pushed(a, step(a["s"], x)))["a"]
    return rows.select(key, F.explode(F.arrays_zip("__e", run.alias("__s"))).alias("x")).select(key, "x.__e.*", F.col("x.__s").alias(out))


def _pushed(a: Column, s: Column) -> Column:
    return F.struct(s.alias("s"), F.concat(a["a"], F.array(s)).alias("a"))


def _array_type(events: DataFrame, zero: Column) -> str:
    return f"array<{events.sparkSession.range(1).select(zero.alias('z')).schema['z'].dataType.simpleString()}>"


def ewma(previous: Column, sample: Column) -> Column:
    """A quarter of the new sample, cut to whole nanoseconds at every step; the first sample counts whole."""
    return F.when(previous.isNull(), sample).otherwise((previous * 0.75 + sample * 0.25).cast("bigint"))


def fanout(n: Column) -> Column:
    """The logarithm of the alive peers, from 1 to 10."""
    return F.least(F.lit(10), F.greatest(F.lit(1), F.when(n > 0, F.ceil(F.ln(n))).otherwise(1))).cast("int")


def adaptive_timeout(rtt_ns: Column, base_ns: Column) -> Column:
    """Ten round trips, within one to five times the base; the base if no round trip is known."""
    return F.when(rtt_ns > 0, F.least(5 * base_ns, F.greatest(base_ns, 10 * rtt_ns))).otherwise(base_ns)


def liveness(state: Column, elapsed_ns: Column, timeout_ns: Column) -> Column:
    """One tick: beyond the timeout alive turns suspect, beyond twice of it suspect turns offline."""
    return F.when((state == ALIVE) & (elapsed_ns > timeout_ns), SUSPECT).when((state == SUSPECT) & (elapsed_ns > 2 * timeout_ns), OFFLINE).otherwise(state)


def observed(state: Column, kind: Column) -> Column:
    """A heartbeat, ping or ack restores a peer; an announced suspicion turns alive to suspect."""
    return F.when(kind.isin("heartbeat", "ping", "ack"), ALIVE).when((kind == "suspect") & (state == ALIVE), SUSPECT).otherwise(state)


def replay_liveness(events: DataFrame, tick_ns: int, timeout_ns: int, until_ns: int) -> DataFrame:
    """``peer, state, last_seen, left`` at ``until_ns``: heartbeats with ticks every ``tick_ns`` between them.

    Between two heartbeats only the gap counts: a peer is offline if some tick falls beyond twice the timeout
    and an earlier one beyond the timeout, so the state follows from the last heartbeat, and departures from
    the gaps.  No event history is held.
    """
    from pyspark.sql import Window

    # a hot peer's beats spread over buckets of an hour; the edge of a bucket takes the first beat of the next one
    hour = F.floor(F.col("ts_ns") / (3600 * SECOND))
    beats = events.select("peer", "ts_ns", hour.alias("b"))
    edge = beats.groupBy("peer", "b").agg(F.min("ts_ns").alias("first")).withColumn("next_first", F.lead("first").over(Window.partitionBy("peer").orderBy("b"))).select("peer", "b", "next_first")
    inside = Window.partitionBy("peer", "b").orderBy("ts_ns")
    gaps = beats.withColumn("n", F.lead("ts_ns").over(inside)).join(edge, ["peer", "b"]).select("peer", "ts_ns", F.coalesce("n", "next_first", F.lit(until_ns)).alias("next_ts"), F.coalesce("n", "next_first").isNull().alias("final"))
    # ticks at multiples of tick_ns: the first that finds the peer beyond a bound
    tick_after = lambda t: (F.floor(t / tick_ns) + 1) * tick_ns
    suspect_at = tick_after(F.col("ts_ns") + timeout_ns)
    offline_at = F.greatest(suspect_at + tick_ns, tick_after(F.col("ts_ns") + 2 * timeout_ns))
    gone = gaps.withColumns({"s": suspect_at, "o": offline_at})
    end = F.col("next_ts")
    return gone.groupBy("peer").agg(
        F.max("ts_ns").alias("last_seen"),
        F.max(F.when(F.col("final"), F.when(F.col("o") <= end, OFFLINE).when(F.col("s") <= end, SUSPECT).otherwise(ALIVE))).alias("state"),
        F.count_if((F.col("o") < end) | (F.col("final") & (F.col("o") <= end))).alias("left"),
    )


def control_step(index: Column, mem: Column, cpu: Column, low: float, high: float, size: int) -> Column:
    """One decision: too much memory, else too much processor, moves up the order; both low moves down; within its bounds."""
    up = F.least(index + 1, F.lit(size - 1))
    down = F.greatest(index - 1, F.lit(0))
    return F.when(index < 0, index).when(mem >= high, up).when(cpu >= high, up).when((mem < low) & (cpu < low), down).otherwise(index)


def floor_allows(index: Column, order: list[str], floor: int, rf: int, cluster: int) -> Column:
    """Whether the mode at ``index`` keeps the floor's copies; no floor, or an index outside, allows."""
    copies = [1 if m == "none" else min(rf, max(cluster, 1)) for m in order]
    inside = (index >= 0) & (index < len(order))
    keeps = F.get(F.array(*(F.lit(c) for c in copies)), index) >= floor
    return F.lit(True) if floor <= 0 else F.when(inside, keeps).otherwise(True)


def control_tick(state: Column, sample: Column, low: float, high: float, order: list[str], floor: int, rf: int, cluster: int, fallback_ns: int) -> Column:
    """``(index, start, changed)`` after a sample ``(ts, mem, cpu)``: the decision, the floor, then the fallback.

    An accepted change restarts the clock, so no fallback follows in its tick; after a refused one it can.
    """
    allowed = lambda i: floor_allows(i, order, floor, rf, cluster)
    want = control_step(state["index"], sample["mem"], sample["cpu"], low, high, len(order))
    move = (want != state["index"]) & allowed(want)
    index = F.when(move, want).otherwise(state["index"])
    start = F.when(move, sample["ts"]).otherwise(state["start"])
    late = (sample["ts"] - start > fallback_ns) & (index > 0)
    back = late & allowed(index - 1)
    return F.struct(F.when(back, index - 1).otherwise(index).cast("int").alias("index"), F.when(late, sample["ts"]).otherwise(start).alias("start"), (move | back).alias("changed"))


def backoff(failures: Column, base_ns: int) -> Column:
    """Doubles from the base with each failure, up to eight seconds."""
    return F.least(F.lit(MAX_DELAY), (F.lit(base_ns) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(40)))).cast("bigint"))


def lockout(base_ns: int) -> int:
    return max(min(60 * base_ns, 60 * SECOND), MAX_DELAY)


def limiter_zero() -> Column:
    z = F.lit(0).cast("bigint")
    return F.struct(F.lit(0).alias("failures"), z.alias("next_allow"), z.alias("locked_until"), z.alias("last_seen"), F.lit(0).alias("refused"))


def limiter_step(state: Column, event: Column, base_ns: int) -> Column:
    """An attempt ``(ts, ok)``: refused while it must wait; a success clears, a failure backs off, five lock out.

    A source idle for five minutes starts anew.
    """
    ts = event["ts"]
    fresh = (state["failures"] > 0) & (ts - state["last_seen"] > IDLE_NS) & (ts >= state["next_allow"])
    failures = F.when(fresh, 0).otherwise(state["failures"])
    refused = ~fresh & ((ts < state["next_allow"]) | (ts < state["locked_until"]))
    z = F.lit(0).cast("bigint")
    n = failures + 1
    locked = n >= MAX_FAILURES
    wait = F.when(locked, F.lit(lockout(base_ns)).cast("bigint")).otherwise(backoff(n, base_ns))
    made = lambda f, a, u, s, r: F.struct(f.cast("int").alias("failures"), a.alias("next_allow"), u.alias("locked_until"), s.alias("last_seen"), r.cast("int").alias("refused"))
    return (
        F.when(refused, made(state["failures"], state["next_allow"], state["locked_until"], state["last_seen"], state["refused"] + 1))
        .when(event["ok"], made(F.lit(0), z, z, z, state["refused"]))
        .otherwise(made(n, ts + wait, F.when(locked, ts + wait).otherwise(F.when(fresh, z).otherwise(state["locked_until"])), ts, state["refused"]))
    )


def lease_step(state: Column, event: Column) -> Column:
    """A lease key's ``(expiry, grants, denials)`` after ``(ts, kind, expiry)``: an open grant denies, a release frees whoever asks."""
    ask = event["kind"] == "request"
    open_ = ask & (state["expiry"] > event["ts"])
    take = ask & ~open_
    return F.struct(F.when(take, event["expiry"]).when(event["kind"] == "release", F.lit(0).cast("bigint")).otherwise(state["expiry"]).alias("expiry"), (state["grants"] + take.cast("int")).alias("grants"), (state["denials"] + open_.cast("int")).alias("denials"))


def lease_zero() -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("expiry"), F.lit(0).alias("grants"), F.lit(0).alias("denials"))


def last_mode(broadcasts: DataFrame) -> DataFrame:
    """The newest mode change of each node: last write wins."""
    return broadcasts.groupBy("node").agg(F.max_by(F.struct("old", "new"), "ts").alias("x"), F.max("ts").alias("ts")).select("node", "x.old", "x.new", "ts")


def alive_by_quality(peers: DataFrame) -> DataFrame:
    """Alive peers, the fastest first, unknown round trips (0) last, ties by id."""
    return peers.where(F.col("state") == ALIVE).orderBy(F.col("rtt_ns") == 0, "rtt_ns", "id")


def ranked(rows: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """``rows`` with their place in the order, from 1; ranges of the order are dealt to tasks, one row for each carries the count on."""
    from pyspark.sql import Window

    dealt = rows.repartitionByRange(*order).withColumn("__b", F.spark_partition_id())
    inner = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    sums = dealt.groupBy("__b").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("__b", F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__n"))  # one row for each task
    return dealt.withColumn("__p", inner).join(F.broadcast(before), "__b").withColumn(out, (F.col("__n") + F.col("__p")).cast("int")).drop("__b", "__p", "__n")


def random_peers(peers: DataFrame, k: int, exclude: int, round_: int) -> DataFrame:
    """``k`` alive peers in an order that the round's number settles, without one's own."""
    chance = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(round_))), 256)
    return peers.where((F.col("state") == ALIVE) & (F.col("id") != exclude)).orderBy(chance, "id").limit(k)


def swept(leases: DataFrame, now_ns: int) -> DataFrame:
    """The leases that a sweep leaves: those that haven't expired before now."""
    return leases.where(F.col("expiry") >= now_ns)


def membership_events(known: DataFrame, members: DataFrame) -> DataFrame:
    """``id, event``: a join for each member that wasn't known."""
    return members.select("id").distinct().join(known.select("id"), "id", "left_anti").select("id", F.lit("join").alias("event"))


def garbage(objects: DataFrame, tombs: DataFrame, now_ns: int, retention_ns: int) -> DataFrame:
    """``kind, key`` of what one run of the collector removes: orphans first, then expired tombstones."""
    from .state import expired, orphans

    return orphans(objects).select(F.lit("object").alias("kind"), F.col("object_hash").alias("key")).unionByName(expired(tombs, now_ns, retention_ns).select(F.lit("tombstone").alias("kind"), F.col("name").alias("key")))


def probe(pings: DataFrame, acks: DataFrame, timeout_ns: int = 500 * MS) -> DataFrame:
    """Each ping with its first ack in time: ``rtt_ns``, or null and suspicion."""
    a = acks.select(F.col("ping_id").alias("__p"), F.col("ts_ns").alias("ack_ns"))
    near = (F.col("ping_id") == F.col("__p")) & F.col("ack_ns").between(F.col("ts_ns"), F.col("ts_ns") + timeout_ns)
    met = pings.join(a, near, "left").groupBy("ping_id", "target", "ts_ns").agg(F.min("ack_ns").alias("ack_ns"))
    return met.select("ping_id", "target", (F.col("ack_ns") - F.col("ts_ns")).alias("rtt_ns"), F.col("ack_ns").isNull().alias("suspect"))


def probe_twice(pings: DataFrame, acks: DataFrame, timeout_ns: int = 500 * MS) -> DataFrame:
    """Pings ``(ping_id, target, ts_ns, helpers)`` with the outcome of both waits.

    An ack within the timeout answers directly.  Without one, helpers are asked, and an ack within a second timeout
    answers through them; without a helper, or without an ack by then, the target turns suspect.
    """
    a = acks.select(F.col("ping_id").alias("__p"), F.col("ts_ns").alias("ack_ns"))
    near = (F.col("ping_id") == F.col("__p")) & F.col("ack_ns").between(F.col("ts_ns"), F.col("ts_ns") + 2 * timeout_ns)
    met = pings.join(a, near, "left").groupBy("ping_id", "target", "ts_ns", "helpers").agg(F.min("ack_ns").alias("ack_ns"))
    wait = F.col("ack_ns") - F.col("ts_ns")
    how = F.when(wait <= timeout_ns, "direct").when((F.col("helpers") > 0) & wait.isNotNull(), "indirect").otherwise("suspect")
    return met.select("ping_id", "target", how.alias("outcome"), F.when(how != "suspect", wait).alias("rtt_ns"))
