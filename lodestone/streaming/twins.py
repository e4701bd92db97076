"""The state machines as streams: the same steps, with the state kept between batches.

Each twin runs on event time, so a replay of the same events ends in the state
that the batch form computes.  Late events beyond the watermark are dropped, as
responses are that come after their request has timed out.  State of a key that
has been silent for ``KEEP_S`` is dropped, so it doesn't grow for ever.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import gather, machines
from ..session import shared_dir

#: A key without events for so long loses its state.
KEEP_S = 7 * 24 * 3600


def events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream; time as a timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parquet*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows with the batch that made them, from the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/{number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{path}/out/*")


def _kept(state: GroupState, last_ms: int, keep_s: int) -> None:
    """Sets the time when the state goes unless an event comes before."""
    state.setTimeoutTimestamp(max(last_ms + keep_s * 1000, state.getCurrentWatermarkMs() + 1))


def latency(stream: DataFrame, key: str = "user_id", watermark: str = "1 hour", keep_s: int = KEEP_S) -> DataFrame:
    """``key, rtt_ns`` after each batch."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for x in rows["rtt_ns"]:
            value = int(x) if value is None else int(value * 0.75 + int(x) * 0.25)
        state.update((value,))
        _kept(state, int(rows["ms"].max()), keep_s)
        yield pd.DataFrame({"peer": [k[0]], "rtt_ns": [value]})

    samples = stream.withWatermark("ts", watermark).withColumns({"rtt_ns": F.floor(F.col("value") * 1_000_000).cast("bigint"), "ms": F.unix_millis("ts")})
    return samples.groupBy(key).applyInPandasWithState(step, "peer long, rtt_ns long", "rtt_ns long", "update", GroupStateTimeout.EventTimeTimeout)


def limiter_state(state: tuple[int, int, int, int, int], ts: int, ok: bool, base_ns: int) -> tuple[int, int, int, int, int]:
    """One attempt in plain Python: failures, next allowed, locked until, last seen, refused."""
    failures, allow, locked, seen, refused = state
    fresh = failures > 0 and ts - seen > machines.IDLE_NS and ts >= allow
    if not fresh and (ts < allow or ts < locked):
        return failures, allow, locked, seen, refused + 1
    if ok:
        return 0, 0, 0, 0, refused
    n = (0 if fresh else failures) + 1
    if n >= machines.MAX_FAILURES:
        until = ts + machines.lockout(base_ns)
        return n, until, until, ts, refused
    return n, ts + min(base_ns * 2 ** (n - 1), machines.MAX_DELAY), 0 if fresh else locked, ts, refused


def limiter(stream: DataFrame, base_ns: int = machines.SECOND, watermark: str = "1 hour", keep_s: int = KEEP_S) -> DataFrame:
    """``source`` and its limiter's state after each batch."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else (0, 0, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts_ns", "event_id"])
        for r in rows.itertuples():
            held = limiter_state(held, int(r.ts_ns), bool(r.ok), base_ns)
        state.update(held)
        _kept(state, int(rows["ts_ns"].max()) // machines.MS, keep_s)
        yield pd.DataFrame([[k[0], *held]], columns=["source", "failures", "next_allow", "locked_until", "last_seen", "refused"])

    rows = stream.withWatermark("ts", watermark).select(F.col("user_id").alias("source"), "ts", "event_id", (F.unix_micros("ts") * 1000).alias("ts_ns"), (F.col("event_type") != "error").alias("ok"))
    kinds = "failures int, next_allow long, locked_until long, last_seen long, refused int"
    return rows.groupBy("source").applyInPandasWithState(step, f"source long, {kinds}", kinds, "update", GroupStateTimeout.EventTimeTimeout)


def liveness(stream: DataFrame, timeout_s: int, watermark: str = "1 hour") -> DataFrame:
    """``peer, state, last_seen``: restored by beats, suspect and offline by timers when none come."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, seen = tuple(state.get) if state.exists else (machines.ALIVE, 0)
        if state.hasTimedOut:
            status = machines.SUSPECT if status == machines.ALIVE else machines.OFFLINE
        else:
            last = max(int(f["ms"].max()) for f in frames)
            status, seen = machines.ALIVE, max(seen, last)
        state.update((status, seen))
        if status != machines.OFFLINE:
            state.setTimeoutTimestamp(max(seen + timeout_s * 1000 * (1 + status), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"peer": [k[0]], "state": [status], "last_seen_ms": [seen]})

    beats = stream.withWatermark("ts", watermark).select(F.col("user_id").alias("peer"), "ts", F.unix_millis("ts").alias("ms"))
    return beats.groupBy("peer").applyInPandasWithState(step, "peer long, state int, last_seen_ms long", "state int, seen long", "update", GroupStateTimeout.EventTimeTimeout)


def answered(stream: DataFrame, again: DataFrame, timeout: str = "INTERVAL 6 HOURS") -> DataFrame:
    """Clicks with the views of their user within the timeout, both sides watermarked."""
    asks = stream.where("event_type = 'click'").select(F.col("user_id").alias("id"), F.col("ts").alias("request_ts"), F.col("event_id").alias("request_id")).withWatermark("request_ts", "1 hour")
    answers = again.where("event_type = 'view'").select(F.col("user_id").alias("response_id"), F.col("ts").alias("response_ts"), F.col("event_id").alias("response_event")).withWatermark("response_ts", "1 hour")
    return gather.answered(asks, answers, timeout).select("request_id", "response_event")


def daily_counts(stream: DataFrame) -> DataFrame:
    """Events by day and type."""
    return stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("day_us"), "event_type", "n")


def collect_garbage(stream: DataFrame, sweep: Callable[[DataFrame, int], None], every: str = "300 seconds", checkpoint: str | None = None):
    """Starts the sweep on a schedule: orphans first, then tombstones, as ``sweep(batch, number)`` does it; ``machines.garbage`` says what goes."""
    writer = stream.writeStream.trigger(processingTime=every).foreachBatch(sweep)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
