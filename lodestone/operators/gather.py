"""Scatter-gather: per-node lists merged, response tallies, quorums and interval joins of requests with responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_TYPES = {1: "list", 2: "get", 3: "has", 4: "delete"}


def merge(lists: DataFrame, validity: Column | None = None) -> DataFrame:
    """Distinct ``(name, object_hash)`` over ``lists(source_rank, name, object_hash, ...)``; the first source's row wins.

    One invalid row makes a whole source's list undecodable: that source is skipped.  The first row is a minimum,
    so copies of a row combine before the shuffle.  The sources are broadcast: a semi join goes below the exchange, and
    the lists are then computed twice.  So they are where ``validity`` leaves out a column.
    """
    if validity is not None:
        lists = lists.repartition("name", "object_hash")  # one exchange for both uses; the last step needs it anyway
        good = lists.groupBy("source_rank").agg(F.bool_and(validity).alias("ok")).where("ok").select("source_rank")
        lists = lists.join(F.broadcast(good), "source_rank")
    rest = [c for c in lists.columns if c not in ("name", "object_hash")]
    first = F.min(F.struct("source_rank", *(c for c in rest if c != "source_rank"))).alias("x")
    return lists.groupBy("name", "object_hash").agg(first).select("name", "object_hash", *(F.col(f"x.{c}").alias(c) for c in rest))


def tally(responses: DataFrame, by: str = "request_id") -> DataFrame:
    """``ok, failed, first_error`` for each request."""
    bad = F.col("error").isNotNull() & (F.col("error") != "")
    return responses.groupBy(by).agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"), F.min_by(F.when(bad, F.col("error")), F.when(bad, F.col("arrival"))).alias("first_error"))


def quorum(n: Column) -> Column:
    """A majority; none of nobody."""
    return F.when(n <= 0, 0).otherwise(F.floor(n / 2).cast("int") + 1)


def lease_results(grants: DataFrame, peers: int, known: int, duration_ns: int | None = None) -> DataFrame:
    """``lease_id, granted, acquired`` over alive ``peers``; with peers known but none alive nothing is acquired.

    With a duration, only grants ``waited_ns`` of which is at most half of it count: no longer does anyone wait.
    """
    vote = F.col("granted") if duration_ns is None else F.col("granted") & (F.col("waited_ns") <= duration_ns // 2)
    votes = grants.groupBy("lease_id").agg(F.count_if(vote).alias("granted"))
    cut_off = known > 0 and peers == 0
    return votes.select("lease_id", "granted", (F.lit(not cut_off) & (F.col("granted") >= quorum(F.lit(peers)))).alias("acquired"))


def shares(responses: DataFrame, threshold: int) -> DataFrame:
    """``request_id, shares, enough``: distinct usable shares; errors, empty evaluations and indexes below one don't count."""
    usable = (F.coalesce("error", F.lit("")) == "") & (F.octet_length("evaluation") > 0) & (F.col("share_index") > 0)
    return responses.groupBy("request_id").agg(F.count_distinct(F.when(usable, F.col("share_index"))).alias("shares")).select("request_id", "shares", (F.col("shares") >= threshold).alias("enough"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that aren't unique."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def answered(requests: DataFrame, responses: DataFrame, timeout: str, within: str = "INTERVAL 0 SECONDS") -> DataFrame:
    """Requests with the responses of their id that came within ``timeout``; works on batches and on watermarked streams.

    In a batch an id's requests and responses meet in slots of the timeout's length, a request in those that its
    time to wait touches, so a hot id spreads over time.
    """
    on = f"id = response_id AND response_ts >= request_ts + {within} AND response_ts <= request_ts + {timeout}"
    if requests.isStreaming or responses.isStreaming:
        return requests.join(responses, F.expr(on))
    slot = lambda t: f"unix_micros(cast({t} as timestamp)) div unix_micros(timestamp_micros(0) + {timeout})"
    asked = requests.withColumn("__slot", F.explode(F.expr(f"sequence({slot(f'request_ts + {within}')}, {slot(f'request_ts + {timeout}')})")))
    came = responses.withColumn("__at", F.expr(slot("response_ts")))
    return asked.join(came, F.expr(f"{on} AND __slot = __at")).drop("__slot", "__at")


def unseen(members: DataFrame, known: DataFrame) -> DataFrame:
    """Heartbeat members that are new, each with its first address."""
    new = members.join(known.select("id"), "id", "left_anti")
    return new.groupBy("id").agg(F.min_by("addr", "arrival").alias("addr"))
