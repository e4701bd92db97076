"""Queries of the streaming twins, replayed over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.relations import with_sql
from ..streaming import twins
from .machines import _RTT, LIMITER
from .registry import query


def _last(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), "batch").alias("x")).select(key, "x.*").drop("batch")


@query("t1_latency_stream", _RTT + " SELECT peer, rtt_ns FROM smooth")
def t1_latency_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(twins.run(twins.latency(twins.events(spark, sf_dir)), "update"), "peer")


@query("t13_limiter_stream", LIMITER)
def t13_limiter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(twins.run(twins.limiter(twins.events(spark, sf_dir)), "update"), "source")


@query("t2_liveness_stream")
def t2_liveness_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(twins.run(twins.liveness(twins.events(spark, sf_dir).where("event_type <> 'error'"), 3600), "update"), "peer")


@query("j6_answered_stream", with_sql("samples") + " SELECT q.event_id AS request_id, r.event_id AS response_event FROM samples q JOIN samples r ON q.user_id = r.user_id AND r.ts_us BETWEEN q.ts_us AND q.ts_us + 21600000000 WHERE q.event_type = 'click' AND r.event_type = 'view'")
def j6_answered_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twins.run(twins.answered(twins.events(spark, sf_dir), twins.events(spark, sf_dir))).drop("batch")


@query("t15_daily_stream", with_sql("samples") + " SELECT (ts_us // 86400000000) * 86400000000 AS day_us, event_type, count(*) AS n FROM samples GROUP BY ALL")
def t15_daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = twins.run(twins.daily_counts(twins.events(spark, sf_dir)), "update")
    return rows.groupBy("day_us", "event_type").agg(F.max_by("n", "batch").alias("n"))
