"""Queries of the replayable state machines, counters and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import counters, gather, machines
from ..sources import relations as rel
from ..sources.relations import with_sql
from .registry import query

NS = 1_000


def _rtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round trip for each event: one nanosecond for a millionth of its value."""
    e = rel.samples(spark, sf_dir)
    return e.select(F.col("user_id").alias("peer"), "ts_us", "event_id", F.floor(F.col("value") * 1_000_000).cast("bigint").alias("rtt_ns"))


_RTT = with_sql("samples") + ", rtt AS (SELECT user_id AS peer, ts_us, event_id, floor(value * 1000000)::BIGINT AS rtt_ns FROM samples), smooth AS (SELECT peer, list_reduce(list(rtt_ns ORDER BY ts_us, event_id), lambda a, x: trunc(a * 0.75 + x * 0.25)::BIGINT) AS rtt_ns, max(ts_us) AS last_us FROM rtt GROUP BY peer)"


def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = machines.fold(_rtt(spark, sf_dir), "peer", ["ts_us", "event_id"], ["rtt_ns"], F.lit(None).cast("bigint"), lambda a, x: machines.ewma(a, x["rtt_ns"]), out="rtt_ns")
    return out


@query("t1_latency_average", _RTT + " SELECT peer, rtt_ns FROM smooth")
def t1_latency_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smooth(spark, sf_dir)


@query("f24_adaptive_timeout", _RTT + " SELECT peer, CASE WHEN rtt_ns > 0 THEN least(500000000, greatest(100000000, 10 * rtt_ns)) ELSE 100000000 END AS timeout_ns FROM smooth")
def f24_adaptive_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smooth(spark, sf_dir).select("peer", machines.adaptive_timeout(F.col("rtt_ns"), F.lit(100 * machines.MS)).alias("timeout_ns"))


@query("f23_fanout", "SELECT n, least(10, greatest(1, CASE WHEN n > 0 THEN ceil(ln(n)) ELSE 1 END))::INT AS fanout FROM (SELECT o_orderkey - 1 AS n FROM orders)")
def f23_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "orders").select((F.col("o_orderkey") - 1).alias("n")).select("n", machines.fanout(F.col("n")).alias("fanout"))


def _peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rel.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("state"), F.when(F.col("c_custkey") % 5 == 0, 0).otherwise(F.floor(F.abs("c_acctbal") * 100)).cast("bigint").alias("rtt_ns"))


_PEERS = "WITH peers AS (SELECT c_custkey AS id, c_custkey % 3 AS state, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE floor(abs(c_acctbal) * 100) END::BIGINT AS rtt_ns FROM customer)"


@query("k5_alive_by_quality", _PEERS + " SELECT id, rtt_ns, row_number() OVER (ORDER BY rtt_ns = 0, rtt_ns, id)::INT AS place FROM peers WHERE state = 0")
def k5_alive_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = _peers(spark, sf_dir).where(F.col("state") == machines.ALIVE)
    return machines.ranked(alive, [F.col("rtt_ns") == 0, F.col("rtt_ns"), F.col("id")]).select("id", "rtt_ns", "place")


@query("p10_alive_count", _PEERS + " SELECT count(*) FILTER (state = 0) AS alive FROM peers")
def p10_alive_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peers(spark, sf_dir).agg(F.count_if(F.col("state") == 0).alias("alive"))


@query("k6_random_peers", _PEERS + " SELECT id, state FROM peers WHERE state = 0 AND id <> 3 ORDER BY sha256(id || ':1'), id LIMIT 5")
def k6_random_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machines.random_peers(_peers(spark, sf_dir), 5, 3, 1).select("id", "state")


_BEATS = with_sql("samples") + ", beats AS (SELECT user_id AS peer, ts_us * 1000 AS ts_ns FROM samples WHERE event_type <> 'error')"
_TICK, _SUSPECT, _UNTIL = 60 * machines.SECOND, 3600 * machines.SECOND, 1_706_745_600_000_000_000


@query("t2_liveness", _BEATS + f""", gaps AS (SELECT peer, ts_ns, coalesce(lead(ts_ns) OVER w, {_UNTIL}) AS e, lead(ts_ns) OVER w IS NULL AS final FROM beats WINDOW w AS (PARTITION BY peer ORDER BY ts_ns)),
marks AS (SELECT *, ((ts_ns + {_SUSPECT}) // {_TICK} + 1) * {_TICK} AS s, ((ts_ns + 2 * {_SUSPECT}) // {_TICK} + 1) * {_TICK} AS o0 FROM gaps), m AS (SELECT *, greatest(s + {_TICK}, o0) AS o FROM marks)
SELECT peer, max(ts_ns) AS last_seen, max(CASE WHEN final THEN CASE WHEN o <= e THEN 2 WHEN s <= e THEN 1 ELSE 0 END END)::INT AS state, count(*) FILTER (o < e OR (final AND o <= e)) AS "left" FROM m GROUP BY peer""")
def t2_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = rel.samples(spark, sf_dir).where("event_type <> 'error'").select(F.col("user_id").alias("peer"), (F.col("ts_us") * NS).alias("ts_ns"))
    return machines.replay_liveness(beats, _TICK, _SUSPECT, _UNTIL)


def load_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for each hour: the share of errors as memory, the mean value as processor load."""
    e = rel.samples(spark, sf_dir).withColumn("h", F.floor(F.col("ts_us") / 3_600_000_000))
    return e.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"), F.count_if(F.col("event_type") == "click").alias("clicks")).select(F.lit(0).alias("node"), (F.col("h") * 3600 * machines.SECOND).alias("ts"), (100.0 * F.col("bad") / F.col("n")).alias("mem"), (100.0 * F.col("clicks") / F.col("n")).alias("cpu"))


_LOAD = with_sql("samples") + ", hours AS (SELECT ts_us // 3600000000 AS h, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'click') AS clicks FROM samples GROUP BY 1), load AS (SELECT h * 3600000000000 AS ts, 100.0::DOUBLE * bad / n AS mem, 100.0::DOUBLE * clicks / n AS cpu FROM hours)"


@query("t7_control_step", _LOAD + " SELECT ts, CASE WHEN mem >= 30 THEN 2 WHEN cpu >= 30 THEN 2 WHEN mem < 10 AND cpu < 10 THEN 0 ELSE 1 END::INT AS next_index FROM load")
def t7_control_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load_samples(spark, sf_dir)
    return s.select("ts", machines.control_step(F.lit(1), F.col("mem"), F.col("cpu"), 10.0, 30.0, 3).cast("int").alias("next_index"))


_ORDER4 = ["none", "chain", "splay", "primary-splay"]
_FALL = 6 * 3600 * machines.SECOND


def control_zero() -> "F.Column":
    return F.struct(F.lit(1).cast("int").alias("index"), F.lit(0).cast("bigint").alias("start"), F.lit(False).alias("changed"))


def control(s, x):
    return machines.control_tick(s, x, 10.0, 30.0, _ORDER4, 2, 3, 4, _FALL)


@query("t8_controller", _LOAD + f""", ordered AS (SELECT *, row_number() OVER (ORDER BY ts) AS r FROM load), run AS (
WITH RECURSIVE run AS (SELECT 0::BIGINT AS r, 0::BIGINT AS ts, 1 AS idx, 0::BIGINT AS start, false AS changed UNION ALL
SELECT o.r, o.ts, CASE WHEN late AND idx1 > 0 AND (idx1 - 1 >= 1) THEN idx1 - 1 ELSE idx1 END, CASE WHEN late AND idx1 > 0 THEN o.ts ELSE st1 END, move OR (late AND idx1 > 0 AND idx1 - 1 >= 1)
FROM (SELECT z.*, z.ts - st1 > {_FALL} AS late FROM (SELECT y.*, CASE WHEN move THEN want ELSE idx END AS idx1, CASE WHEN move THEN ts ELSE start END AS st1 FROM (SELECT x.*, want <> idx AND want >= 1 AS move FROM (SELECT n.r, n.ts, p.idx, p.start, CASE WHEN n.mem >= 30 THEN least(p.idx + 1, 3) WHEN n.cpu >= 30 THEN least(p.idx + 1, 3) WHEN n.mem < 10 AND n.cpu < 10 THEN greatest(p.idx - 1, 0) ELSE p.idx END AS want FROM run p JOIN ordered n ON n.r = p.r + 1) x) y) z) o)
SELECT * FROM run) SELECT ts, idx::INT AS mode_index, changed FROM run WHERE r > 0""")
def t8_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = machines.scan(load_samples(spark, sf_dir), "node", ["ts"], ["mem", "cpu"], control_zero(), control)
    return out.select("ts", F.col("state.index").alias("mode_index"), F.col("state.changed").alias("changed"))


@query("t9_durability_floor", "SELECT o_orderkey, CASE WHEN i < 0 OR i > 3 THEN true WHEN i = 0 THEN false ELSE true END AS allowed FROM (SELECT o_orderkey, o_orderkey % 7 - 1 AS i FROM orders)")
def t9_durability_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = (F.col("o_orderkey") % 7 - 1).cast("int")
    return rel.table(spark, sf_dir, "orders").select("o_orderkey", machines.floor_allows(i, _ORDER4, 2, 3, 4).alias("allowed"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.samples(spark, sf_dir).select(F.col("user_id").alias("source"), (F.col("ts_us") * NS).alias("ts"), "event_id", (F.col("event_type") != "error").alias("ok"))


_BASE = machines.SECOND
_FRESH = f"(a.f > 0 AND b.ts - a.s > {machines.IDLE_NS} AND b.ts >= a.n)"
_N = f"(CASE WHEN {_FRESH} THEN 0 ELSE a.f END + 1)"
_WAIT = f"CASE WHEN {_N} >= {machines.MAX_FAILURES} THEN {machines.lockout(_BASE)} ELSE least({machines.MAX_DELAY}, {_BASE} << least({_N} - 1, 20)) END"
_STEP = f"""CASE WHEN NOT {_FRESH} AND (b.ts < a.n OR b.ts < a.l) THEN {{'ts': b.ts, 'id': b.id, 'ok': b.ok, 'f': a.f, 'n': a.n, 'l': a.l, 's': a.s, 'r': a.r + 1}}
 WHEN b.ok THEN {{'ts': b.ts, 'id': b.id, 'ok': b.ok, 'f': 0::BIGINT, 'n': 0::BIGINT, 'l': 0::BIGINT, 's': 0::BIGINT, 'r': a.r}}
 ELSE {{'ts': b.ts, 'id': b.id, 'ok': b.ok, 'f': {_N}, 'n': (b.ts + {_WAIT})::BIGINT, 'l': CASE WHEN {_N} >= {machines.MAX_FAILURES} THEN (b.ts + {_WAIT})::BIGINT WHEN {_FRESH} THEN 0 ELSE a.l END, 's': b.ts, 'r': a.r}} END"""
LIMITER = with_sql("samples") + f""", ev AS (SELECT user_id AS source, ts_us * 1000 AS ts, event_id, event_type <> 'error' AS ok FROM samples),
folded AS (SELECT source, list_reduce(list({{'ts': ts, 'id': event_id, 'ok': ok, 'f': 0::BIGINT, 'n': 0::BIGINT, 'l': 0::BIGINT, 's': 0::BIGINT, 'r': 0::BIGINT}} ORDER BY ts, event_id), lambda a, b: {_STEP}, {{'ts': 0::BIGINT, 'id': 0::BIGINT, 'ok': true, 'f': 0::BIGINT, 'n': 0::BIGINT, 'l': 0::BIGINT, 's': 0::BIGINT, 'r': 0::BIGINT}}) AS s FROM ev GROUP BY source)
SELECT source, s.f::INT AS failures, s.n AS next_allow, s.l AS locked_until, s.s AS last_seen, s.r::INT AS refused FROM folded"""


@query("t13_auth_limiter", LIMITER)
def t13_auth_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = machines.fold(attempts(spark, sf_dir), "source", ["ts", "event_id"], ["ok"], machines.limiter_zero(), lambda s, x: machines.limiter_step(s, x, machines.SECOND))
    return out.select("source", "state.*")


@query("f25_backoff", "SELECT n, least(8000000000, (1000000000 * power(2.0::DOUBLE, least(n - 1, 40)))::BIGINT) AS delay_ns FROM (SELECT DISTINCT l_linenumber AS n FROM lineitem)")
def f25_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rel.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n")).distinct()
    return n.select("n", machines.backoff(F.col("n"), machines.SECOND).alias("delay_ns"))


@query("t11_lease_table", with_sql("samples") + """, ev AS (SELECT k % 8 AS key, ts_us * 1000 AS ts, event_id, CASE WHEN event_type = 'error' THEN 'release' ELSE 'request' END AS kind, ts_us * 1000 + 7200000000000 AS expiry FROM samples),
folded AS (SELECT key, list_reduce(list({'ts': ts, 'id': event_id, 'kind': kind, 'x': expiry, 'e': 0::BIGINT, 'g': 0, 'd': 0} ORDER BY ts, event_id), lambda a, b: {'ts': b.ts, 'id': b.id, 'kind': b.kind, 'x': b.x, 'e': CASE WHEN b.kind = 'release' THEN 0 WHEN a.e > b.ts THEN a.e ELSE b.x END, 'g': a.g + CASE WHEN b.kind = 'request' AND a.e <= b.ts THEN 1 ELSE 0 END, 'd': a.d + CASE WHEN b.kind = 'request' AND a.e > b.ts THEN 1 ELSE 0 END}, {'ts': 0::BIGINT, 'id': 0::BIGINT, 'kind': '', 'x': 0::BIGINT, 'e': 0::BIGINT, 'g': 0, 'd': 0}) AS s FROM ev GROUP BY key)
SELECT key, s.e AS expiry, s.g AS grants, s.d AS denials FROM folded""")
def t11_lease_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.samples(spark, sf_dir)
    ts = F.col("ts_us") * NS
    asks = e.select((F.col("k") % 8).alias("key"), ts.alias("ts"), "event_id", F.when(F.col("event_type") == "error", "release").otherwise("request").alias("kind"), (ts + 7200 * machines.SECOND).alias("expiry"))
    return machines.fold(asks, "key", ["ts", "event_id"], ["kind", "expiry"], machines.lease_zero(), machines.lease_step).select("key", "state.*")


@query("t10_last_mode", with_sql("samples") + " SELECT user_id AS node, arg_max(k % 4, ts_us) AS old, arg_max((k + 1) % 4, ts_us) AS new, max(ts_us) AS ts FROM samples GROUP BY user_id")
def t10_last_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.samples(spark, sf_dir)
    return machines.last_mode(e.select(F.col("user_id").alias("node"), (F.col("k") % 4).alias("old"), ((F.col("k") + 1) % 4).alias("new"), F.col("ts_us").alias("ts")))


@query("t4_probe", with_sql("samples") + " SELECT event_id AS ping_id, user_id AS target, CASE WHEN k % 3 <> 0 AND k % 10 * 100000000 <= 500000000 THEN k % 10 * 100000000 END AS rtt_ns, NOT (k % 3 <> 0 AND k % 10 * 100000000 <= 500000000) AS suspect FROM samples")
def t4_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.samples(spark, sf_dir)
    pings = e.select(F.col("event_id").alias("ping_id"), F.col("user_id").alias("target"), (F.col("ts_us") * NS).alias("ts_ns"))
    acks = e.where("k % 3 <> 0").select(F.col("event_id").alias("ping_id"), (F.col("ts_us") * NS + F.col("k") % 10 * 100_000_000).alias("ts_ns"))
    return machines.probe(pings, acks)


@query("p15_heartbeat_peers", with_sql("samples") + " SELECT peer, len(p)::INT AS n, sha256(array_to_string(p, ',')) AS named FROM (SELECT user_id AS peer, list(event_id ORDER BY event_id) FILTER (event_id % 7 <> user_id % 7)[1:256] AS p FROM samples GROUP BY 1)")
def p15_heartbeat_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sender's heartbeat names of all peers it knows: the first 256 without itself."""
    e = rel.samples(spark, sf_dir)
    own = F.col("user_id") % 7
    # events of the sender's own residue stand for itself
    known = e.groupBy(F.col("user_id").alias("peer")).agg(F.sort_array(F.collect_list(F.struct("event_id", F.when(F.col("event_id") % 7 == own, F.lit(-1)).otherwise(F.col("event_id")).alias("id"), F.lit("a").alias("addr")))).alias("p"))
    sent = codecs.read_heartbeat(codecs.heartbeat(codecs.heartbeat_peers(F.col("p"), F.lit(-1))))
    return known.select("peer", sent.alias("s")).select("peer", F.size("s").alias("n"), F.sha2(F.array_join(F.transform("s", lambda x: x["id"].cast("string")), ","), 256).alias("named"))


@query("t3_t5_observed", with_sql("samples") + " SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 0 WHEN event_type = 'error' AND k % 3 = 0 THEN 1 ELSE k % 3 END::INT AS state FROM samples")
def t3_t5_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats, pings and acks restore a peer of any state; an announced suspicion takes an alive one."""
    kind = F.when(F.col("event_type") == "click", "heartbeat").when(F.col("event_type") == "view", "ping").when(F.col("event_type") == "signup", "ack").when(F.col("event_type") == "error", "suspect").otherwise("query")
    return rel.samples(spark, sf_dir).select("event_id", machines.observed((F.col("k") % 3).cast("int"), kind).cast("int").alias("state"))


_PINGS = with_sql("samples") + ", pings AS (SELECT event_id AS ping_id, user_id AS target, ts_us * 1000 AS ts_ns, k % 3 AS helpers, k FROM samples), acks AS (SELECT ping_id, ts_ns + (k - 10) * 40000000 AS ack_ns FROM pings WHERE k % 4 <> 1 UNION ALL SELECT ping_id, ts_ns + k * 90000000 FROM pings)"


@query("t4_probe_twice", _PINGS + ", met AS (SELECT p.ping_id, target, helpers, min(ack_ns) - any_value(ts_ns) AS wait FROM pings p LEFT JOIN acks a ON a.ping_id = p.ping_id AND ack_ns BETWEEN ts_ns AND ts_ns + 1000000000 GROUP BY ALL), told AS (SELECT *, CASE WHEN wait <= 500000000 THEN 'direct' WHEN helpers > 0 AND wait IS NOT NULL THEN 'indirect' ELSE 'suspect' END AS outcome FROM met) SELECT ping_id, target, outcome, CASE WHEN outcome <> 'suspect' THEN wait END AS rtt_ns FROM told")
def t4_probe_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event pings; two acks, the first of which may be lost or stem from before."""
    p = rel.samples(spark, sf_dir).select(F.col("event_id").alias("ping_id"), F.col("user_id").alias("target"), (F.col("ts_us") * NS).alias("ts_ns"), (F.col("k") % 3).alias("helpers"), "k")
    first = p.where("k % 4 <> 1").select("ping_id", (F.col("ts_ns") + (F.col("k") - 10) * 40 * machines.MS).alias("ts_ns"))
    second = p.select("ping_id", (F.col("ts_ns") + F.col("k") * 90 * machines.MS).alias("ts_ns"))
    return machines.probe_twice(p.drop("k"), first.unionByName(second))


@query("t6_join_events", with_sql("samples") + " SELECT DISTINCT user_id AS id, 'join' AS event FROM samples WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM samples WHERE event_type = 'signup' AND k < 20)")
def t6_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.samples(spark, sf_dir)
    return machines.membership_events(e.where("event_type = 'signup' and k < 20").select(F.col("user_id").alias("id")), e.where("event_type = 'view'").select(F.col("user_id").alias("id")))


@query("t11_lease_sweep", with_sql("samples") + " SELECT event_id AS lease_id, ts_us * 1000 + k * 3600000000000 AS expiry FROM samples WHERE ts_us * 1000 + k * 3600000000000 >= 1705000000000000000")
def t11_lease_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    leases = rel.samples(spark, sf_dir).select(F.col("event_id").alias("lease_id"), (F.col("ts_us") * NS + F.col("k") * 3600 * machines.SECOND).alias("expiry"))
    return machines.swept(leases, 1_705_000_000_000_000_000)


@query("t12_lease_wait", with_sql("samples") + " SELECT k AS lease_id, count(*) FILTER (event_type <> 'error' AND value * 1000000 <= 100000000) AS granted, count(*) FILTER (event_type <> 'error' AND value * 1000000 <= 100000000) >= 8 AS acquired FROM samples GROUP BY k")
def t12_lease_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants that come after half of the lease's duration are too late."""
    e = rel.samples(spark, sf_dir)
    return gather.lease_results(e.select(F.col("k").alias("lease_id"), (F.col("event_type") != "error").alias("granted"), (F.col("value") * 1_000_000).alias("waited_ns")), 15, 15, 200 * machines.MS)


@query("a10_gauges", with_sql("samples") + " SELECT ts_us // 3600000000 AS hour, sum(value) AS total, sum(value) / 1048576.0::DOUBLE AS mebibytes, 100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*) AS error_percent FROM samples GROUP BY 1")
def a10_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of a gauge over instances, in other units, and shares."""
    e = rel.samples(spark, sf_dir).withColumn("hour", F.floor(F.col("ts_us") / 3_600_000_000))
    return counters.gauges(e, "hour", F.col("value"), F.col("event_type") == "error")


@query("a7_counters", with_sql("samples") + " SELECT user_id AS instance, count(*) AS connections_total, count(*) FILTER (event_type = 'signup') - count(*) FILTER (event_type = 'error') AS active_connections, count(*) FILTER (event_type = 'purchase') AS uploads_total, count(*) FILTER (event_type = 'view') AS downloads_total, count(*) FILTER (event_type = 'error') AS deletes_total, count(*) FILTER (event_type = 'click') AS replication_total, count(*) FILTER (event_type = 'error') AS errors_total, coalesce(sum(trunc(value)::BIGINT) FILTER (event_type = 'purchase'), 0)::BIGINT AS bytes_uploaded_total, coalesce(sum(trunc(value)::BIGINT) FILTER (event_type = 'view'), 0)::BIGINT AS bytes_downloaded_total FROM samples GROUP BY user_id")
def a7_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.totals(rel.samples(spark, sf_dir))


_A7 = with_sql("samples") + ", a7 AS (SELECT count(*) AS connections_total, count(*) FILTER (event_type = 'signup') - count(*) FILTER (event_type = 'error') AS active_connections, count(*) FILTER (event_type = 'purchase') AS uploads_total, count(*) FILTER (event_type = 'view') AS downloads_total, count(*) FILTER (event_type = 'error') AS deletes_total, count(*) FILTER (event_type = 'click') AS replication_total, count(*) FILTER (event_type = 'error') AS errors_total, coalesce(sum(trunc(value)::BIGINT) FILTER (event_type = 'purchase'), 0)::BIGINT AS bytes_uploaded_total, coalesce(sum(trunc(value)::BIGINT) FILTER (event_type = 'view'), 0)::BIGINT AS bytes_downloaded_total FROM samples)"
_LINES = ", ".join(f"'# HELP store_{m} {t}', '# TYPE store_{m} {k}', 'store_{m} ' || {m}" for m, k, t in counters.METRICS)


@query("s16_exposition", f"{_A7}, l AS (SELECT [{_LINES}] AS a FROM a7) SELECT (unnest(range(1, len(a) + 1)) - 1)::INT AS line_no, unnest(a) AS line FROM l")
def s16_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.exposition(a7_counters(spark, sf_dir))


@query("a10_error_rate", with_sql("samples") + " SELECT user_id, w * 600000000 AS window_end_us, count(*) / 3600.0::DOUBLE AS per_second FROM (SELECT user_id, unnest(range(ts_us // 600000000 + 1, ts_us // 600000000 + 7)) AS w FROM samples WHERE event_type = 'error') GROUP BY ALL")
def a10_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.rates(rel.samples(spark, sf_dir), F.col("event_type") == "error", 3600, 600)


@query("a10_increase", with_sql("samples") + " SELECT user_id, sum(CASE WHEN p IS NULL THEN 0 WHEN k < p THEN k ELSE k - p END)::BIGINT AS increase FROM (SELECT user_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY ts_us) AS p FROM samples) GROUP BY user_id")
def a10_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.increase(rel.samples(spark, sf_dir), "user_id", "ts_us", "k")


@query("a11_alerts", with_sql("samples") + " SELECT user_id, min(ts_us) AS since, max(ts_us) AS until FROM (SELECT *, sum(CASE WHEN k >= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts_us) AS g FROM samples) WHERE k >= 40 GROUP BY user_id, g HAVING max(ts_us) - min(ts_us) >= 3600000000")
def a11_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.alerts(rel.samples(spark, sf_dir), F.col("k") >= 40, 3_600_000_000, "user_id", "ts_us")


@query("t14_partial_gather", with_sql("samples") + " SELECT q.event_id AS request_id, count(r.event_id) AS n_responses FROM samples q JOIN samples r ON q.user_id = r.user_id AND r.ts_us BETWEEN q.ts_us AND q.ts_us + 21600000000 WHERE q.event_type = 'click' AND r.event_type = 'view' GROUP BY 1")
def t14_partial_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    asks = e.where("event_type = 'click'").select(F.col("user_id").alias("id"), F.col("ts").alias("request_ts"), F.col("event_id").alias("request_id"))
    answers = e.where("event_type = 'view'").select(F.col("user_id").alias("response_id"), F.col("ts").alias("response_ts"), F.col("event_id").alias("e"))
    return gather.answered(asks, answers, "INTERVAL 6 HOURS").groupBy("request_id").agg(F.count("e").alias("n_responses"))
