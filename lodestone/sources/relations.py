"""Relations of the object catalogue, derived from the driver's tables.

Names, hashes, sizes and times are columns of ordinary DataFrames; times are
nanoseconds in a long, 0 for unknown.  Content stays in a relation of its own,
so lookups of metadata never read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_NS = 1_700_000_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id, weight, decl_order``: one node for each supplier, weight 0 to 3."""
    key = F.col("s_suppkey").cast("bigint")
    return table(spark, sf_dir, "supplier").select(key.alias("node_id"), (key % 4).cast("int").alias("weight"), key.alias("decl_order"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, object_hash, size, remote_path, mod_time``: copies of a text are aliases of one object."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string")).alias("name"),
        F.sha2(text, 256).alias("object_hash"),
        F.octet_length(text).cast("bigint").alias("size"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("vault/"), "lang")).alias("remote_path"),
        (F.lit(EPOCH_NS) + F.col("doc_id") * 1_000_000_007).alias("mod_time"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``object_hash, content``."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(F.sha2(text, 256).alias("object_hash"), text.cast("binary").alias("content"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ts_us, user_id, event_type, value, k`` of all events."""
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def object_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation log ``seq, op_id, op, name, object_hash, size, remote_path, op_ts``.

    Purchases and sign-ups put, errors delete, every fifth view brings a tombstone of six hours before.
    """
    e = samples(spark, sf_dir)
    op = F.when(F.col("event_type").isin("purchase", "signup"), "put").when(F.col("event_type") == "error", "delete").when((F.col("event_type") == "view") & (F.col("k") % 5 == 0), "apply_tombstone")
    late = F.when(F.col("event_type") == "view", F.lit(6 * 3600 * 1_000_000)).otherwise(F.lit(0))
    return e.select(
        F.col("ts_us").alias("seq"),
        F.col("event_id").alias("op_id"),
        op.alias("op"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("k") % 8).cast("string")).alias("name"),
        F.sha2((F.col("k") % 16).cast("string"), 256).alias("object_hash"),
        (100 + F.col("k") % 16 * 10).alias("size"),
        F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("k") % 3).cast("string"))).alias("remote_path"),
        ((F.col("ts_us") - late) * 1000).alias("op_ts"),
    ).where("op is not null")


# The same relations for DuckDB.
SQL = {
    "nodes": "nodes AS (SELECT s_suppkey::BIGINT AS node_id, (s_suppkey % 4)::INT AS weight, s_suppkey::BIGINT AS decl_order FROM supplier)",
    "objects": f"objects AS (SELECT source || '/' || lang || '/doc-' || doc_id AS name, sha256(coalesce(text, '')) AS object_hash, octet_length(encode(coalesce(text, '')))::BIGINT AS size, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'vault/' || lang END AS remote_path, {EPOCH_NS} + doc_id * 1000000007 AS mod_time FROM documents)",
    "samples": "samples AS (SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, (props->>'$.k')::BIGINT AS k FROM events)",
    "ops": "ops AS (SELECT * FROM (SELECT ts_us AS seq, event_id AS op_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'put' WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'view' AND k % 5 = 0 THEN 'apply_tombstone' END AS op, 'u' || user_id || '/' || (k % 8) AS name, sha256((k % 16)::VARCHAR) AS object_hash, 100 + k % 16 * 10 AS size, CASE WHEN k % 3 = 0 THEN '' ELSE 'p' || (k % 3) END AS remote_path, (ts_us - CASE WHEN event_type = 'view' THEN 21600000000 ELSE 0 END) * 1000 AS op_ts FROM samples) WHERE op IS NOT NULL)",
}


def with_sql(*names: str) -> str:
    """A WITH clause for the named relations."""
    wanted = [n for n in SQL if n in names or n == "samples" and "ops" in names]
    return "WITH " + ", ".join(SQL[n] for n in wanted)
