"""Blob sources and sinks by backend, optionally encrypted; the key of a blob stays the hash of its plain content.

``files`` reads a folder of one file for each blob, on any Hadoop file system
(local, NFS or ``s3a://``).  Writing packs blobs into Parquet files partitioned
by the first two digits of their hash: one file for each blob doesn't scale,
and Spark's commit protocol makes a write whole or void.  ``raw`` packs all
blobs of a device into one allocation table and chunks of bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto
from ..operators import state


class PackedBlobs:
    """``object_hash, content`` below a folder."""

    def __init__(self, root: str, key: bytes | None = None):
        self.root, self.key = root.rstrip("/"), key

    def write(self, blobs: DataFrame, mode: str = "append") -> None:
        """Each hash once; those that are there already are skipped."""
        content = crypto.encrypt(F.col("content"), self.key) if self.key else F.col("content")
        spark = blobs.sparkSession
        new = blobs.dropDuplicates(["object_hash"])
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        if mode == "append" and where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            new = new.join(spark.read.schema("object_hash string, shard string").parquet(self.root).select("object_hash"), "object_hash", "left_anti")
        out = new.select("object_hash", content.alias("content"), F.substring("object_hash", 1, 2).alias("shard"))
        out.write.mode(mode).partitionBy("shard").parquet(self.root)

    def read(self, spark: SparkSession) -> DataFrame:
        content = crypto.decrypt(F.col("content"), self.key) if self.key else F.col("content")
        return spark.read.schema("object_hash string, content binary, shard string").parquet(self.root).select("object_hash", content.alias("content"))

    def get(self, spark: SparkSession, hashes: DataFrame) -> DataFrame:
        """Blobs of the given hashes; their shards prune the scan."""
        wanted = hashes.select("object_hash", F.substring("object_hash", 1, 2).alias("shard")).distinct()
        stored = spark.read.schema("object_hash string, content binary, shard string").parquet(self.root)
        content = crypto.decrypt(F.col("content"), self.key) if self.key else F.col("content")
        return stored.join(wanted, ["shard", "object_hash"], "left_semi").select("object_hash", content.alias("content"))


class RawBlobs:
    """A device image: ``object_hash, offset, length`` and the bytes behind them, one row for each blob in offset order."""

    def __init__(self, root: str, key: bytes | None = None):
        self.root, self.key = root.rstrip("/"), key

    def write(self, blobs: DataFrame, mode: str = "errorifexists") -> None:
        """``blobs(seq, object_hash, content)``: space is given in order of first appearance and never reclaimed."""
        content = crypto.encrypt(F.col("content"), self.key) if self.key else F.col("content")
        packed = blobs.select("seq", "object_hash", content.alias("content"), F.octet_length(content).cast("bigint").alias("length"))
        table = state.allocate(packed.select("seq", "object_hash", "length"))
        table.write.mode(mode).parquet(f"{self.root}/alloc")
        first = packed.groupBy("object_hash").agg(F.min_by("content", "seq").alias("content"))
        table = blobs.sparkSession.read.parquet(f"{self.root}/alloc")
        first.join(table, "object_hash").repartitionByRange("offset").sortWithinPartitions("offset").select("offset", "content").write.mode(mode).parquet(f"{self.root}/device")

    def read(self, spark: SparkSession) -> DataFrame:
        table, device = spark.read.parquet(f"{self.root}/alloc"), spark.read.parquet(f"{self.root}/device")
        raw = F.substring(F.col("content"), F.lit(1), F.col("length").cast("int"))
        content = crypto.decrypt(raw, self.key) if self.key else raw
        return table.join(device, "offset").select("object_hash", content.alias("content"))


def files(spark: SparkSession, root: str) -> DataFrame:
    """One blob for each file below ``root``; its name is its hash."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("object_hash"), "content")


REGISTRY = {"local": PackedBlobs, "nfs": PackedBlobs, "s3": PackedBlobs, "raw": RawBlobs}


def store(backend: str, root: str, key: bytes | None = None) -> PackedBlobs | RawBlobs:
    """The store of a backend; with a key its content is encrypted."""
    if backend not in REGISTRY:
        raise ValueError(f"unknown storage backend {backend}")
    return REGISTRY[backend](root, key)
