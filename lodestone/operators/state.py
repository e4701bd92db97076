"""Catalogue state folded from the operation log, and its garbage collection.

Last values come from aggregates that combine before the shuffle.  What depends
on the operation before (whether a delete hits a live name, and how many
references a hash has by then) needs order, so the log of a name or hash is cut
into time buckets (``buckets``), over which hot ones spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import joined
from .buckets import DAY_US, with_previous, with_running_sum


def _key() -> Column:
    return F.struct("seq", "op_id")


def effects(ops: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """Puts and deletes with ``prev_op`` and ``prev_hash`` of the name's operation before, and their ``delta`` on ``ref_hash``.

    A put adds one to its hash, whatever the name held before; a delete takes one from the hash that the name
    holds, and none if it holds none.
    """
    log = ops.where(F.col("op").isin("put", "delete"))
    out = with_previous(log, ["name"], ["seq", "op_id"], F.struct("op", "object_hash"), F.floor(F.col("seq") / bucket_us))
    live = F.coalesce(F.col("prev.op") == "put", F.lit(False))
    return out.select(
        "seq", "op_id", "op", "name", "object_hash", "size", "remote_path", "op_ts",
        F.col("prev.op").alias("prev_op"), F.col("prev.object_hash").alias("prev_hash"),
        F.when(F.col("op") == "put", F.col("object_hash")).when(live, F.col("prev.object_hash")).alias("ref_hash"),
        F.when(F.col("op") == "put", 1).when(live, -1).otherwise(0).alias("delta"),
    )


def namespace(ops: DataFrame) -> DataFrame:
    """``name, object_hash, mod_time`` of names whose last operation is a put."""
    last = ops.where(F.col("op").isin("put", "delete")).groupBy("name").agg(F.max_by(F.struct("op", "object_hash", "op_ts"), _key()).alias("x"))
    return last.where("x.op = 'put'").select("name", F.col("x.object_hash").alias("object_hash"), F.col("x.op_ts").alias("mod_time"))


def tombstones(ops: DataFrame) -> DataFrame:
    """``name, deleted_at`` of names whose last operation is a delete, known before or not."""
    last = ops.where(F.col("op").isin("put", "delete")).groupBy("name").agg(F.max_by(F.struct("op", "op_ts"), _key()).alias("x"))
    return last.where("x.op = 'delete'").select("name", F.col("x.op_ts").alias("deleted_at"))


def paths(ops: DataFrame) -> DataFrame:
    """``name, remote_path``: the last non-empty path since the last delete; an empty one clears nothing."""
    log = ops.where(F.col("op").isin("put", "delete"))
    at = log.groupBy("name").agg(F.max(F.when(F.col("op") == "delete", _key())).alias("d"), F.max_by(F.when(F.col("remote_path") != "", F.col("remote_path")), F.when((F.col("op") == "put") & (F.col("remote_path") != ""), _key())).alias("remote_path"), F.max(F.when((F.col("op") == "put") & (F.col("remote_path") != ""), _key())).alias("p"))
    return at.where("p is not null and (d is null or p > d)").select("name", "remote_path")


def object_table(ops: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """``object_hash, size, ref_count``: signed sums of the effects; the size is the first put's since the count was last zero."""
    deltas = effects(ops, bucket_us).where("delta <> 0")
    run = with_running_sum(deltas, ["ref_hash"], ["seq", "op_id"], F.col("delta"), F.floor(F.col("seq") / bucket_us))
    born = F.when((F.col("op") == "put") & (F.col("after") == 1), _key())
    out = run.groupBy("ref_hash").agg(F.max_by("size", born).alias("size"), F.sum("delta").alias("ref_count")).where("ref_count > 0")
    return out.select(F.col("ref_hash").alias("object_hash"), "size", "ref_count")


def ref_counts(ops: DataFrame) -> DataFrame:
    """``object_hash, ref_count, live_refs``: the leaking count of the store, and the names that really hold the hash."""
    refs = effects(ops).where("delta <> 0").groupBy(F.col("ref_hash").alias("object_hash")).agg(F.sum("delta").alias("ref_count"))
    live = namespace(ops).groupBy("object_hash").agg(F.count(F.lit(1)).alias("live_refs"))
    return refs.join(live, "object_hash", "left").select("object_hash", "ref_count", F.coalesce("live_refs", F.lit(0)).alias("live_refs"))


def with_remote_tombstones(ops: DataFrame) -> DataFrame:
    """``name, live_hash, deleted_at`` after all operations, tombstones from peers included.

    A peer's tombstone does nothing if the name's own is as new, else it replaces it and ends even a newer
    object.  Between two puts or deletes only the greatest tombstone counts, so the last segment of a name's
    log settles its state: a put's object lives on only if no tombstone above zero follows.
    """
    own = ops.where(F.col("op").isin("put", "delete")).groupBy("name").agg(F.max(_key()).alias("k"), F.max_by(F.struct("op", "object_hash", "op_ts"), _key()).alias("x"))
    remote = ops.where("op = 'apply_tombstone'").join(own.select("name", "k"), "name", "left").where(F.col("k").isNull() | (_key() > F.col("k"))).groupBy("name").agg(F.max("op_ts").alias("t"))
    both = own.join(remote, "name", "full")
    mine = F.coalesce(F.when(F.col("x.op") == "delete", F.col("x.op_ts")), F.lit(0))
    at = F.greatest(mine, F.coalesce("t", F.lit(0)))
    return both.select("name", F.when((F.col("x.op") == "put") & (at <= 0), F.col("x.object_hash")).alias("live_hash"), at.alias("deleted_at"))


def orphans(objects: DataFrame) -> DataFrame:
    """Rows that a sweep removes: no references left; rows of the old layout (null count) stay."""
    return objects.where("ref_count is not null and ref_count <= 0")


def expired(tombs: DataFrame, now_ns: int, retention_ns: int) -> DataFrame:
    """Tombstones strictly older than the retention, and malformed (null) ones."""
    return tombs.where(F.col("deleted_at").isNull() | (F.col("deleted_at") < now_ns - retention_ns))


def catalog_scan(ns: DataFrame, tombs: DataFrame, objects: DataFrame, path: DataFrame, strict: bool = False) -> DataFrame:
    """Names with size, path and time; a missing object has size 0, or no row in the strict form that single lookups use."""
    out = ns.join(tombs.select("name"), "name", "left_anti").join(objects.select("object_hash", "size"), "object_hash", "inner" if strict else "left").join(path, "name", "left")
    return out.select("name", "object_hash", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("remote_path", F.lit("")).alias("remote_path"), F.coalesce("mod_time", F.lit(0)).alias("mod_time"))


def has(objects: DataFrame, hashes: DataFrame) -> DataFrame:
    """``object_hash, found`` for each asked hash; any row counts, whatever its references."""
    known = objects.select("object_hash").distinct().withColumn("__f", F.lit(True))
    return hashes.join(known, "object_hash", "left").select("object_hash", F.coalesce("__f", F.lit(False)).alias("found"))


def copy_objects(ns: DataFrame, requests: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Puts for ``requests(source, target)``: the target becomes an alias of the source's hash.

    Each adds a reference (``delta``) to it, which belongs into the log like any put; headers ``(name, headers)``
    go along.
    """
    out = requests.join(ns.withColumnRenamed("name", "source"), "source").withColumns({"op": F.lit("put"), "delta": F.lit(1)})
    if headers is None:
        return out.select(F.col("target").alias("name"), "object_hash", "op", "delta")
    return out.join(headers.withColumnRenamed("name", "source"), "source", "left").select(F.col("target").alias("name"), "object_hash", "op", "delta", "headers")


def open_uploads(started: DataFrame, ended: DataFrame) -> DataFrame:
    """Uploads that no completion and no abort has ended."""
    return started.join(ended.select("upload_id"), "upload_id", "left_anti")


def bucket_status(verb: Column, bucket: Column, own: str, empty: Column) -> Column:
    """The HTTP status of a request on a bucket: there is one; it is deleted only while no object is listed."""
    mine = bucket == own
    return F.when(~mine, 404).when((verb == "DELETE") & ~empty, 409).when(verb == "DELETE", 204).otherwise(200)


def delete_batch(keys: DataFrame) -> DataFrame:
    """Each key's status: unsafe ones are refused, all others count as deleted, known or not."""
    bad = F.contains("name", F.lit("..")) | F.contains("name", F.lit("\\"))
    return keys.select("name", F.when(bad, "InvalidArgument").otherwise("Deleted").alias("status"))


def dedup_decision(uploads: DataFrame, ns: DataFrame, objects: DataFrame) -> DataFrame:
    """``skip`` where the hash is stored and the name holds it already; then no content is read."""
    known = objects.select("object_hash").distinct().withColumn("__k", F.lit(True))
    same = ns.select("name", "object_hash").withColumn("__s", F.lit(True))
    out = uploads.join(known, "object_hash", "left").join(same, ["name", "object_hash"], "left")
    return out.select("name", "object_hash", F.coalesce(F.col("__k") & F.col("__s"), F.lit(False)).alias("skip"))


def verified(uploads: DataFrame) -> DataFrame:
    """``accepted``: the content has the declared hash."""
    return uploads.withColumn("accepted", F.sha2("content", 256) == F.col("object_hash"))


def allocate(blobs: DataFrame, seq: str = "seq") -> DataFrame:
    """``object_hash, offset, length`` of a bump allocator in order of first appearance.

    The blobs are dealt in ranges of the order, of about equal rows, to tasks; running sums run inside a task, and
    one row for each task carries the offset on.
    """
    first = blobs.groupBy("object_hash").agg(F.min(F.struct(seq, "length")).alias("x")).select("object_hash", F.col(f"x.{seq}").alias("seq"), F.col("x.length").alias("length"))
    dealt = first.repartitionByRange("seq", "object_hash").withColumn("b", F.spark_partition_id())
    inner = Window.partitionBy("b").orderBy("seq", "object_hash").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("b").agg(F.sum("length").alias("n"), F.min(F.struct("seq", "object_hash")).alias("least"), F.max(F.struct("seq", "object_hash")).alias("most"))
    base = sums.select("least", "most", F.coalesce(F.sum("n").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row for each task
    rows = dealt.withColumns({"o": F.coalesce(F.sum("length").over(inner), F.lit(0)), "k": F.struct("seq", "object_hash")})
    return rows.join(F.broadcast(base), F.col("k").between(F.col("least"), F.col("most"))).select("object_hash", (F.col("base") + F.col("o")).alias("offset"), "length")


def next_offset(alloc: DataFrame) -> DataFrame:
    """Where a restarted allocator goes on: after all rows of positive offset and length."""
    return alloc.agg(F.coalesce(F.max(F.when((F.col("offset") > 0) & (F.col("length") > 0), F.col("offset") + F.col("length"))), F.lit(0)).alias("next_offset"))


def multipart(parts: DataFrame) -> DataFrame:
    """``upload_id, n_parts, size, object_hash`` of completed uploads: parts by number, repeated numbers all kept."""
    rows = parts.groupBy("upload_id").agg(F.sort_array(F.collect_list(F.struct("part_number", "arrival", "data"))).alias("p"))  # an upload has at most 10,000 parts
    whole = joined(F.transform("p", lambda x: x["data"]))
    return rows.select("upload_id", F.size("p").alias("n_parts"), F.octet_length(whole).cast("bigint").alias("size"), F.sha2(whole, 256).alias("object_hash"))


def list_parts(parts: DataFrame) -> DataFrame:
    return parts.select("upload_id", "part_number", F.sha2("data", 256).alias("etag"), F.octet_length("data").cast("bigint").alias("size"))
