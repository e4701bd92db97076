"""Listing pages: prefix filter, delimiter groups, keyset paging, and the XML of their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import MAX_HASH, MAX_NAME, last_modified_iso, xml_escape

PAGE = 1000


def listable(catalog: DataFrame) -> DataFrame:
    """Rows whose name and hash fit into a listing."""
    return catalog.where((F.octet_length("name") <= MAX_NAME) & (F.octet_length("object_hash") <= MAX_HASH))


def elements(catalog: DataFrame, prefix: str = "", delimiter: str = "", after: tuple[str, str] | None = None) -> DataFrame:
    """What a page is cut from: ``kind`` K with its row, or P for all names that share a prefix up to the delimiter.

    ``after`` resumes behind a key (``("K", key)``) or behind a whole prefix (``("P", prefix)``).  The prefix and
    the resume key are plain comparisons of the name, so they reach the scan.
    """
    rows = listable(catalog)
    if prefix:
        rows = rows.where(F.startswith("name", F.lit(prefix)))
    if after:
        kind, key = after
        rows = rows.where(F.col("name") > key) if kind == "K" else rows.where((F.col("name") >= key) & ~F.startswith("name", F.lit(key)))
    if not delimiter:
        return rows.select(F.lit("K").alias("kind"), F.col("name").alias("key"), "name", "object_hash", "size", "mod_time")
    at = F.locate(delimiter, F.substring("name", len(prefix) + 1, MAX_NAME))
    group = F.when(at > 0, F.substring(F.col("name"), F.lit(1), F.lit(len(prefix)) + at))
    grouped = rows.withColumns({"kind": F.when(group.isNotNull(), "P").otherwise("K"), "key": F.coalesce(group, F.col("name"))})
    first = F.min(F.struct("name", "object_hash", "size", "mod_time")).alias("x")
    out = grouped.groupBy("kind", "key").agg(first)
    plain = lambda c: F.when(F.col("kind") == "K", F.col(f"x.{c}")).alias(c)
    return out.select("kind", "key", F.col("x.name").alias("name"), plain("object_hash"), plain("size"), plain("mod_time"))


def page(catalog: DataFrame, prefix: str = "", delimiter: str = "", after: tuple[str, str] | None = None, max_keys: int = PAGE) -> DataFrame:
    """Up to ``max_keys`` elements in order of name, with ``truncated`` on each: whether another one follows.

    The limit turns into a top-n over the partitions; at most ``max_keys + 1`` rows meet in one task.
    """
    n = max_keys if 0 < max_keys <= PAGE else PAGE
    top = elements(catalog, prefix, delimiter, after).orderBy("name").limit(n + 1)
    rows = F.sort_array(F.collect_list(F.struct("name", "kind", "key", "object_hash", "size", "mod_time")))
    held = top.agg(rows.alias("r")).select((F.size("r") > n).alias("truncated"), F.posexplode(F.slice("r", 1, n)).alias("pos", "x"))
    return held.select((F.col("pos") + 1).alias("rank"), "x.kind", "x.key", "x.object_hash", "x.size", "x.mod_time", "truncated")


def summary(listed: DataFrame) -> DataFrame:
    """One row: counts, truncation and the token to resume from."""
    last = F.max_by(F.struct("kind", "key"), "rank")
    return listed.agg(
        F.count(F.lit(1)).alias("key_count"), F.count_if(F.col("kind") == "K").alias("contents"), F.count_if(F.col("kind") == "P").alias("prefixes"),
        F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"), last.alias("x"),
    ).select("key_count", "contents", "prefixes", "truncated", F.when(F.col("truncated"), F.base64(F.concat("x.kind", "x.key").cast("binary"))).alias("token"))


def page_xml(listed: DataFrame) -> DataFrame:
    """``rank, xml``: one element of the answer for each row."""
    content = F.concat(F.lit("<Contents><Key>"), xml_escape(F.col("key")), F.lit("</Key><LastModified>"), last_modified_iso(F.col("mod_time")), F.lit("</LastModified><ETag>&quot;"), "object_hash", F.lit("&quot;</ETag><Size>"), F.col("size").cast("string"), F.lit("</Size><StorageClass>STANDARD</StorageClass></Contents>"))
    group = F.concat(F.lit("<CommonPrefixes><Prefix>"), xml_escape(F.col("key")), F.lit("</Prefix></CommonPrefixes>"))
    return listed.select("rank", F.when(F.col("kind") == "K", content).otherwise(group).alias("xml"))


def tag(name: str, *inside: Column | str) -> Column:
    """An XML element of columns and text."""
    return F.concat(F.lit(f"<{name}>"), *(F.lit(x) if isinstance(x, str) else x for x in inside), F.lit(f"</{name}>"))


def error_xml(code: Column, message: Column, resource: Column) -> Column:
    return tag("Error", tag("Code", xml_escape(code)), tag("Message", xml_escape(message)), tag("Resource", xml_escape(resource)))


def delete_result_xml(status: Column, key: Column) -> Column:
    """One key's element in a batch delete's answer."""
    return F.when(status == "Deleted", tag("Deleted", tag("Key", xml_escape(key)))).otherwise(tag("Error", tag("Key", xml_escape(key)), tag("Code", status)))


def buckets_xml(bucket: Column, created_ns: Column) -> Column:
    return tag("ListAllMyBucketsResult", tag("Buckets", tag("Bucket", tag("Name", xml_escape(bucket)), tag("CreationDate", last_modified_iso(created_ns)))))


def location_xml(region: Column) -> Column:
    return tag("LocationConstraint", xml_escape(region))


def copy_result_xml(object_hash: Column, mod_ns: Column) -> Column:
    return tag("CopyObjectResult", tag("LastModified", last_modified_iso(mod_ns)), tag("ETag", "&quot;", object_hash, "&quot;"))


def initiate_xml(bucket: Column, key: Column, upload_id: Column) -> Column:
    return tag("InitiateMultipartUploadResult", tag("Bucket", xml_escape(bucket)), tag("Key", xml_escape(key)), tag("UploadId", xml_escape(upload_id)))


def complete_xml(bucket: Column, key: Column, object_hash: Column) -> Column:
    return tag("CompleteMultipartUploadResult", tag("Bucket", xml_escape(bucket)), tag("Key", xml_escape(key)), tag("ETag", "&quot;", object_hash, "&quot;"))


def part_xml(part_number: Column, etag: Column, size: Column) -> Column:
    return tag("Part", tag("PartNumber", part_number.cast("string")), tag("ETag", "&quot;", etag, "&quot;"), tag("Size", size.cast("string")))


def upload_xml(key: Column, upload_id: Column, created_ns: Column) -> Column:
    return tag("Upload", tag("Key", xml_escape(key)), tag("UploadId", xml_escape(upload_id)), tag("Initiated", last_modified_iso(created_ns)))


def deleted_keys(bodies: DataFrame, body: str = "body", most: int = 1000) -> DataFrame:
    """Keys of batch-delete bodies (``request_id, key``): at most 1 MiB and 1000 keys, blanks trimmed, empty ones dropped."""
    keys = F.xpath(F.col(body), F.lit("Delete/Object/Key/text()"))
    rows = bodies.where(F.octet_length(body) <= 1 << 20).select("request_id", keys.alias("k")).where(F.size("k") <= most)
    return rows.select("request_id", F.explode("k").alias("key")).select("request_id", F.trim("key").alias("key")).where("key <> ''")
