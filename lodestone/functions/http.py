"""HTTP predicates: byte ranges, entity tags, conditional requests and clock skew."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SKEW_S, PRESIGN_MAX_S = 900, 86_400


def parse_range(header: Column, size: Column) -> Column:
    """A struct ``start, end, serve, unsatisfiable`` for a single range; other units and lists serve the whole."""
    h = F.trim(header)
    spec = F.substring(h, 7, 1 << 20)
    a, b = F.trim(F.substring_index(spec, "-", 1)), F.trim(F.regexp_replace(spec, r"^[^-]*-", ""))
    # the reference's integers have 63 bits: up to 2^62 - 1
    number = lambda x: F.when(x.rlike(r"^[+-]?[0-9]+$") & x.try_cast("bigint").between(0, (1 << 62) - 1), x.try_cast("bigint"))
    start, end = number(a), number(b)
    ignored = h.isNull() | ~F.startswith(h, F.lit("bytes=")) | F.contains(spec, F.lit(",")) | ~F.contains(spec, F.lit("-"))
    zero = F.lit(0).cast("bigint")

    def made(s: Column, e: Column, serve: bool, bad: bool) -> Column:
        return F.struct(s.cast("bigint").alias("start"), e.cast("bigint").alias("end"), F.lit(serve).alias("serve"), F.lit(bad).alias("unsatisfiable"))

    no = made(zero, zero, False, True)
    return (
        F.when(ignored, made(zero, zero, False, False))
        .when((a == "") & (b == ""), no)
        .when((a == "") & (end.isNull() | (end == 0) | (size == 0)), no)
        .when(a == "", made(size - F.least(end, size), size - 1, True, False))
        .when((b == "") & (start.isNull() | (size == 0) | (start >= size)), no)
        .when(b == "", made(start, size - 1, True, False))
        .when(start.isNull() | end.isNull() | (start >= size) | (start > end), no)
        .otherwise(made(start, F.least(end, size - 1), True, False))
    )


def slice_bytes(content: Column, span: Column) -> Column:
    """The bytes that a parsed range serves; all of them if it serves none in part."""
    return F.when(span["serve"], F.substring(content, (span["start"] + 1).cast("int"), (span["end"] - span["start"] + 1).cast("int"))).when(~span["unsatisfiable"], content)


def etag_matches(header: Column, etag: Column) -> Column:
    """Any tag of the list, weak or not, quoted or not; ``*`` matches all."""
    bare = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), "^W/", "")), '^"+|"+$', "")
    return F.exists(F.split(header, ",", -1), lambda x: (F.trim(x) == "*") | (bare(x) == etag))


def http_seconds(s: Column) -> Column:
    """Unix seconds of an IMF date; null for anything else."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(s, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'")))


def conditional_status(if_match: Column, if_none_match: Column, if_modified_since: Column, etag: Column, mod_ns: Column) -> Column:
    """412, 304 or 200, in the order of the conditions; times count by whole seconds."""
    given = lambda c: c.isNotNull() & (c != "")
    since = http_seconds(if_modified_since)
    fresh = F.call_function("div", mod_ns, F.lit(1_000_000_000)) <= since
    return (
        F.when(given(if_match) & ~etag_matches(if_match, etag), 412)
        .when(given(if_none_match), F.when(etag_matches(if_none_match, etag), 304).otherwise(200))
        .when(since.isNotNull() & fresh, 304)
        .otherwise(200)
    )


def if_range_matches(value: Column, etag: Column, mod_ns: Column) -> Column:
    """A tag that matches, or a date not before the object's time."""
    v = F.trim(value)
    tag = F.startswith(v, F.lit('"')) | F.startswith(v, F.lit("W/"))
    at = http_seconds(v)
    return F.when(tag, etag_matches(v, etag)).otherwise(F.coalesce(mod_ns <= at * 1_000_000_000, F.lit(False)))


def within_skew(stamp: Column, now_s: Column) -> Column:
    """An ISO basic stamp at most 15 minutes away from ``now_s``."""
    at = F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'")))
    return F.coalesce(F.abs(at - now_s) <= SKEW_S, F.lit(False))


def presign_valid(stamp: Column, expires: Column, now_s: Column) -> Column:
    """A presigned request: lifetime in (0, 86400], not yet over, and not from beyond the skew."""
    at = F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'")))
    ttl = expires.try_cast("bigint")
    return F.coalesce((ttl > 0) & (ttl <= PRESIGN_MAX_S) & (now_s <= at + ttl) & (at <= now_s + SKEW_S), F.lit(False))


def handshake_fresh(stamp_ns: Column, now_ns: Column) -> Column:
    return F.coalesce(F.abs(stamp_ns - now_ns) <= SKEW_S * 1_000_000_000, F.lit(False))
