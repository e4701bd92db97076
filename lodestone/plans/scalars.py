"""Queries of scalar functions, codecs, HTTP predicates and cryptography over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunked, codecs, crypto, http, oprf, strings
from ..operators import listing, placement
from ..sources import relations as rel
from ..sources.relations import with_sql
from .registry import query

KEY = bytes(range(32))
MAGIC = b"LODEENV1"


@query("f1_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def f1_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "documents").select("doc_id", crypto.sha256(F.coalesce("text", F.lit(""))).alias("digest"))


@query("f2_sanitize", "SELECT doc_id, sha256(regexp_replace(text, '[\\x00-\\x08\\x0A-\\x1F]', '_', 'g')) AS clean FROM documents")
def f2_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "documents").select("doc_id", F.sha2(strings.sanitize_log(F.col("text")), 256).alias("clean"))


_RAW = "CASE page_id % 8 WHEN 0 THEN '/' || url || '//x' WHEN 1 THEN url || '/../etc' WHEN 2 THEN './' || url WHEN 3 THEN url || chr(92) WHEN 4 THEN '  ' || url || '  ' WHEN 5 THEN chr(8195) || url || '/' || chr(9) || '/' || chr(160) || chr(8232) || '/b c' || chr(12288) WHEN 6 THEN chr(9) || '/' || chr(133) ELSE '//' END"
_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query("f3_normalize_path", f"""SELECT page_id, CASE WHEN bad THEN NULL ELSE array_to_string(kept, '/') END AS path, CASE WHEN bad THEN 'EINVAL' END AS error FROM (SELECT page_id, contains(t, chr(92)) OR list_contains(parts, '..') OR len(kept) = 0 AS bad, kept FROM (SELECT page_id, t, string_split(t, '/') AS parts, list_filter(string_split(t, '/'), lambda x: x <> '.' AND NOT regexp_full_match(x, '{_SPACE}*')) AS kept FROM (SELECT page_id, regexp_replace(regexp_replace({_RAW}, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS t FROM pages)))""")
def f3_normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k = F.col("url"), F.col("page_id") % 8
    raw = F.when(k == 0, F.concat(F.lit("/"), u, F.lit("//x"))).when(k == 1, F.concat(u, F.lit("/../etc"))).when(k == 2, F.concat(F.lit("./"), u)).when(k == 3, F.concat(u, F.lit("\\"))).when(k == 4, F.concat(F.lit("  "), u, F.lit("  ")))
    raw = raw.when(k == 5, F.concat(F.lit("\u2003"), u, F.lit("/\t/\xa0\u2028/b c\u3000"))).when(k == 6, "\t/\x85").otherwise("//")
    return rel.table(spark, sf_dir, "pages").select("page_id", strings.normalize_path(raw).alias("x")).select("page_id", "x.path", "x.error")


@query("f4_f6_padding", "SELECT o_orderkey, hex(encode(o_orderpriority)) || repeat('00', 16 - octet_length(encode(o_orderpriority))) AS padded, o_orderpriority AS back, hex(encode(o_orderkey::VARCHAR)) || repeat('00', 20 - len(o_orderkey::VARCHAR)) AS padded_int FROM orders")
def f4_f6_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = strings.pad(F.col("o_orderpriority"), 16)
    return rel.table(spark, sf_dir, "orders").select("o_orderkey", F.hex(p).alias("padded"), strings.cut_at_null(F.decode(p, "UTF-8")).alias("back"), F.hex(strings.pad_int(F.col("o_orderkey"), 20)).alias("padded_int"))


@query("f7_parse_int", "SELECT event_id, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN try_cast(s AS BIGINT) END AS parsed FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '-' || event_id WHEN 1 THEN '+' || event_id WHEN 2 THEN event_id || 'x' WHEN 3 THEN event_id || '99999999999999999999' ELSE '' END AS s FROM events)")
def f7_parse_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("event_id").cast("string"), F.col("event_id") % 5
    s = F.when(k == 0, F.concat(F.lit("-"), e)).when(k == 1, F.concat(F.lit("+"), e)).when(k == 2, F.concat(e, F.lit("x"))).when(k == 3, F.concat(e, F.lit("99999999999999999999"))).otherwise("")
    return rel.table(spark, sf_dir, "events").select("event_id", strings.parse_int(s).alias("parsed"))


@query("f8_crlf", "SELECT doc_id, sha256(replace(replace(text, chr(13), ' '), chr(10), ' ')) AS flat FROM documents")
def f8_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "documents").select("doc_id", F.sha2(strings.replace_crlf(F.col("text")), 256).alias("flat"))


@query("f9_xml_escape", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped FROM pages")
def f9_xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "pages").select("page_id", F.sha2(strings.xml_escape(F.col("html")), 256).alias("escaped"))


_CUT = "list_aggregate(list_filter([octet_length(encode(text[:n])) <= 1024 FOR n IN range(0, 1025)], lambda x: x), 'count')"


@query("f8_clean_header", f"SELECT doc_id, sha256(trim(replace(replace(CASE WHEN octet_length(encode(text)) > 1024 THEN text[:{_CUT} - 1] ELSE text END, chr(13), ' '), chr(10), ' '), ' ' || chr(9) || chr(11) || chr(12) || chr(160) || chr(133) || chr(12288))) AS clean FROM documents WHERE text IS NOT NULL")
def f8_clean_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(strings.clean_header(F.col("text")), 256).alias("clean"))


@query("f9_error_codes", "SELECT o_orderkey, CASE s WHEN 400 THEN 'InvalidArgument' WHEN 403 THEN 'AccessDenied' WHEN 404 THEN 'NoSuchKey' WHEN 405 THEN 'MethodNotAllowed' WHEN 409 THEN 'BucketNotEmpty' WHEN 413 THEN 'EntityTooLarge' WHEN 415 THEN 'InvalidRequest' WHEN 503 THEN 'ServiceUnavailable' ELSE 'InternalError' END AS code FROM (SELECT o_orderkey, 400 + o_orderkey % 110 AS s FROM orders)")
def f9_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "orders").select("o_orderkey", strings.error_code(F.col("o_orderkey") % 110 + 400).alias("code"))


@query("f10_last_modified", with_sql("objects") + " SELECT name, strftime(make_timestamp(mod_time // 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, strftime(make_timestamp(mod_time // 1000), '%a, %d %b %Y %H:%M:%S GMT') AS http_date FROM objects")
def f10_last_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.objects(spark, sf_dir).select("name", strings.last_modified_iso(F.col("mod_time")).alias("iso"), strings.last_modified_http(F.col("mod_time")).alias("http_date"))


_URL = "regexp_extract(url, '://([^/?#]*)', 1) AS h, regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1) AS p"


@query("f11_bucket_key", f"SELECT page_id, string_split(t, '/')[1] AS bucket, CASE WHEN contains(t, '/') THEN t[position('/' IN t) + 1:] ELSE '' END AS key FROM (SELECT page_id, trim(p, '/') AS t FROM (SELECT page_id, {_URL} FROM pages))")
def f11_bucket_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://[^/?#]*(/[^?#]*)", 1)
    return rel.table(spark, sf_dir, "pages").select("page_id", strings.split_bucket(host, path).alias("x")).select("page_id", "x.bucket", "x.key")


@query("f12_tokens", with_sql("objects") + " SELECT name, to_base64(encode('K' || name)) AS token, 'K' AS kind, name AS key FROM objects")
def f12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rel.objects(spark, sf_dir).select("name", strings.encode_token(F.lit("K"), F.col("name")).alias("token"))
    return t.withColumn("x", strings.decode_token(F.col("token"))).select("name", "token", "x.kind", "x.key")


@query("f13_f14_headers", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS n_kept, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 501 ELSE 400 END AS status FROM events")
def f13_f14_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    sse = F.when(k == 1, "AES256").when(k == 2, "aws:kms").when(k == 3, "rot13").otherwise("")
    h = F.create_map(F.lit("X-Amz-Meta-K"), F.get_json_object("props", "$.k"), F.lit("Host"), F.lit("h"), F.lit("X-Amz-Server-Side-Encryption"), F.when(k % 2 == 0, "").otherwise(sse))
    full = F.transform_keys(F.create_map(F.lit("X-Amz-Server-Side-Encryption"), sse), lambda a, _: F.lower(a))
    return rel.table(spark, sf_dir, "events").select("event_id", F.size(strings.collect_headers(h)).alias("n_kept"), strings.sse_status(full).alias("status"))


@query("s15_header_json", "SELECT event_id, props->>'$.k' AS k FROM events")
def s15_header_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "events").select("event_id", F.try_element_at(strings.headers_from_json(F.col("props")), F.lit("k")).alias("k"))


@query("m12_last_headers", with_sql("samples") + " SELECT user_id, arg_max(k, (ts_us, event_id)) AS k FROM samples GROUP BY user_id")
def m12_last_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.table(spark, sf_dir, "events").withColumn("h", strings.headers_from_json(F.col("props"))).where(F.size("h") > 0)
    last = e.groupBy("user_id").agg(F.max_by(F.to_json("h"), F.struct("ts", "event_id")).alias("j"))
    return last.select("user_id", F.try_element_at(strings.headers_from_json(F.col("j")), F.lit("k")).cast("bigint").alias("k"))


@query("f29_f30_codes", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE [o_orderkey + 5000000000, 7] END AS ints, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 10)::INT ELSE 76 END AS mode FROM orders")
def f29_f30_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 3, "1,x").otherwise(F.concat(F.lit(" "), (k + 5_000_000_000).cast("string"), F.lit(", ,\t7")))
    code = F.when(k % 2 == 0, (k % 10).cast("string")).otherwise("L")
    return rel.table(spark, sf_dir, "orders").select("o_orderkey", strings.csv_ints(text).alias("ints"), strings.mode_byte(code).cast("int").alias("mode"))


@query("p2_row_limits", with_sql("objects") + " SELECT name FROM (SELECT repeat(name, 1 + size % 4) AS name FROM objects) WHERE octet_length(encode(name)) <= 64")
def p2_row_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose name or hash is too long to be listed are left out."""
    long = F.expr("repeat(name, cast(1 + size % 4 as int))").alias("name")
    return listing.listable(rel.objects(spark, sf_dir).select(long, "object_hash")).select("name")


@query("p1_prefix", with_sql("objects") + " SELECT name, size FROM objects WHERE starts_with(name, 'src2/')")
def p1_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.objects(spark, sf_dir).where(F.startswith("name", F.lit("src2/"))).select("name", "size")


@query("p4_traversal", "SELECT page_id, contains(url, '/') OR contains(url, chr(92)) OR url = '..' AS has_chars, contains(url, '..') OR contains(url, chr(92)) AS unsafe FROM pages")
def p4_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return rel.table(spark, sf_dir, "pages").select("page_id", strings.has_traversal_chars(u).alias("has_chars"), strings.is_unsafe_key(u).alias("unsafe"))


@query("p5_upload_validation", with_sql("objects") + " SELECT name, CASE WHEN size % 5 = 0 THEN 'hash' WHEN size % 5 = 1 THEN 'name' WHEN size % 5 = 2 THEN 'size' END AS error FROM objects")
def p5_upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("size") % 5
    h = F.when(k == 0, F.concat("object_hash", F.lit("."))).otherwise(F.col("object_hash"))
    n = F.when(k == 1, F.concat(F.lit("../"), "name")).otherwise(F.col("name"))
    return rel.objects(spark, sf_dir).select("name", strings.upload_error(n, h, F.when(k == 2, -1).otherwise(F.col("size"))).alias("error"))


@query("p7_etag", with_sql("objects") + " SELECT name, size % 4 <> 3 AS matched FROM objects")
def p7_etag(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, h = F.col("size") % 4, F.col("object_hash")
    header = F.when(k == 0, F.concat(F.lit('"x", W/"'), h, F.lit('"'))).when(k == 1, F.lit("*")).when(k == 2, h).otherwise('"y"')
    return rel.objects(spark, sf_dir).select("name", http.etag_matches(header, h).alias("matched"))


@query("p8_conditional", with_sql("objects") + " SELECT name, CASE size % 5 WHEN 0 THEN 412 WHEN 1 THEN 304 WHEN 2 THEN 304 WHEN 3 THEN 200 ELSE 200 END AS status FROM objects")
def p8_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, h, t = F.col("size") % 5, F.col("object_hash"), F.col("mod_time")
    day = 86_400_000_000_000
    since = F.when(k == 2, strings.last_modified_http(t)).when(k == 3, strings.last_modified_http(t - day))
    return rel.objects(spark, sf_dir).select("name", http.conditional_status(F.when(k == 0, '"no"'), F.when(k == 1, h), since, h, t).alias("status"))


@query("p8_if_range", with_sql("objects") + " SELECT name, CASE size % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN mod_time % 1000000000 = 0 WHEN 3 THEN true ELSE false END AS matches FROM objects")
def p8_if_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range holds for the same tag, or for a date not before the object's time."""
    k, h, t = F.col("size") % 5, F.col("object_hash"), F.col("mod_time")
    value = F.when(k == 0, F.concat(F.lit('"'), h, F.lit('"'))).when(k == 1, '"no"').when(k == 2, strings.last_modified_http(t)).when(k == 3, strings.last_modified_http(t + 86_400_000_000_000)).otherwise("junk")
    return rel.objects(spark, sf_dir).select("name", http.if_range_matches(value, h, t).alias("matches"))


@query("p9_byte_range", "SELECT doc_id, lower(hex(encode(coalesce(text, ''))))[2 * a + 1 : 2 * a + 20] AS part FROM (SELECT doc_id, text, doc_id % 97 AS a FROM documents)")
def p9_byte_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bytes of every text, from places that may lie inside a character or beyond the end."""
    b = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    at = F.col("doc_id") % 97
    header = F.concat(F.lit("bytes="), at.cast("string"), F.lit("-"), (at + 9).cast("string"))
    asked = http.parse_range(header, F.octet_length(b).cast("bigint"))
    return rel.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.lower(F.hex(http.slice_bytes(b, asked))), F.lit("")).alias("part"))


@query("p12_p13_skew", with_sql("samples") + " SELECT event_id, abs(k - 25) * 60 <= 900 AS fresh, abs(k - 25) * 60 <= 900 AS handshake, k > 0 AND k * 3600 <= 86400 AS lifetime_ok FROM samples")
def p12_p13_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.samples(spark, sf_dir)
    now = F.floor(F.col("ts_us") / 1_000_000)
    stamp = lambda s: F.date_format(F.timestamp_seconds(s), "yyyyMMdd'T'HHmmss'Z'")
    return e.select("event_id", http.within_skew(stamp(now + (F.col("k") - 25) * 60), now).alias("fresh"), http.handshake_fresh((now + (F.col("k") - 25) * 60) * 1_000_000_000, now * 1_000_000_000).alias("handshake"), http.presign_valid(stamp(now), (F.col("k") * 3600).cast("string"), now).alias("lifetime_ok"))


def _int(v: str, size: int) -> str:
    """SQL for the hexadecimal digits of an integer of so many bytes."""
    return f"lpad(printf('%x', ({v})::BIGINT), {2 * size}, '0')"


def _hex(v: str) -> str:
    return f"lower(hex(encode({v})))"


def _len(v: str, size: int) -> str:
    return _int(f"octet_length(encode({v}))", size)


def _held(v: str, size: int) -> str:
    return f"{_len(v, size)} || {_hex(v)}"


_PADDED = "{0} || repeat('00', 64 - octet_length(encode({1})))"
_MESSAGES = {
    "ping": f"{_int('event_id', 8)} || {_int('user_id', 4)} || {_int('ts_us', 8)}",
    "rpc": f"{_int('5 + octet_length(encode(d))', 4)} || {_int('1 + k % 13', 1)} || {_int('user_id', 4)} || {_hex('d')}",
    "query": f"{_int('1 + k % 4', 1)} || {_int('event_id', 8)} || {_hex('d')}",
    "response": f"{_int('event_id', 8)} || {_held('d', 4)} || {_held('t', 2)}",
    "lease": f"{_int('event_id', 8)} || {_held('d', 4)} || {_int('ts_us', 8)}",
    "oprf_request": f"{_int('event_id', 8)} || {_int('k', 1)} || {_held('d', 4)}",
    "oprf_response": f"{_int('event_id', 8)} || {_int('k', 1)} || {_held('t', 2)} || {_held('d', 4)}",
    "heartbeat": f"{_int('2', 4)} || {_int('user_id', 4)} || {_held('d', 2)} || {_int('k', 4)} || {_held('t', 2)}",
    "files": f"{_int('1 + (k % 2)', 4)} || {_held('d', 4)} || {_held('t', 4)} || {_int('k', 8)} || {_held('d', 4)} || {_int('ts_us', 8)} || CASE WHEN k % 2 = 1 THEN {_held('t', 4)} || {_held('t', 4)} || {_int('0', 8)} || {_int('0', 4)} || {_int('0', 8)} ELSE '' END",
    "frame": " || ".join((_PADDED.format(_hex("t"), "t"), _PADDED.format(_hex("d"), "d"), _PADDED.format(_hex("k::VARCHAR"), "k::VARCHAR"))),
    "ack": f"{_hex(chr(39) + 'ACK' + chr(39))} || {_int('k', 1)}",
}


@query("f26_f27_codecs", with_sql("samples") + f", m AS (SELECT *, 'd\u00e9' || event_id AS d, 't' || k AS t FROM samples) SELECT event_id, {', '.join(f'{v} AS {k}' for k, v in _MESSAGES.items())} FROM m")
def f26_f27_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every message and frame."""
    return _messages(spark, sf_dir).select("event_id", *(F.lower(F.hex(name)).alias(name) for name in _MESSAGES))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.samples(spark, sf_dir).withColumns({"d": F.concat(F.lit("d\u00e9"), F.col("event_id").cast("string")), "t": F.concat(F.lit("t"), F.col("k").cast("string"))})
    i, u, k, ts, d, t = (F.col(c) for c in ("event_id", "user_id", "k", "ts_us", "d", "t"))
    raw = d.cast("binary")
    peer = lambda n, a: F.struct(n.cast("bigint").alias("id"), a.alias("addr"))
    file = lambda n, h, s, p, at: F.struct(n.alias("name"), h.alias("object_hash"), s.cast("bigint").alias("size"), p.alias("remote_path"), at.cast("bigint").alias("mod_time"))
    zero, none = F.lit(0), F.lit("")
    second = file(F.when(k % 2 == 1, t).otherwise(F.repeat(t, 64)), t, zero, none, zero)  # a name beyond the limit is left out
    return e.select(
        "event_id", "user_id", "k", "ts_us", "d", "t", codecs.ping(i, u, ts).alias("ping"), codecs.rpc(u, k % 13 + 1, raw).alias("rpc"), codecs.query(k % 4 + 1, i, raw).alias("query"),
        codecs.response(i, raw, t).alias("response"), codecs.lease(i, d, ts).alias("lease"), codecs.oprf_request(i, k, raw).alias("oprf_request"), codecs.oprf_response(i, k, t, raw).alias("oprf_response"),
        codecs.heartbeat(F.array(peer(u, d), peer(k, t))).alias("heartbeat"), codecs.file_list(F.array(file(d, t, k, d, ts), second)).alias("files"), codecs.metadata_frame(t, d, k).alias("frame"), codecs.ack(k).alias("ack"),
    )


@query("f26_f27_read_back", with_sql("samples") + ", m AS (SELECT *, 'd\u00e9' || event_id AS d, 't' || k AS t FROM samples) SELECT event_id, user_id AS target, k % 13 + 1 AS kind, d AS rpc_data, d AS query_data, t AS error, d AS lease_key, ts_us AS expiry, k AS share_index, t AS oprf_error, [user_id, k]::BIGINT[] AS peers, CASE WHEN k % 2 = 1 THEN [d, t] ELSE [d] END AS files, k AS frame_size, k AS acked FROM m")
def f26_f27_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the readers find in the bytes, and nothing in bytes that are cut by one."""
    m = placement.spread(_messages(spark, sf_dir))
    text = lambda c: F.decode(c, "UTF-8")
    readers = {"ping": codecs.read_ping, "rpc": codecs.read_rpc, "response": codecs.read_response, "lease": codecs.read_lease, "oprf_request": codecs.read_oprf_request, "oprf_response": codecs.read_oprf_response, "heartbeat": codecs.read_heartbeat, "files": codecs.read_file_list, "frame": codecs.read_metadata, "ack": codecs.read_ack}
    rows = m.withColumns({f"{n}_x": f(F.col(n)) for n, f in readers.items()} | {f"{n}_cut": f(F.substring(F.col(n), F.lit(1), F.octet_length(n) - 1)) for n, f in readers.items()} | {"query_x": codecs.read_query(F.col("query"))})
    whole = rows.where(F.coalesce(*(F.col(f"{n}_cut").cast("string") for n in readers)).isNull())
    return whole.select(
        "event_id", F.col("ping_x.target").alias("target"), F.col("rpc_x.kind").alias("kind"), text(F.col("rpc_x.payload")).alias("rpc_data"), text(F.col("query_x.data")).alias("query_data"), F.col("response_x.error").alias("error"),
        F.col("lease_x.key").alias("lease_key"), F.col("lease_x.expiry").alias("expiry"), F.col("oprf_request_x.share_index").alias("share_index"), F.col("oprf_response_x.error").alias("oprf_error"),
        F.transform("heartbeat_x", lambda p: p["id"]).alias("peers"), F.transform("files_x", lambda f: f["name"]).alias("files"), F.col("frame_x.size").alias("frame_size"), F.col("ack_x").alias("acked"),
    )


@query("f22_chunked_uploads", "SELECT doc_id, CASE WHEN k NOT IN (1, 2, 3) THEN sha256(t) END AS content_hash, CASE WHEN k NOT IN (1, 2, 3) THEN octet_length(encode(t))::BIGINT END AS size, CASE k WHEN 1 THEN 'malformed' WHEN 2 THEN 'signature' WHEN 3 THEN 'size' END AS error FROM (SELECT doc_id, coalesce(text, '') AS t, doc_id % 8 AS k FROM documents)")
def f22_chunked_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a signed upload; some are cut, some follow on another request, some declare another length."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    d = rel.table(spark, sf_dir, "documents").select("doc_id", text.alias("content"), F.sha2(F.col("doc_id").cast("string"), 256).alias("seed"))
    k, now, scope = F.col("doc_id") % 8, "20240101T000000Z", "20240101/eu-1/s3/aws4_request"
    sent = chunked.encode(d, 1000, KEY, now, scope, "doc_id").join(d.select("doc_id", "seed", F.octet_length("content").cast("long").alias("n")), "doc_id")
    body = F.when(k == 1, F.substring(F.col("body"), F.lit(1), F.octet_length("body") - 1)).otherwise(F.col("body"))
    came = sent.select("doc_id", body.alias("body"), F.when(k == 2, F.reverse("seed")).otherwise(F.col("seed")).alias("seed"), F.when(k == 3, F.col("n") + 1).otherwise(F.col("n")).alias("decoded_length"))
    return chunked.decode(came, KEY, now, scope, id_col="doc_id").select("doc_id", "content_hash", "size", "error")


def _hmac_sql(key: bytes, data: str) -> str:
    k = key.ljust(64, b"\0")
    inner, outer = ("".join(f"{b ^ pad:02x}" for b in k) for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({data}))))"


@query("f16_hmac", with_sql("objects") + f" SELECT name, {_hmac_sql(KEY, 'name')} AS mac, sha256(name || ':peer:') AS token FROM objects")
def f16_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.objects(spark, sf_dir).select("name", crypto.hmac_sha256(KEY, F.col("name")).alias("mac"), crypto.peer_token(F.col("name"), ":peer:").alias("token"))


@query("f15_request_signature", with_sql("objects") + f""", r AS (SELECT name, 'GET' || chr(10) || '/' || name || chr(10) || 'list-type=2&prefix=a%2Fb' || chr(10) || 'host:h' || chr(10) || chr(10) || 'host' || chr(10) || object_hash AS req FROM objects)
SELECT name, {_hmac_sql(crypto.signing_key("secret", "20240101", "eu-1"), "'AWS4-HMAC-SHA256' || chr(10) || '20240101T000000Z' || chr(10) || '20240101/eu-1/s3/aws4_request' || chr(10) || sha256(req)")} AS signature FROM r""")
def f15_request_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.create_map(F.lit("prefix"), F.lit("a/b"), F.lit("list-type"), F.lit("2"), F.lit("X-Amz-Signature"), F.lit("zz"))
    req = crypto.canonical_request(F.lit("GET"), F.concat(F.lit("/"), "name"), params, F.create_map(F.lit("host"), F.lit(" h ")), F.lit("host"), F.col("object_hash"))
    return rel.objects(spark, sf_dir).select("name", crypto.signature("secret", "20240101", "eu-1", crypto.string_to_sign(req, F.lit("20240101T000000Z"), "eu-1")).alias("signature"))


@query("f18_aead", "SELECT doc_id, sha256(coalesce(text, '')) AS digest, (28 + octet_length(encode(coalesce(text, ''))))::INT AS sealed_bytes FROM documents")
def f18_aead(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = crypto.encrypt(F.coalesce("text", F.lit("")).cast("binary"), KEY)
    rows = rel.table(spark, sf_dir, "documents").select("doc_id", sealed.alias("s"))
    return rows.select("doc_id", F.sha2(crypto.decrypt(F.col("s"), KEY), 256).alias("digest"), F.octet_length("s").alias("sealed_bytes"))


@query("f19_f20_envelopes", "SELECT doc_id, 'key-1' AS key_id, sha256(coalesce(text, '')) AS digest FROM documents")
def f19_f20_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    sealed = crypto.envelope(text, KEY, F.unhex(F.sha2(text, 256)), "key-1", F.substring(F.unhex(F.sha2(text, 256)), 1, 8), MAGIC, b"footer")
    rows = rel.table(spark, sf_dir, "documents").select("doc_id", sealed.alias("s"))
    return rows.withColumn("x", crypto.open_envelope(F.col("s"), KEY, MAGIC, b"footer")).select("doc_id", "x.key_id", F.sha2("x.content", 256).alias("digest"))


@query("f21_threshold_keys", "SELECT n_nationkey, true AS agree FROM nation")
def f21_threshold_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blinds and two sets of shares lead to one key."""
    shares = oprf.make_shares([1 << 200, 12345], 3)
    scalar = lambda label: F.concat(F.unhex(F.substring(F.sha2(F.concat("n_name", F.lit(label)), 256), 1, 62)), F.lit(b"\x00"))
    rows = rel.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", scalar("a").alias("r1"), scalar("b").alias("r2"))
    rows = rows.withColumns({f"b{k}": oprf.blind(F.col("n_name"), F.col(f"r{k}"), b"lodestone") for k in (1, 2)})

    def key(k: int, chosen: list) -> F.Column:
        answers = F.array(*(F.struct(F.lit(x).alias("share_index"), oprf.evaluate(F.col(f"b{k}"), s).alias("evaluation")) for x, s in chosen))
        return oprf.unblind(answers, F.col(f"r{k}"), 2)

    return rows.select("n_nationkey", (key(1, shares[:2]) == key(2, shares[1:])).alias("agree"))
