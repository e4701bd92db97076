"""Queries of placement, replication plans, catalogue state, listing and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..operators import gather, listing, machines, placement, state
from ..sources import relations as rel
from ..sources.relations import with_sql
from .registry import query

RF = 3
ORDER, CLIENT_SIDE = [0, 1, 2, 3], [3]

_PLACED = """, able AS (SELECT *, unhex(array_to_string(list_reverse(regexp_extract_all(lpad(hex(node_id), 16, '0'), '..')), '')) AS nk FROM nodes WHERE weight > 0),
digests AS (SELECT o.name, o.object_hash, node_id, weight, decl_order, sha256(encode(o.object_hash) || nk) AS d FROM objects o, able),
units AS (SELECT *, ((('0x' || d[7:8] || d[5:6] || d[3:4] || d[1:2])::BIGINT << 20) | (('0x' || d[63:64] || d[61:62] || d[59:60] || d[57:58])::BIGINT & 1048575))::DOUBLE / 4503599627370496.0 AS u FROM digests),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN u > 0 AND u < 1 THEN -weight / ln(u) ELSE 0 END DESC, decl_order) AS rank FROM units),
placed AS (SELECT name, object_hash, list(node_id ORDER BY rank) AS placement FROM ranked WHERE rank <= 3 GROUP BY name, object_hash)"""
PLACED = with_sql("nodes", "objects") + _PLACED


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.place(rel.objects(spark, sf_dir).select("name", "object_hash"), rel.nodes(spark, sf_dir), RF)


@query("k2_placement", PLACED + " SELECT name, object_hash, rank::INT AS rank, node_id FROM ranked WHERE rank <= 3")
def k2_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("name", "object_hash", F.posexplode("placement").alias("rank", "node_id")).withColumn("rank", F.col("rank") + 1)


@query("k3_primary", PLACED + " SELECT name, placement[1] AS primary_node FROM placed")
def k3_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("name", placement.primary(F.col("placement")).alias("primary_node"))


@query("k4_placement_load", PLACED + " SELECT node_id, count(*) AS n_keys, count(*) FILTER (rank = 1) AS n_primary FROM ranked WHERE rank <= 3 GROUP BY node_id")
def k4_placement_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k2_placement(spark, sf_dir).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("rank") == 1).alias("n_primary"))


@query("j8_next_hop", PLACED + " SELECT name, node_id, (rank - 1)::INT AS position, lead(node_id) OVER (PARTITION BY name ORDER BY rank) AS next_node FROM ranked WHERE rank <= 3")
def j8_next_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(spark, sf_dir).select("name", "placement", F.explode("placement").alias("node_id"))
    return rows.select("name", "node_id", placement.position(F.col("placement"), F.col("node_id")).alias("position"), placement.next_hop(F.col("placement"), F.col("node_id")).alias("next_node"))


_LANDING = "1::BIGINT"
_PLANS = f"""{PLACED}, plans AS (
 SELECT name, 'none' AS mode, -1::BIGINT AS source, {_LANDING} AS target FROM placed
 UNION ALL SELECT name, 'chain', -1, placement[1] FROM placed
 UNION ALL SELECT name, 'chain', placement[i], placement[i + 1] FROM placed, range(1, 3) r(i) WHERE i < len(placement)
 UNION ALL SELECT name, 'splay', -1, {_LANDING} FROM placed
 UNION ALL SELECT name, 'splay', {_LANDING}, t FROM (SELECT name, unnest(placement) AS t FROM placed) WHERE t <> {_LANDING}
 UNION ALL SELECT name, 'primary-splay', -1, {_LANDING} FROM placed
 UNION ALL SELECT name, 'primary-splay', -1, t FROM (SELECT name, unnest(placement) AS t FROM placed) WHERE t <> {_LANDING})"""


@query("r1_r4_replication_plans", _PLANS + " SELECT name, mode, source, target FROM plans")
def r1_r4_replication_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = placed(spark, sf_dir)
    p, landing = F.col("placement"), F.lit(1).cast("bigint")
    plans = F.array(*(F.struct(F.lit(m).alias("mode"), placement.edges(m, p, None if m == "chain" else landing).alias("e")) for m in placement.MODES))
    rows = base.select("name", F.explode(plans).alias("x")).select("name", "x.mode", F.explode("x.e").alias("e"))
    return rows.select("name", "mode", "e.source", "e.target")


@query("r5_resolve_mode", with_sql("samples") + """ SELECT event_id, CASE WHEN user_id % 3 = 0 AND m = 3 THEN 0 ELSE m END::INT AS mode FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN (k // 4) % 4 ELSE k % 4 END AS m FROM samples)""")
def r5_resolve_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.samples(spark, sf_dir)
    k, u = F.col("k"), F.col("user_id")
    return e.select("event_id", placement.resolve_mode(k % 4, F.floor(k / 4) % 4, u % 2 == 0, u % 3 == 0, ORDER, CLIENT_SIDE).cast("int").alias("mode"))


@query("r6_acknowledged", with_sql("samples") + " SELECT user_id * 1000 + k AS request, bool_and(event_type <> 'error' AND (value * 1000000000)::DOUBLE <= 30000000000.0) AS ack FROM samples GROUP BY 1")
def r6_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.samples(spark, sf_dir).select((F.col("user_id") * 1000 + F.col("k")).alias("request"), (F.col("event_type") != "error").alias("ok"), (F.col("value") * 1e9).alias("latency_ns"))
    return placement.acknowledged(e, "request")


@query("r7_durability", with_sql("samples") + " SELECT event_id, CASE WHEN k % 4 = 0 THEN 1 ELSE least(user_id % 5, greatest(k % 7, 1)) END::BIGINT AS copies, user_id % 5 > k % 7 AS degraded FROM samples")
def r7_durability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.samples(spark, sf_dir)
    rf, cluster = F.col("user_id") % 5, F.col("k") % 7
    return e.select("event_id", placement.effective_durability(F.col("k") % 4, rf, cluster).cast("bigint").alias("copies"), placement.degraded(rf, cluster).alias("degraded"))


# ---- state of the operation log

_FOLD = with_sql("ops") + """, log AS (SELECT *, lag(op) OVER w AS prev_op, lag(object_hash) OVER w AS prev_hash, row_number() OVER (PARTITION BY name ORDER BY seq DESC, op_id DESC) AS back FROM ops WHERE op IN ('put', 'delete') WINDOW w AS (PARTITION BY name ORDER BY seq, op_id)),
eff AS (SELECT *, CASE WHEN op = 'put' THEN object_hash WHEN prev_op = 'put' THEN prev_hash END AS ref_hash, CASE WHEN op = 'put' THEN 1 WHEN prev_op = 'put' THEN -1 ELSE 0 END AS delta FROM log),
ns AS (SELECT name, object_hash, op_ts AS mod_time FROM log WHERE back = 1 AND op = 'put'),
tombs AS (SELECT name, op_ts AS deleted_at FROM log WHERE back = 1 AND op = 'delete'),
dels AS (SELECT name, max((seq, op_id)) AS d FROM log WHERE op = 'delete' GROUP BY name),
pth AS (SELECT name, arg_max(remote_path, (seq, op_id)) AS remote_path FROM log LEFT JOIN dels USING (name) WHERE op = 'put' AND remote_path <> '' AND (d IS NULL OR (seq, op_id) > d) GROUP BY name),
refs AS (SELECT ref_hash AS object_hash, sum(delta)::BIGINT AS ref_count FROM eff WHERE delta <> 0 GROUP BY ref_hash),
runs AS (SELECT *, sum(delta) OVER (PARTITION BY ref_hash ORDER BY seq, op_id) AS after FROM eff WHERE delta <> 0),
born AS (SELECT ref_hash AS object_hash, arg_max(size, (seq, op_id)) AS size FROM runs WHERE op = 'put' AND after = 1 GROUP BY ref_hash),
objs AS (SELECT object_hash, size, ref_count FROM refs JOIN born USING (object_hash) WHERE ref_count > 0)"""


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.object_ops(spark, sf_dir)


@query("m1_namespace", _FOLD + " SELECT * FROM ns")
def m1_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.namespace(_ops(spark, sf_dir))


@query("m2_delete_effects", _FOLD + " SELECT op_id, name, op, prev_op, ref_hash, delta FROM eff")
def m2_delete_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.effects(_ops(spark, sf_dir)).select("op_id", "name", "op", "prev_op", "ref_hash", "delta")


@query("a2_ref_counts", _FOLD + " SELECT r.object_hash, ref_count, coalesce(n, 0) AS live_refs FROM refs r LEFT JOIN (SELECT object_hash, count(*) AS n FROM ns GROUP BY 1) USING (object_hash)")
def a2_ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.ref_counts(_ops(spark, sf_dir))


@query("w3_object_table", _FOLD + " SELECT * FROM objs")
def w3_object_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.object_table(_ops(spark, sf_dir))


@query("s6_tombstones", _FOLD + " SELECT * FROM tombs")
def s6_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tombstones(_ops(spark, sf_dir))


@query("m1_paths", _FOLD + " SELECT * FROM pth")
def m1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.paths(_ops(spark, sf_dir))


_SCAN = " SELECT ns.name, ns.object_hash, coalesce(size, 0) AS size, coalesce(remote_path, '') AS remote_path, mod_time FROM ns ANTI JOIN tombs USING (name) {} JOIN objs USING (object_hash) LEFT JOIN pth ON pth.name = ns.name"


def _scan(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    ops = _ops(spark, sf_dir)
    return state.catalog_scan(state.namespace(ops), state.tombstones(ops), state.object_table(ops), state.paths(ops), strict)


@query("s1_catalog_scan", _FOLD + _SCAN.format("LEFT"))
def s1_catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, False)


@query("s2_point_lookup", _FOLD + _SCAN.format("INNER") + " WHERE ns.name = 'u3/1'")
def s2_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, True).where("name = 'u3/1'")


@query("s3_metadata_lookup", _FOLD + _SCAN.format("INNER"))
def s3_metadata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, True)


@query("s4_has", _FOLD + " SELECT h AS object_hash, objs.object_hash IS NOT NULL AS found FROM (SELECT DISTINCT unnest([object_hash, sha256(object_hash)]) AS h FROM ops) LEFT JOIN objs ON h = objs.object_hash")
def s4_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hash of the log, and as many that nobody put."""
    ops = _ops(spark, sf_dir)
    asked = ops.select(F.explode(F.array("object_hash", F.sha2("object_hash", 256))).alias("object_hash")).distinct()
    return state.has(state.object_table(ops), asked)


@query("s5_hash_for_name", _FOLD + " SELECT name, object_hash FROM ns ANTI JOIN tombs USING (name)")
def s5_hash_for_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _ops(spark, sf_dir)
    return state.namespace(ops).join(state.tombstones(ops), "name", "left_anti").select("name", "object_hash")


@query("p14_proof_of_knowledge", _FOLD + " SELECT name, object_hash FROM ns JOIN (SELECT DISTINCT name, unnest([object_hash, sha256(object_hash)]) AS object_hash FROM ops) USING (name, object_hash)")
def p14_proof_of_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of the log claims all hashes it ever had, and one for each that it never had."""
    ops = _ops(spark, sf_dir)
    claims = ops.select("name", F.explode(F.array("object_hash", F.sha2("object_hash", 256))).alias("object_hash")).distinct()
    return state.namespace(ops).join(claims, ["name", "object_hash"]).select("name", "object_hash")


@query("s7_blob_path", with_sql("objects") + " SELECT DISTINCT object_hash, object_hash[1:2] || '/' || object_hash[3:4] || '/' || object_hash[5:6] || '/' || object_hash AS path FROM objects")
def s7_blob_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.objects(spark, sf_dir).select("object_hash").distinct().select("object_hash", strings.blob_path(F.col("object_hash")).alias("path"))


@query("m3_remote_tombstones", with_sql("ops") + """, own AS (SELECT name, max((seq, op_id)) AS k, arg_max(op, (seq, op_id)) AS op, arg_max(object_hash, (seq, op_id)) AS h, arg_max(op_ts, (seq, op_id)) AS t0 FROM ops WHERE op <> 'apply_tombstone' GROUP BY name),
remote AS (SELECT o.name, max(o.op_ts) AS t FROM ops o LEFT JOIN own USING (name) WHERE o.op = 'apply_tombstone' AND (k IS NULL OR (o.seq, o.op_id) > k) GROUP BY o.name)
SELECT coalesce(own.name, remote.name) AS name, CASE WHEN op = 'put' AND t IS NULL THEN h END AS live_hash, greatest(CASE WHEN op = 'delete' THEN t0 ELSE 0 END, coalesce(t, 0)) AS deleted_at FROM own FULL JOIN remote ON own.name = remote.name""")
def m3_remote_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.with_remote_tombstones(_ops(spark, sf_dir))


@query("m4_orphans", _FOLD + " SELECT object_hash FROM refs WHERE ref_count <= 0")
def m4_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.orphans(state.ref_counts(_ops(spark, sf_dir))).select("object_hash")


_NOW, _KEEP = 1_706_500_000_000_000_000, 86_400_000_000_000


@query("m5_expired_tombstones", _FOLD + f" SELECT name, deleted_at FROM tombs WHERE deleted_at < {_NOW - _KEEP}")
def m5_expired_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.expired(state.tombstones(_ops(spark, sf_dir)), _NOW, _KEEP)


@query("m7_copy", _FOLD + ", heads AS (SELECT name, arg_max('t' || (op_ts % 7), (seq, op_id)) AS h FROM ops WHERE op = 'put' GROUP BY name) SELECT 'copy/' || name AS name, object_hash, 'put' AS op, 1 AS delta, h AS headers FROM ns LEFT JOIN heads USING (name)")
def m7_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name is copied, with its headers; each copy adds a reference to its hash."""
    ops = _ops(spark, sf_dir)
    ns = state.namespace(ops)
    heads = ops.where("op = 'put'").groupBy("name").agg(F.max_by(F.concat(F.lit("t"), (F.col("op_ts") % 7).cast("string")), F.struct("seq", "op_id")).alias("headers"))
    wanted = ns.select(F.col("name").alias("source"), F.concat(F.lit("copy/"), "name").alias("target"))
    return state.copy_objects(ns, wanted, heads)


@query("m6_collection", _FOLD + """, balance AS (SELECT object_hash, count(*) FILTER (op = 'put') - count(*) FILTER (op = 'delete') AS n FROM ops WHERE op IN ('put', 'delete') GROUP BY 1) SELECT 'object' AS kind, object_hash AS key FROM balance WHERE n <= 0 UNION ALL SELECT 'tombstone', name FROM tombs WHERE deleted_at < 1706000000000000000 - 86400000000000""")
def m6_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of the collector over objects by plain balance of puts and deletes, and over the log's tombstones."""
    ops = _ops(spark, sf_dir)
    refs = ops.where("op in ('put', 'delete')").groupBy("object_hash").agg(F.sum(F.when(F.col("op") == "put", 1).otherwise(-1)).alias("ref_count"))
    return machines.garbage(refs, state.tombstones(ops), 1_706_000_000_000_000_000, 86_400 * machines.SECOND)


@query("m11_list_uploads", "SELECT conv_id AS upload_id, 'c' || conv_id AS key, count(*) AS n_parts, (row_number() OVER (ORDER BY min(turn), conv_id))::INT AS place FROM conversations GROUP BY conv_id HAVING count(*) % 2 = 1")
def m11_list_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads that are neither completed nor aborted, by creation."""
    c = rel.table(spark, sf_dir, "conversations")
    events = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("t"))
    ended = events.where("n % 2 = 0").select(F.col("conv_id").alias("upload_id"), F.when(F.col("n") % 4 == 0, "complete").otherwise("abort").alias("end"))
    started = events.select(F.col("conv_id").alias("upload_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("key"), F.col("t").alias("created_at"), F.col("n").alias("n_parts"))
    return machines.ranked(state.open_uploads(started, ended), [F.col("created_at"), F.col("upload_id")]).select("upload_id", "key", "n_parts", "place")


@query("m9_bucket_requests", with_sql("objects") + " SELECT name, CASE WHEN b <> 'main' THEN 404 WHEN verb = 'DELETE' THEN 409 ELSE 200 END::INT AS status FROM (SELECT name, CASE WHEN size % 3 = 0 THEN 'other' ELSE 'main' END AS b, ['PUT', 'HEAD', 'GET', 'DELETE'][1 + size % 4] AS verb FROM objects)")
def m9_bucket_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests on a bucket of the store, which is not empty, and on another one."""
    bucket = F.when(F.col("size") % 3 == 0, "other").otherwise("main")
    verb = F.element_at(F.array(*map(F.lit, ("PUT", "HEAD", "GET", "DELETE"))), (1 + F.col("size") % 4).cast("int"))
    return rel.objects(spark, sf_dir).select("name", state.bucket_status(verb, bucket, "main", F.lit(False)).alias("status"))


@query("m8_delete_batch", with_sql("objects") + " SELECT name, CASE WHEN contains(name, '..') OR contains(name, chr(92)) THEN 'InvalidArgument' ELSE 'Deleted' END AS status FROM (SELECT CASE WHEN size % 5 = 0 THEN '../' || name WHEN size % 5 = 1 THEN name || chr(92) ELSE name END AS name FROM objects)")
def m8_delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("size") % 5 == 0, F.concat(F.lit("../"), "name")).when(F.col("size") % 5 == 1, F.concat("name", F.lit("\\"))).otherwise(F.col("name"))
    return state.delete_batch(rel.objects(spark, sf_dir).select(name.alias("name")))


@query("m9_bucket_delete", _FOLD + " SELECT CASE WHEN count(*) > 0 THEN 409 ELSE 204 END AS status FROM ns")
def m9_bucket_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = state.namespace(_ops(spark, sf_dir)).limit(1)
    return left.agg(F.when(F.count(F.lit(1)) > 0, 409).otherwise(204).alias("status"))


_PARTS = "WITH parts AS (SELECT conv_id AS upload_id, turn AS part_number, coalesce(text, '') AS text FROM conversations)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("upload_id"), F.col("turn").alias("part_number"), F.xxhash64("role", "text").alias("arrival"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))


@query("m10_complete_multipart", _PARTS + " SELECT upload_id, count(*)::INT AS n_parts, sum(octet_length(encode(text)))::BIGINT AS size, sha256(string_agg(text, '' ORDER BY part_number)) AS object_hash FROM parts GROUP BY upload_id")
def m10_complete_multipart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.multipart(_parts(spark, sf_dir))


@query("m11_list_parts", _PARTS + " SELECT upload_id, part_number, sha256(text) AS etag, octet_length(encode(text))::BIGINT AS size FROM parts")
def m11_list_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.list_parts(_parts(spark, sf_dir))


@query("m13_verified_ingest", "SELECT doc_id, doc_id % 7 <> 0 AS accepted FROM documents")
def m13_verified_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rel.table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    declared = F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit("?"))).otherwise(text), 256)
    return state.verified(d.select("doc_id", declared.alias("object_hash"), text.cast("binary").alias("content"))).select("doc_id", "accepted")


@query("m14_dedup_decision", _FOLD + " SELECT up.name, up.object_hash, objs.object_hash IS NOT NULL AND ns.name IS NOT NULL AS skip FROM (SELECT DISTINCT name, object_hash FROM ops) up LEFT JOIN objs USING (object_hash) LEFT JOIN ns ON ns.name = up.name AND ns.object_hash = up.object_hash")
def m14_dedup_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _ops(spark, sf_dir)
    return state.dedup_decision(ops.select("name", "object_hash").distinct(), state.namespace(ops), state.object_table(ops))


_ALLOC = """WITH firsts AS (SELECT sha256(coalesce(text, '')) AS object_hash, min(doc_id) AS seq, any_value(octet_length(encode(coalesce(text, ''))))::BIGINT AS length FROM documents GROUP BY 1),
alloc AS (SELECT object_hash, (coalesce(sum(length) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", length FROM firsts)"""


def _alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return state.allocate(rel.table(spark, sf_dir, "documents").select(F.sha2(text, 256).alias("object_hash"), F.col("doc_id").alias("seq"), F.octet_length(text).cast("bigint").alias("length")))


@query("s10_raw_allocation", _ALLOC + ' SELECT object_hash, "offset", length FROM alloc')
def s10_raw_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alloc(spark, sf_dir)


@query("s11_next_offset", _ALLOC + ' SELECT coalesce(max("offset" + length) FILTER ("offset" > 0 AND length > 0), 0) AS next_offset FROM alloc')
def s11_next_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.next_offset(_alloc(spark, sf_dir))


# ---- listing

_LIST = with_sql("objects") + """, kept AS (SELECT * FROM objects WHERE octet_length(encode(name)) <= 64),
el AS (SELECT 'K' AS kind, name AS key, name, object_hash, size, mod_time FROM kept WHERE NOT contains(name, '/') UNION ALL
SELECT 'P', left(name, position('/' IN name)), min(name), NULL, NULL, NULL FROM kept WHERE contains(name, '/') GROUP BY 2),
inner_ AS (SELECT 'K' AS kind, name AS key, name, object_hash, size, mod_time FROM kept WHERE name LIKE 'src1/en/%')"""


def _page(table: str, where: str, n: int) -> str:
    return f", page AS (SELECT row_number() OVER (ORDER BY name)::INT AS rank, kind, key, object_hash, size, mod_time, (SELECT count(*) FROM {table} WHERE {where}) > {n} AS truncated FROM {table} WHERE {where} ORDER BY name LIMIT {n})"


@query("a1_list_groups", _LIST + _page("el", "true", 10) + " SELECT * FROM page")
def a1_list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(rel.objects(spark, sf_dir), delimiter="/", max_keys=10)


@query("k8_next_page", _LIST + _page("el", "name >= 'src12/' AND NOT starts_with(name, 'src12/')", 5) + " SELECT * FROM page")
def k8_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(rel.objects(spark, sf_dir), delimiter="/", after=("P", "src12/"), max_keys=5)


@query("k7_list_prefix", _LIST + _page("inner_", "name > 'src1/en/doc-1'", 20) + " SELECT * FROM page")
def k7_list_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page(rel.objects(spark, sf_dir), prefix="src1/en/", after=("K", "src1/en/doc-1"), max_keys=20)


@query("a1_list_summary", _LIST + _page("el", "true", 10) + " SELECT count(*) AS key_count, count(*) FILTER (kind = 'K') AS contents, count(*) FILTER (kind = 'P') AS prefixes, coalesce(bool_or(truncated), false) AS truncated, CASE WHEN bool_or(truncated) THEN to_base64(encode(arg_max(kind || key, rank))) END AS token FROM page")
def a1_list_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.summary(a1_list_groups(spark, sf_dir))


@query("s17_list_xml", _LIST + _page("inner_", "name > 'src1/en/doc-1'", 20) + " SELECT rank, '<Contents><Key>' || key || '</Key><LastModified>' || strftime(make_timestamp(mod_time // 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z</LastModified><ETag>&quot;' || object_hash || '&quot;</ETag><Size>' || size || '</Size><StorageClass>STANDARD</StorageClass></Contents>' AS xml FROM page")
def s17_list_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page_xml(k7_list_prefix(spark, sf_dir))


@query("s18_deleted_keys", with_sql("objects") + " SELECT name AS request_id, trim(name) AS key FROM objects")
def s18_deleted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("<Delete><Object><Key> "), strings.xml_escape(F.col("name")), F.lit(" </Key></Object><Object><Key> </Key></Object></Delete>"))
    return listing.deleted_keys(rel.objects(spark, sf_dir).select(F.col("name").alias("request_id"), body.alias("body")))


# ---- scatter and gather

@query("u1_global_list", PLACED + " SELECT DISTINCT o.name, o.object_hash, o.size FROM objects o JOIN ranked r ON o.name = r.name WHERE rank <= 3 AND node_id % 5 <> 2")
def u1_global_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = k2_placement(spark, sf_dir).select("name", F.col("node_id").alias("source_rank"))
    lists = rel.objects(spark, sf_dir).select("name", "object_hash", "size").join(held, "name")
    sent = lists.withColumn("size", F.when(F.col("source_rank") % 5 == 2, -1).otherwise(F.col("size")))
    error = strings.row_error(F.col("name"), F.col("object_hash"), F.lit(""), F.col("size"))
    return gather.merge(sent, error.isNull()).select("name", "object_hash", "size")


@query("a4_response_tally", with_sql("samples") + " SELECT user_id AS request_id, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, arg_min('E' || k, ts_us) FILTER (event_type = 'error') AS first_error FROM samples GROUP BY user_id")
def a4_response_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.samples(spark, sf_dir)
    return gather.tally(e.select(F.col("user_id").alias("request_id"), F.col("ts_us").alias("arrival"), F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("k").cast("string"))).alias("error")))


@query("a5_lease_quorum", with_sql("samples") + " SELECT k AS lease_id, count(*) FILTER (event_type <> 'error') AS granted, count(*) FILTER (event_type <> 'error') >= 8 AS acquired FROM samples GROUP BY k")
def a5_lease_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.samples(spark, sf_dir)
    return gather.lease_results(e.select(F.col("k").alias("lease_id"), (F.col("event_type") != "error").alias("granted")), 15, 15)


@query("a6_share_threshold", with_sql("samples") + " SELECT user_id AS request_id, count(DISTINCT k % 6) FILTER (event_type <> 'error' AND k % 6 > 0 AND k % 4 <> 0) AS shares, count(DISTINCT k % 6) FILTER (event_type <> 'error' AND k % 6 > 0 AND k % 4 <> 0) >= 5 AS enough FROM samples GROUP BY user_id")
def a6_share_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.samples(spark, sf_dir)
    rows = e.select(F.col("user_id").alias("request_id"), (F.col("k") % 6).alias("share_index"), F.when(F.col("event_type") == "error", "x").alias("error"), F.when(F.col("k") % 4 == 0, F.lit(b"")).otherwise(F.lit(b"v")).alias("evaluation"))
    return gather.shares(rows, 5)


@query("a9_repeated_hashes", with_sql("objects") + " SELECT object_hash, count(*) AS n FROM objects GROUP BY 1 HAVING count(*) > 1")
def a9_repeated_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gather.repeated(rel.objects(spark, sf_dir), "object_hash")


@query("j6_answered_requests", with_sql("samples") + " SELECT q.event_id AS request_id, r.event_id AS response_event FROM samples q JOIN samples r ON q.user_id = r.user_id AND r.ts_us BETWEEN q.ts_us AND q.ts_us + 21600000000 WHERE q.event_type = 'click' AND r.event_type = 'view'")
def j6_answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    asks = e.where("event_type = 'click'").select(F.col("user_id").alias("id"), F.col("ts").alias("request_ts"), F.col("event_id").alias("request_id"))
    answers = e.where("event_type = 'view'").select(F.col("user_id").alias("response_id"), F.col("ts").alias("response_ts"), F.col("event_id").alias("response_event"))
    return gather.answered(asks, answers, "INTERVAL 6 HOURS").select("request_id", "response_event")


@query("u2_membership", with_sql("samples") + " SELECT user_id AS id, arg_min('10.0.0.' || k, ts_us) AS addr FROM samples WHERE user_id % 4 <> 0 GROUP BY 1")
def u2_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.samples(spark, sf_dir)
    seen = e.select(F.col("user_id").alias("id"), F.col("ts_us").alias("arrival"), F.concat(F.lit("10.0.0."), F.col("k").cast("string")).alias("addr"))
    return gather.unseen(seen, seen.where("id % 4 = 0").select("id").distinct())
