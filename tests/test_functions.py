"""Fixed cases of the scalar functions, codecs and cryptography."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from lodestone.functions import chunked, codecs, crypto, http, strings
from lodestone.operators import counters


def values(spark, rows, schema, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(*cols).collect()]


def test_sanitize_and_traversal(spark):
    assert values(spark, [("hello\r\nworld",), ("a\tb\x7f",), ("\x00x",)], "s string", strings.sanitize_log(F.col("s"))) == ["hello__world", "a\tb\x7f", "_x"]
    cases = {"a/b": True, "a\\b": True, "..": True, "file..txt": False, "...": False, "": False}
    assert values(spark, [(k,) for k in cases], "s string", strings.has_traversal_chars(F.col("s"))) == list(cases.values())


def test_normalize_path(spark):
    cases = {"/a/": ("a", None), "a//b///c": ("a/b/c", None), "a/ /b": ("a/b", None), "my dir/f": ("my dir/f", None), "": ("", None), "  ": ("", None), "a/../b": (None, "EINVAL"), "a\\b": (None, "EINVAL"), "a\x00": (None, "EINVAL"), "/": (None, "EINVAL"), "./.": (None, "EINVAL")}
    got = values(spark, [(k,) for k in cases], "s string", strings.normalize_path(F.col("s")))
    assert [tuple(g) for g in got] == list(cases.values())


def test_parse_int(spark):
    cases = {"42": 42, "-7": -7, "+7": 7, "9223372036854775807": (1 << 63) - 1, "-9223372036854775808": -(1 << 63), "9223372036854775808": None, "12\x00\x00": 12, "": None, "1 ": None, "x": None}
    assert values(spark, [(k,) for k in cases], "s string", strings.parse_int(F.col("s"))) == list(cases.values())


def test_tokens(spark):
    rows = [("K", "docs/file2.txt"), ("P", "docs/"), ("K", ""), ("K", "café/étude.txt")]
    got = values(spark, rows, "k string, s string", strings.decode_token(strings.encode_token(F.col("k"), F.col("s"))))
    assert [tuple(g) for g in got] == rows
    assert values(spark, [("",), ("not-base64!!",), ("a",), ("!!!",), ("eHl6",)], "s string", strings.decode_token(F.col("s"))) == [None] * 5


def test_last_modified_keeps_integers(spark):
    rows = [(1700000000123999999,), (1700000000123000000,)]
    assert values(spark, rows, "n long", strings.last_modified_iso(F.col("n"))) == ["2023-11-14T22:13:20.123Z"] * 2
    assert values(spark, rows[:1], "n long", strings.last_modified_http(F.col("n"))) == ["Tue, 14 Nov 2023 22:13:20 GMT"]


def test_bucket_and_key(spark):
    cases = {("h", "/b/k/x"): ("b", "k/x"), ("h", "/b"): ("b", ""), ("h", "/"): ("", ""), ("b1.localhost:9000", "/k"): ("b1", "k"), ("b2.s3.eu.example", "/k/../m"): ("b2", "m")}
    got = values(spark, list(cases), "h string, p string", strings.split_bucket(F.col("h"), F.col("p")))
    assert [tuple(g) for g in got] == list(cases.values())


def test_byte_ranges(spark):
    cases = {
        "bytes=0-15": (0, 15, True, False), "bytes=4-9": (4, 9, True, False), "bytes=10-": (10, 15, True, False), "bytes=-4": (12, 15, True, False),
        "bytes=-100": (0, 15, True, False), "bytes=12-999": (12, 15, True, False), "bytes=16-": (0, 0, False, True), "bytes=20-25": (0, 0, False, True),
        "bytes=5-2": (0, 0, False, True), "bytes=-0": (0, 0, False, True), "bytes=-": (0, 0, False, True), "bytes=0-3,8-11": (0, 0, False, False), "items=0-4": (0, 0, False, False),
    }
    got = values(spark, [(k,) for k in cases], "h string", http.parse_range(F.col("h"), F.lit(16).cast("bigint")))
    assert [tuple(g) for g in got] == list(cases.values())
    assert tuple(values(spark, [("bytes=0-0",)], "h string", http.parse_range(F.col("h"), F.lit(0).cast("bigint")))[0]) == (0, 0, False, True)


def test_etags_and_conditions(spark):
    cases = {'"abc"': True, '"x", "abc"': True, "*": True, 'W/"abc"': True, '"abd"': False, "": False}
    assert values(spark, [(k,) for k in cases], "h string", http.etag_matches(F.col("h"), F.lit("abc"))) == list(cases.values())
    t = F.lit(1_700_000_000_500_000_000)
    status = lambda a, b, c: http.conditional_status(F.lit(a), F.lit(b), F.lit(c), F.lit("abc"), t)
    same, before = "Tue, 14 Nov 2023 22:13:20 GMT", "Tue, 14 Nov 2023 22:13:19 GMT"
    got = values(spark, [(1,)], "x int", status('"z"', None, None), status(None, "abc", None), status(None, "zz", same), status(None, None, same), status(None, None, before), status(None, None, "junk"))
    assert got == [(412, 304, 200, 304, 200, 200)]


def test_frames(spark):
    row = values(spark, [("name", "h" * 64, 12)], "n string, h string, s long", codecs.metadata_frame(F.col("h"), F.col("n"), F.col("s")), codecs.read_metadata(codecs.metadata_frame(F.col("h"), F.col("n"), F.col("s"))), F.octet_length(codecs.handshake(F.col("n"), F.lit("1700000000000000000"), F.lit("2"))))[0]
    assert bytes(row[0]) == b"h" * 64 + b"name".ljust(64, b"\0") + b"12".ljust(64, b"\0")
    assert tuple(row[1]) == ("h" * 64, "name", 12) and row[2] == 84
    assert values(spark, [("x" * 65,)], "s string", strings.pad(F.col("s"), 64)) == [None]
    acks = values(spark, [(7,), (255,), (256,), (-1,)], "i int", F.hex(codecs.ack(F.col("i"))), codecs.read_ack(codecs.ack(F.col("i"))))
    assert [tuple(x) for x in acks] == [("41434B07", 7), ("41434BFF", 255), (None, None), (None, None)]
    assert values(spark, [(b"ACX\x01",), (b"ACK",), (b"ACK\x01\x02",)], "b binary", codecs.read_ack(F.col("b"))) == [None, None, None]


def test_message_bytes(spark):
    """Fixed bytes of every message."""
    hexed = lambda c: F.lower(F.hex(c))
    n = F.lit
    b = lambda s: F.lit(s.encode())
    peers = F.array(F.struct(n(1).alias("id"), n("a:1").alias("addr")), F.struct(n(-2).alias("id"), n("").alias("addr")))
    file = F.struct(n("n").alias("name"), n("hh").alias("object_hash"), n(5).cast("bigint").alias("size"), n("p/q").alias("remote_path"), n(6).cast("bigint").alias("mod_time"))
    got = values(
        spark, [(0,)], "x int", hexed(codecs.rpc(n(2), n(3), b("ab"))), hexed(codecs.lease(n(1), n("key"), n(2))), hexed(codecs.query(n(4), n(9), b("z"))), hexed(codecs.response(n(1), b("ab"), n("e"))),
        hexed(codecs.oprf_request(n(1), n(2), b("xy"))), hexed(codecs.oprf_response(n(1), n(2), n("no"), b(""))), hexed(codecs.heartbeat(peers)), hexed(codecs.ping(n(1), n(-1), n(2))), hexed(codecs.file_list(F.array(file))),
    )[0]
    assert tuple(got) == (
        "0000000703000000026162", "0000000000000001000000036b65790000000000000002", "0400000000000000097a", "0000000000000001000000026162000165",
        "000000000000000102000000027879", "00000000000000010200026e6f00000000", "00000002000000010003613a31fffffffe0000", "0000000000000001ffffffff0000000000000002",
        "00000001" "000000016e" "000000026868" "0000000000000005" "00000003702f71" "0000000000000006",
    )


def test_messages(spark):
    peers = [(k, f"10.0.0.{k}:1") for k in range(300)]
    df = spark.createDataFrame([(peers,)], "p array<struct<id:int,addr:string>>")
    sent = codecs.heartbeat(codecs.heartbeat_peers(F.col("p"), F.lit(3)))
    got = df.select(codecs.read_heartbeat(sent)).first()[0]
    assert [(g.id, g.addr) for g in got] == [p for p in peers if p[0] != 3][:256]
    one = values(spark, [(-3, 7, b"xyz")], "s int, k int, p binary", codecs.read_rpc(codecs.rpc(F.col("s"), F.col("k"), F.col("p"))), codecs.read_rpc(F.lit(b"\0" * 12)), codecs.read_query(codecs.query(F.lit(2), F.lit(1 << 62), F.col("p"))))[0]
    assert (one[0].sender, one[0].kind, bytes(one[0].payload)) == (-3, 7, b"xyz") and one[1] is None
    assert (one[2].kind, one[2].request_id, bytes(one[2].data)) == (2, 1 << 62, b"xyz")


def test_file_lists_are_checked(spark):
    """One bad entry makes a list undecodable; entries beyond the limits aren't sent."""
    def file(name="n", digest="h", size=1, path="", at=2):
        return name, digest, size, path, at

    kind = "f array<struct<name:string,object_hash:string,size:bigint,remote_path:string,mod_time:bigint>>"
    rows = [[file(), file("a" * 64, "b" * 64, 1 << 30, "p" * 4096)], [], [file(), file("x" * 65)], [file(), file("..")], [file("a\\b")], [file(digest="a/b")], [file(size=-1)], [file(size=(1 << 30) + 1)], [file(path="p" * 4097), file("k")]]
    got = values(spark, [(r,) for r in rows], kind, codecs.read_file_list(codecs.file_list(F.col("f"))))
    names = [None if x is None else [tuple(f) for f in x] for x in got]
    assert names == [rows[0], [], rows[2][:1], None, None, None, None, None, rows[8][1:]]
    cut = values(spark, [(rows[0],)], kind, *(codecs.read_file_list(F.substring(codecs.file_list(F.col("f")), 1, n)) for n in (3, 4, 40, 4285)))[0]
    assert list(cut) == [None] * 4
    assert values(spark, [(b"\x00\x00\x00\xc8",)], "b binary", codecs.read_file_list(F.col("b"))) == [None]


def test_paths_and_lists(spark):
    rows = [("a/\t/b",), ("\u2003a/ /b\u3000",), ("\t/\x85",), ("a\n/../b",), ("",), (" x y /z",)]
    assert [tuple(x) for x in values(spark, rows, "p string", strings.normalize_path(F.col("p")))] == [("a/b", None), ("a/b", None), (None, "EINVAL"), (None, "EINVAL"), ("", None), ("x y /z", None)]
    assert values(spark, [("5000000000, ,-7",), ("9223372036854775808",), ("1.5",), (" , ",)], "s string", strings.csv_ints(F.col("s"))) == [[5_000_000_000, -7], None, None, None]
    long = [("a" * 1023 + "\u00e9" + "b",), ("a" * 1022 + "\u00e9" + "b",), ("a" * 1021 + "\U0001f600" + "b",), (" a\r\nb\t ",)]
    assert values(spark, long, "s string", strings.clean_header(F.col("s"))) == ["a" * 1023, "a" * 1022 + "\u00e9", "a" * 1021, "a  b"]


def test_chunked_bodies():
    key, at = b"k" * 32, ("20240101T000000Z", "20240101/x/s3/aws4_request", "seed")
    for payload in (b"", b"hello world", b"\r\n0\r\n" * 40):
        body = chunked.frame(payload, 4, key, *at, trailers={"X-Sum": "1"})
        assert chunked.unframe(body, key, *at, trailers=True) == (payload, {"x-sum": "1"})
        assert chunked.unframe(body, trailers=True)[0] == payload == chunked.unframe(chunked.frame(payload, 3))[0]
        for cut in range(len(body)):
            with pytest.raises(chunked.Broken):
                chunked.unframe(body[:cut], key, *at, trailers=True)
    body = chunked.frame(b"hello world", 4, key, *at)
    for changed, reason in ((body.replace(b"hell", b"help"), "signature"), (body.replace(b"4;", b"5;", 1), "malformed"), (b"zz\r\n", "malformed"), (b"-1\r\n", "malformed"), (b"900000\r\n", "malformed"), (b"0" * 2000, "malformed")):
        with pytest.raises(chunked.Broken) as e:
            chunked.unframe(changed, key, *at)
        assert e.value.reason == reason
    with pytest.raises(chunked.Broken) as e:
        chunked.unframe(body, key, at[0], at[1], "other")
    assert e.value.reason == "signature"
    with pytest.raises(chunked.Broken) as e:
        chunked.unframe(body, max_size=5)
    assert e.value.reason == "size"


def test_process_lines():
    lines = counters.process_lines("store", 1.5, 7, 10, 20, 3, "h")
    assert len(lines) == 18 and lines[2] == "store_uptime_seconds 1.50" and lines[-1] == 'store_build_info{hostname="h"} 1'


KEY = bytes(range(32))


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 4097, 10_000])
def test_streams(spark, size):
    data = bytes(k % 251 for k in range(size))
    df = spark.createDataFrame([(data,)], "d binary").select("d", crypto.encrypt_stream(F.col("d"), KEY, F.lit(b"seedseed"), footer_aad=b"f").alias("s")).cache()
    assert bytes(df.select(crypto.decrypt_stream(F.col("s"), KEY, b"f")).first()[0]) == data
    raw = bytes(df.first().s)
    for bad in (raw[:-1], raw[:20], raw[:-40] + raw[-39:], raw[:30] + bytes([raw[30] ^ 1]) + raw[31:], b"\x09" + raw[1:]):
        assert bad == raw or spark.createDataFrame([(bad,)], "s binary").select(crypto.decrypt_stream(F.col("s"), KEY, b"f")).first()[0] is None


def test_older_streams(spark):
    data = b"z" * 5000
    df = spark.createDataFrame([(data,)], "d binary").select(crypto.encrypt_stream(F.col("d"), KEY, F.lit(b"seedseed"), footer_aad=b"f").alias("s"))
    raw = bytes(df.first().s)
    third, second = b"\x03" + raw[3:], b"\x02" + raw[3:-24]
    for old in (third, second):
        assert bytes(spark.createDataFrame([(old,)], "s binary").select(crypto.decrypt_stream(F.col("s"), KEY, b"f")).first()[0]) == data
    assert spark.createDataFrame([(third[:-24],)], "s binary").select(crypto.decrypt_stream(F.col("s"), KEY, b"f")).first()[0] is None


def test_keyed_hashes(spark):
    for key in (b"k", b"q" * 64, b"z" * 100):
        assert values(spark, [("data",)], "s string", crypto.hmac_sha256(key, F.col("s"))) == [hmac.new(key, b"data", hashlib.sha256).hexdigest()]
    assert crypto.hkdf(b"s", [b"a", b"bc"], 40) != crypto.hkdf(b"s", [b"ab", b"c"], 40)


def test_percent_encoding_and_authorization(spark):
    assert values(spark, [("a b/é~",)], "s string", crypto.percent_encode(F.col("s"), True), crypto.percent_encode(F.col("s"), False)) == [("a%20b%2F%C3%A9~", "a%20b/%C3%A9~")]
    good = "AWS4-HMAC-SHA256 Credential=AK/20240101/eu/s3/aws4_request, SignedHeaders=host;x, Signature=abc"
    got = values(spark, [(good,), (good.replace("Signature=abc", ""),), ("Basic x",)], "s string", crypto.parse_authorization(F.col("s")))
    assert tuple(got[0]) == ("AK", "20240101", "eu", "host;x", "abc") and got[1:] == [None, None]


def test_readers_compute_each_value_once(spark):
    """Lengths that follow from lengths aren't read anew for each use."""
    b = F.col("b")
    for reader, most in ((codecs.read_file_list, 6), (codecs.read_heartbeat, 5), (codecs.read_oprf_response, 4), (codecs.read_response, 3)):
        assert reader(b)._jc.toString().count("conv(") <= most
