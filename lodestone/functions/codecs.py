"""Binary records: fixed frames, message payloads and lists, built and read with native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import MAX_HASH, MAX_NAME, MAX_PATH, MAX_SIZE, cut_at_null, has_traversal_chars, is_unsafe_key, pad, pad_int

MAX_BEAT, MAX_PAYLOAD = 256, 1 << 20


def big_endian(v: Column, size: int) -> Column:
    """The last ``size`` bytes of an integer, highest first."""
    return F.unhex(F.right(F.lpad(F.hex(v.cast("bigint")), 16, "0"), F.lit(2 * size)))


def read_int(b: Column, at: Column | int, size: int) -> Column:
    """An integer of ``size`` bytes at a place from 0; eight bytes keep their sign."""
    place = (F.lit(at) if isinstance(at, int) else at) + 1
    text = F.conv(F.hex(F.substring(b, place, F.lit(size))), 16, -10 if size == 8 else 10)
    return text.cast("bigint")


def handshake(token: Column, stamp: Column, mode: Column) -> Column:
    """84 bytes: token 64, stamp 19, mode 1."""
    return F.concat(pad(token, 64), pad(stamp, 19), pad(mode, 1))


def metadata_frame(object_hash: Column, name: Column, size: Column) -> Column:
    """192 bytes: hash, name and size, 64 each."""
    return F.concat(pad(object_hash, 64), pad(name, 64), pad_int(size, 64))


def read_metadata(frame: Column) -> Column:
    """A struct ``object_hash, name, size``; null for another length."""
    part = lambda b, at: cut_at_null(F.decode(F.substring(b, at + 1, 64), "UTF-8"))
    return bind(frame, lambda b: F.when(F.octet_length(b) == 192, F.struct(part(b, 0).alias("object_hash"), part(b, 64).alias("name"), part(b, 128).try_cast("bigint").alias("size"))))


def ack(server: Column) -> Column:
    """Four bytes: a word and the server's id; null for an id beyond a byte."""
    return F.when(server.between(0, 255), F.concat(F.lit(b"ACK"), big_endian(server, 1)))


def read_ack(b: Column) -> Column:
    """The server's id; null for anything but an acknowledgement."""
    return bind(b, lambda b: F.when((F.octet_length(b) == 4) & (F.substring(b, 1, 3) == F.lit(b"ACK")), read_int(b, 3, 1)))


def _signed(v: Column) -> Column:
    """Four bytes as a signed number."""
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def _part(b: Column, at: Column | int, n: Column) -> Column:
    place = (F.lit(at) if isinstance(at, int) else at) + 1
    return F.substring(b, place.cast("int"), n.cast("int"))


def _text(b: Column, at: Column | int, n: Column) -> Column:
    return F.decode(_part(b, at, n), "UTF-8")


def _fits(b: Column) -> Column:
    return F.octet_length(b) <= MAX_PAYLOAD


def rpc(sender: Column, kind: Column, payload: Column) -> Column:
    """Length of what follows 4, kind 1, sender 4, payload."""
    return F.concat(big_endian(F.octet_length(payload) + 5, 4), big_endian(kind, 1), big_endian(sender, 4), payload)


def read_rpc(b: Column) -> Column:
    return _bound(b, lambda b: read_int(b, 0, 4), lambda b, n: F.when(n.between(5, 1 << 20) & (F.octet_length(b) >= 4 + n), F.struct(_signed(read_int(b, 5, 4)).alias("sender"), read_int(b, 4, 1).alias("kind"), _part(b, 9, n - 5).alias("payload"))))


def ping(ping_id: Column, target: Column, ts: Column) -> Column:
    """Id 8, target 4, time 8."""
    return F.concat(big_endian(ping_id, 8), big_endian(target, 4), big_endian(ts, 8))


def read_ping(b: Column) -> Column:
    return bind(b, lambda b: F.when(_fits(b) & (F.octet_length(b) >= 20), F.struct(read_int(b, 0, 8).alias("ping_id"), _signed(read_int(b, 8, 4)).alias("target"), read_int(b, 12, 8).alias("ts"))))


def lease(lease_id: Column, key: Column, expiry: Column) -> Column:
    """Id 8, key's length 4, key, expiry 8."""
    k = key.cast("binary")
    return F.concat(big_endian(lease_id, 8), big_endian(F.octet_length(k), 4), k, big_endian(expiry, 8))


def read_lease(b: Column) -> Column:
    return _bound(b, lambda b: read_int(b, 8, 4), lambda b, n: F.when(_fits(b) & (F.octet_length(b) >= 20 + n), F.struct(read_int(b, 0, 8).alias("lease_id"), _text(b, 12, n).alias("key"), read_int(b, (n + 12).cast("int"), 8).alias("expiry"))))


def query(kind: Column, request_id: Column, data: Column) -> Column:
    """Kind 1, id 8, data to the end."""
    return F.concat(big_endian(kind, 1), big_endian(request_id, 8), data)


def read_query(b: Column) -> Column:
    return bind(b, lambda b: F.when(_fits(b) & (F.octet_length(b) >= 9), F.struct(read_int(b, 0, 1).alias("kind"), read_int(b, 1, 8).alias("request_id"), _part(b, 9, F.octet_length(b)).alias("data"))))


def response(request_id: Column, data: Column, error: Column) -> Column:
    """Id 8, data's length 4, data, error's length 2, error."""
    e = error.cast("binary")
    return F.concat(big_endian(request_id, 8), big_endian(F.octet_length(data), 4), data, big_endian(F.octet_length(e), 2), e)


def read_response(b: Column) -> Column:
    second = lambda b, n: F.when(F.octet_length(b) >= 14 + n, read_int(b, (n + 12).cast("int"), 2))
    found = lambda b, n, m: F.when(_fits(b) & (F.octet_length(b) >= 14 + n + m), F.struct(read_int(b, 0, 8).alias("request_id"), _part(b, 12, n).alias("data"), _text(b, n + 14, m).alias("error")))
    return _bound(b, lambda b: read_int(b, 8, 4), second, found)


def oprf_request(request_id: Column, share: Column, blinded: Column) -> Column:
    """Id 8, share's index 1, length 4, blinded element."""
    return F.concat(big_endian(request_id, 8), big_endian(share, 1), big_endian(F.octet_length(blinded), 4), blinded)


def read_oprf_request(b: Column) -> Column:
    return _bound(b, lambda b: read_int(b, 9, 4), lambda b, n: F.when(_fits(b) & (F.octet_length(b) >= 13 + n), F.struct(read_int(b, 0, 8).alias("request_id"), read_int(b, 8, 1).alias("share_index"), _part(b, 13, n).alias("blinded"))))


def oprf_response(request_id: Column, share: Column, error: Column, evaluation: Column) -> Column:
    """Id 8, share's index 1, error's length 2, error, length 4, evaluation."""
    e = error.cast("binary")
    return F.concat(big_endian(request_id, 8), big_endian(share, 1), big_endian(F.octet_length(e), 2), e, big_endian(F.octet_length(evaluation), 4), evaluation)


def read_oprf_response(b: Column) -> Column:
    second = lambda b, m: F.when(F.octet_length(b) >= 15 + m, read_int(b, (m + 11).cast("int"), 4))
    found = lambda b, m, n: F.when(_fits(b) & (F.octet_length(b) >= 15 + m + n), F.struct(read_int(b, 0, 8).alias("request_id"), read_int(b, 8, 1).alias("share_index"), _text(b, 11, m).alias("error"), _part(b, m + 15, n).alias("evaluation")))
    return _bound(b, lambda b: read_int(b, 9, 2), second, found)


def heartbeat_peers(peers: Column, own: Column) -> Column:
    """The peers that a heartbeat names: the first 256 without the sender."""
    return F.slice(F.filter(peers, lambda p: p["id"] != own), 1, MAX_BEAT)


def heartbeat(peers: Column) -> Column:
    """Peers of ``(id, addr)``: their number 4, then id 4, address length 2 and address of each."""
    one = lambda p: F.concat(big_endian(p["id"], 4), big_endian(F.octet_length(p["addr"]), 2), p["addr"].cast("binary"))
    return F.concat(big_endian(F.size(peers), 4), joined(F.transform(peers, one)))


def read_heartbeat(b: Column) -> Column:
    """The peers of a heartbeat, walked record by record; null for a broken one."""

    def entry(b: Column, at: Column) -> Column:
        found = lambda at, size: _found(F.struct(_signed(read_int(b, at.cast("int"), 4)).alias("id"), _text(b, at + 6, size).alias("addr")), at + 6 + size, F.lit(True))
        return _bound(at, lambda at: read_int(b, (at + 4).cast("int"), 2), found)

    walk = lambda b, n: F.when(_fits(b) & (F.octet_length(b) >= 4) & (n * 6 <= F.octet_length(b) - 4), _walk(b, n, 4, "struct<id:bigint,addr:string>", entry))
    return _bound(b, lambda b: read_int(b, 0, 4), walk)


def file_list(files: Column) -> Column:
    """Files of ``(name, object_hash, size, remote_path, mod_time)``; those beyond the limits are left out.

    Their number 4, then name and hash behind lengths of 4, size 8, path behind its length, time 8.
    """

    def held(x: Column) -> Column:
        b = x.cast("binary")
        return F.concat(big_endian(F.octet_length(b), 4), b)

    kept = F.filter(files, lambda f: (F.octet_length(f["name"]) <= MAX_NAME) & (F.octet_length(f["object_hash"]) <= MAX_HASH) & (F.octet_length(f["remote_path"]) <= MAX_PATH))
    one = lambda f: F.concat(held(f["name"]), held(f["object_hash"]), big_endian(f["size"], 8), held(f["remote_path"]), big_endian(f["mod_time"], 8))
    return F.concat(big_endian(F.size(kept), 4), joined(F.transform(kept, one)))


def read_file_list(b: Column) -> Column:
    """The files of a list; null if any of its entries is cut, too long or unsafe."""
    kind = "struct<name:string,object_hash:string,size:bigint,remote_path:string,mod_time:bigint>"

    def entry(b: Column, at: Column) -> Column:
        long_ = lambda at: read_int(b, at.cast("int"), 4)

        def found(at: Column, a: Column, h_at: Column, h: Column, s_at: Column, p: Column) -> Column:
            t_at = s_at + 12 + p
            one = F.struct(_text(b, at + 4, a).alias("name"), _text(b, h_at + 4, h).alias("object_hash"), read_int(b, s_at.cast("int"), 8).alias("size"), _text(b, s_at + 12, p).alias("remote_path"), read_int(b, t_at.cast("int"), 8).alias("mod_time"))
            good = lambda f: (a <= MAX_NAME) & (h <= MAX_HASH) & (p <= MAX_PATH) & f["size"].between(0, MAX_SIZE) & ~has_traversal_chars(f["object_hash"]) & ~is_unsafe_key(f["name"])
            return bind(one, lambda f: _found(f, t_at + 8, good(f)))

        return _bound(at, long_, lambda at, a: at + 4 + a, lambda at, a, h_at: long_(h_at), lambda at, a, h_at, h: h_at + 4 + h, lambda at, a, h_at, h, s_at: long_(s_at + 8), found)

    walk = lambda b, n: F.when((F.octet_length(b) >= 4) & (n * 28 <= F.octet_length(b) - 4), _walk(b, n, 4, kind, entry))
    return _bound(b, lambda b: read_int(b, 0, 4), walk)


def joined(parts: Column) -> Column:
    """Binary parts one behind the other in one step; a fold would copy what is there for each of them."""
    return F.array_join(F.transform(parts, lambda x: x.cast("string")), "").cast("binary")


def bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, as the only element of an array; a lambda would compute it at every use."""
    return F.transform(F.array(value), f)[0]


def _bound(value: Column, *steps) -> Column:
    """Each step's value computed once from those before it; the last one's counts."""

    def after(held: tuple, left: tuple) -> Column:
        return left[0](*held) if len(left) == 1 else bind(left[0](*held), lambda x: after((*held, x), left[1:]))

    return bind(value, lambda x: after((x,), steps))


def _found(one: Column, behind: Column, good: Column) -> Column:
    return F.struct(one.alias("one"), behind.alias("behind"), good.alias("good"))


def _walk(b: Column, n: Column, start: int, kind: str, entry) -> Column:
    """``n`` entries from a place on; ``entry(b, at)`` gives one, the place behind it and whether it is good. Null if one isn't."""
    zero = F.struct(F.lit(start).cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("p"))

    def step(s: Column, _: Column) -> Column:
        def moved(x: Column) -> Column:
            fine = s["at"].isNotNull() & (x["behind"] <= F.octet_length(b)) & x["good"]
            return F.struct(F.when(fine, x["behind"]).alias("at"), F.concat(s["p"], F.array(x["one"])).alias("p"))

        return bind(entry(b, s["at"]), moved)

    end = F.aggregate(F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>")), zero, step)
    return bind(end, lambda x: F.when(x["at"].isNotNull(), x["p"]))
