"""Authenticated encryption, envelopes, keyed hashes and request signatures.

AES-GCM runs in the JVM.  Keyed hashes have no native function but two nested
digests: the padded keys are literals, so HMAC stays native as well.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import big_endian, bind, joined, read_int

STREAM_VERSION, CHUNK, SEED_BYTES, TAG_BYTES, NONCE_BYTES, FOOTER_INDEX = 4, 4096, 8, 16, 12, 0xFFFFFFFF


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def hmac_sha256(key: bytes, data: Column) -> Column:
    """Hex HMAC-SHA256 with one key for all rows."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data.cast("binary")), 256))), 256)


def peer_token(token: Column, label: str) -> Column:
    """The token that peers derive from a client's: a digest of token and label."""
    return F.sha2(F.concat(token, F.lit(label)).cast("binary"), 256)


def wire_name(tenant_key: bytes, path: Column) -> Column:
    """The name under which an encrypted object travels."""
    return hmac_sha256(tenant_key, path)


def hkdf(secret: bytes, parts: list[bytes], size: int = 32, salt: bytes = b"") -> bytes:
    """HKDF-SHA256 whose info has each part behind its length."""
    info = b"".join(len(p).to_bytes(4, "big") + p for p in parts)
    key = hmac.new(salt or b"\0" * 32, secret, hashlib.sha256).digest()
    out, block, n = b"", b"", 1
    while len(out) < size:
        block = hmac.new(key, block + info + bytes([n]), hashlib.sha256).digest()
        out, n = out + block, n + 1
    return out[:size]


def encrypt(data: Column, key: bytes) -> Column:
    """Nonce, ciphertext and tag in one value."""
    return F.aes_encrypt(data, F.lit(key), F.lit("GCM"))


def decrypt(data: Column, key: bytes) -> Column:
    """Null for anything that was changed."""
    return F.try_aes_decrypt(data, F.lit(key), F.lit("GCM"))


def _seal(data: Column, key: bytes | Column, nonce: Column, aad: bytes) -> Column:
    k = F.lit(key) if isinstance(key, bytes) else key
    sealed = F.aes_encrypt(data, k, F.lit("GCM"), F.lit("DEFAULT"), nonce, F.lit(aad))
    return F.substring(sealed, F.lit(NONCE_BYTES + 1), F.octet_length(sealed))


def _frame(sealed: Column) -> Column:
    return F.concat(big_endian(F.octet_length(sealed), 4), sealed)


def encrypt_stream(data: Column, key: bytes | Column, seed: Column, chunk: int = CHUNK, footer_aad: bytes = b"") -> Column:
    """A stream of version 4: version, chunk size, seed, sealed chunks behind their lengths, and a footer that binds their number."""
    k = F.lit(key) if isinstance(key, bytes) else key

    def whole(x: Column) -> Column:
        n = F.ceil(F.octet_length(x["data"]) / chunk).cast("int")
        index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        one = lambda i: _frame(_seal(F.substring(x["data"], i * chunk + 1, F.lit(chunk)), x["key"], F.concat(x["seed"], big_endian(i, 4)), b""))
        footer = _frame(_seal(big_endian(n, 4), x["key"], F.concat(x["seed"], F.lit(b"\xff\xff\xff\xff")), footer_aad))
        return F.concat(F.lit(bytes([STREAM_VERSION, chunk >> 8, chunk & 255])), x["seed"], joined(F.transform(index, one)), footer)

    return bind(F.struct(data.alias("data"), k.alias("key"), seed.alias("seed")), whole)


def decrypt_stream(stream: Column, key: bytes | Column, footer_aad: bytes = b"") -> Column:
    """The plain data; null for a stream that is cut, reordered or changed.

    Version 4 names its chunk size, versions 2 and 3 have 4096 bytes; version 2 has no footer, so a cut between
    its chunks can't be told.
    """
    k = F.lit(key) if isinstance(key, bytes) else key
    return bind(F.struct(stream.alias("stream"), k.alias("key")), lambda x: _opened(x["stream"], x["key"], footer_aad))


def _opened(stream: Column, key: Column, footer_aad: bytes) -> Column:
    version = read_int(stream, 0, 1)
    newest = version == STREAM_VERSION
    total = F.octet_length(stream)
    head = F.when(newest, 3 + SEED_BYTES).otherwise(1 + SEED_BYTES)
    parts = F.struct(
        F.when(newest, read_int(stream, 1, 2)).otherwise(CHUNK).alias("size"), head.alias("head"), F.substring(stream, head - (SEED_BYTES - 1), F.lit(SEED_BYTES)).alias("seed"),
        (total - head - F.when(version == 2, 0).otherwise(4 + 4 + TAG_BYTES)).alias("body"), version.alias("version"),
    )

    def whole(x: Column) -> Column:
        frame = x["size"] + 4 + TAG_BYTES
        n = F.ceil(x["body"] / frame).cast("int")
        index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

        def opened(at: Column, length: Column, nonce: Column, aad: bytes) -> Column:
            declared = read_int(stream, at.cast("int"), 4) == length
            return F.when(declared, F.try_aes_decrypt(F.concat(nonce, F.substring(stream, (at + 5).cast("int"), length.cast("int"))), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad)))

        def chunk(i: Column) -> Column:
            at = x["head"] + i * frame
            return opened(at, F.least(frame, x["head"] + x["body"] - at) - 4, F.concat(x["seed"], big_endian(i, 4)), b"")

        end = opened(x["head"] + x["body"], F.lit(4 + TAG_BYTES), F.concat(x["seed"], F.lit(b"\xff\xff\xff\xff")), footer_aad)
        closed = (x["version"] == 2) | F.coalesce(end == big_endian(n, 4), F.lit(False))
        good = x["version"].isin(2, 3, STREAM_VERSION) & (x["body"] >= 0) & closed
        return F.when(good, bind(F.transform(index, chunk), lambda p: F.when(~F.exists(p, lambda c: c.isNull()), joined(p))))

    return bind(parts, whole)


def envelope(data: Column, master: bytes, data_key: Column, key_id: str, seed: Column, magic: bytes, footer_aad: bytes = b"") -> Column:
    """Magic, version, algorithm, lengths, key id and wrapped key, then the data as a stream under its own key."""
    wrapped = encrypt(data_key, master)
    kid = key_id.encode()
    return F.concat(F.lit(magic + b"\x01\x01" + len(kid).to_bytes(2, "big")), big_endian(F.octet_length(wrapped), 2), F.lit(kid), wrapped, encrypt_stream(data, data_key, seed, footer_aad=footer_aad))


def open_envelope(data: Column, master: bytes, magic: bytes, footer_aad: bytes = b"") -> Column:
    """A struct ``key_id, content``; null for another magic, content null where anything was changed."""
    m = len(magic)

    def opened(b: Column) -> Column:
        kid, wrap = read_int(b, m + 2, 2).cast("int"), read_int(b, m + 4, 2).cast("int")
        key = decrypt(F.substring(b, F.lit(m + 7) + kid, wrap), master)
        stream = F.substring(b, F.lit(m + 7) + kid + wrap, F.octet_length(b))
        return F.when(is_envelope(b, magic), F.struct(F.decode(F.substring(b, F.lit(m + 7), kid), "UTF-8").alias("key_id"), decrypt_stream(stream, key, footer_aad).alias("content")))

    return bind(data, opened)


def is_envelope(data: Column, magic: bytes) -> Column:
    return F.substring(data, 1, len(magic)) == F.lit(magic)


def percent_encode(s: Column, slash: bool) -> Column:
    """Unreserved bytes stay, all others turn to %XX."""
    keep = r"^[A-Za-z0-9_.~-]$" if slash else r"^[A-Za-z0-9_.~/-]$"
    pairs = F.regexp_extract_all(F.hex(s.cast("binary")), F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(pairs, lambda x: F.when(F.decode(F.unhex(x), "ISO-8859-1").rlike(keep), F.decode(F.unhex(x), "ISO-8859-1")).otherwise(F.concat(F.lit("%"), x))), "")


def canonical_query(params: Column) -> Column:
    """Sorted, encoded parameters without the signature's own."""
    kept = F.map_filter(params, lambda k, _: k != "X-Amz-Signature")
    return F.array_join(F.transform(F.sort_array(F.map_entries(kept)), lambda e: F.concat(percent_encode(e["key"], True), F.lit("="), percent_encode(e["value"], True))), "&")


def canonical_request(method: Column, path: Column, params: Column, headers: Column, signed: Column, payload_hash: Column) -> Column:
    names = F.sort_array(F.split(signed, ";"))
    lines = F.array_join(F.transform(names, lambda h: F.concat(h, F.lit(":"), F.trim(F.coalesce(F.try_element_at(headers, h), F.lit(""))), F.lit("\n"))), "")
    return F.concat_ws("\n", method, percent_encode(F.when(path == "", "/").otherwise(path), False), canonical_query(params), lines, signed, payload_hash)


def string_to_sign(request: Column, amz_date: Column, region: str) -> Column:
    day = F.substring(amz_date, 1, 8)
    return F.concat_ws("\n", F.lit("AWS4-HMAC-SHA256"), amz_date, F.concat(day, F.lit(f"/{region}/s3/aws4_request")), F.sha2(request, 256))


def signing_key(secret: str, day: str, region: str) -> bytes:
    key = f"AWS4{secret}".encode()
    for part in (day, region, "s3", "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return key


def signature(secret: str, day: str, region: str, to_sign: Column) -> Column:
    """For requests of one day; the key is derived once."""
    return hmac_sha256(signing_key(secret, day, region), to_sign)


def parse_authorization(header: Column) -> Column:
    """A struct ``access_key, day, region, signed_headers, signature``; null for an incomplete header."""
    part = lambda name: F.regexp_extract(header, rf"[ ,]{name}=([^,]*)", 1)
    cred = F.split(part("Credential"), "/", -1)
    good = F.startswith(header, F.lit("AWS4-HMAC-SHA256 ")) & (F.size(cred) >= 5) & (cred[0] != "") & (part("SignedHeaders") != "") & (part("Signature") != "")
    return F.when(good, F.struct(cred[0].alias("access_key"), F.get(cred, 1).alias("day"), F.get(cred, 2).alias("region"), F.trim(part("SignedHeaders")).alias("signed_headers"), F.trim(part("Signature")).alias("signature")))
