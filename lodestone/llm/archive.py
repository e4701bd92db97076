"""Legacy archives to WARC: ARC files are parsed and equivalent WARC records synthesised.

``read_arcs`` reads ARC files of a folder, packed or not, and ``to_arc`` makes
archives of version 1 or 2 from pages, each with its header record and every
page as an HTTP response whose head names the page's id.  ``convert`` takes
records of either version: the header names the version and the fields of a
record's line, whose last is the declared length; the record is taken by that
length alone, whatever its bytes are.  ``to_warc`` gives every record an
identifier (from its digest, id and address), a timestamp, a type and SHA-1
digests of payload and block.  ``write_warc`` writes WARC files of one gzip
member for each record, so that a record can be reached by its place;
``read_warc`` reads these and others back by their declared lengths and checks
both digests.

Payloads are bytes from end to end.  An HTTP response's payload is what follows
its head, any other record's all of its content, with type resource.  Of
responses of equal payload and at least ``MIN_REVISIT`` bytes the one of the
largest id stays, others revisit it and carry no payload; rows that tie for the
largest id all stay, and so do all if no row of a group has an id.  Null html is
an empty payload; a null url is written as ``-``.  Repeated rows give repeated
records.  Very long pages are records like others; a file may have any size, as
its records are read one by one.  Empty tables give empty results; only id, url
and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import col, new_path, stash

MIN_REVISIT, ARC_BYTES = 1000, 1 << 20
#: An empty gzip member.  It stands between the members of records, where gzip ignores it, and parts them for Spark's reader.
BETWEEN = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
_KEY = b"X-Page-Key:"
# The fields of a record's line by version.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_STAMP = "20240101000000"


def arc_header(version: int, name: str = "pages.arc") -> bytes:
    body = f"{version} 0 lodestone\n{' '.join(FIELDS[version])}\n\n".encode()
    line = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": _STAMP, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(line[f] for f in FIELDS[version]).encode() + b"\n" + body


def arc_record(version: int, url: str, payload: bytes, offset: int, name: str = "pages.arc") -> bytes:
    line = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": _STAMP, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(payload))}
    return b"%s\n%s\n" % (" ".join(line[f] for f in FIELDS[version]).encode(), payload)


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and content of each record after the header; ValueError on a broken archive."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no line end after {at}")
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        if not line:  # archives separate records by one or more empty lines
            at = end + 1
            continue
        names = fields or (FIELDS[1] if len(line.split(" ")) == len(FIELDS[1]) else FIELDS[2])
        values = line.rsplit(" ", len(names) - 1)  # a URL may hold spaces, the rest doesn't
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"bad record line at {at}: {line[:80]!r}")
        start, length = end + 1, int(values[-1])
        body = data[start : start + length]
        if len(body) < length:
            raise ValueError(f"record at {at} is cut short")
        at = start + length
        if fields is None:
            if not line.startswith("filedesc:"):
                raise ValueError("the first record is no file description")
            head = body.split(b"\n")
            fields = tuple(head[1].decode().split()) if len(head) > 1 and head[1].strip() else FIELDS[int(head[0].split()[0])]
            continue
        yield dict(zip(names, values, strict=True)), body


def http_response(key: int | None, payload: bytes) -> bytes:
    """A page as a server would have sent it; its id is a header."""
    own = b"" if key is None else b"%s %d\r\n" % (_KEY, key)
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (own, len(payload), payload)


def split_http(content: bytes) -> tuple[int | None, bytes, bytes]:
    """A record's id, HTTP head and payload; no head and no id where it is no HTTP response."""
    end = content.find(b"\r\n\r\n") if content.startswith(b"HTTP/") else -1
    if end < 0:
        return None, b"", content
    head = content[: end + 4]
    own = [x[len(_KEY) :].strip() for x in head.split(b"\r\n") if x.startswith(_KEY)]
    return int(own[0]) if own and own[0].lstrip(b"-").isdigit() else None, head, content[end + 4 :]


def to_arc(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", version: int | None = None) -> DataFrame:
    """Archives ``(arc binary)`` of about ARC_BYTES; versions alternate if none is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            parts, size = [], 0
            for last, (i, u, h) in enumerate(zip(*b.columns, strict=True), 1):
                v = version or 1 + turn % 2
                if not parts:
                    parts, size = [arc_header(v)], 0
                parts.append(arc_record(v, (u.as_py() or "-").replace("\n", "%0A").replace("\r", "%0D"), http_response(i.as_py(), (h.as_py() or "").encode()), size))
                size += len(parts[-1])
                if size >= ARC_BYTES or last == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["arc"])
                    parts, turn = [], turn + 1

    return pages.select(col(id_col).cast("long").alias("i"), col(url).cast("string").alias("u"), col(html).cast("string").alias("h")).mapInArrow(run, "arc binary")


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """``(arc binary)`` of every ARC file under a path, gzipped or not; a file may have two gigabytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("content").alias("arc"))


def _stamp(date: str) -> str:
    """An archive's date as WARC writes it; digits that are missing are the first of their kind."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(arcs: DataFrame, payload: bool = True) -> DataFrame:
    """Records ``(id, uri, stamp, mime, n_bytes, sha1, http, [payload])`` of all archives; ``http`` is the head, if there is one."""
    schema = pa.schema([("id", pa.int64()), ("uri", pa.string()), ("stamp", pa.string()), ("mime", pa.string()), ("n_bytes", pa.int64()), ("sha1", pa.string()), ("http", pa.binary()), *([("payload", pa.binary())] if payload else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = []
                for line, body in read_arc(data.as_py()):
                    key, head, body = split_http(body)
                    row = (key, line["URL"].encode("utf-8", "surrogateescape").decode("utf-8", "replace"), _stamp(line["Archive-date"]), line["Content-type"], len(body), hashlib.sha1(body).hexdigest(), head)
                    rows.append((*row, body) if payload else row)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return arcs.mapInArrow(run, "id long, uri string, stamp string, mime string, n_bytes long, sha1 string, http binary" + ", payload binary" * payload)


def to_warc(arcs: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``(id, record_type, refers_to, record binary)``: one gzip member for each archived record."""
    heads = convert(arcs, payload=False).where((F.col("n_bytes") >= min_revisit) & (F.octet_length("http") > 0))
    first = heads.groupBy("sha1", "n_bytes").agg(F.max(F.struct("id", "uri")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1 and keep.id is not null")
    first = stash(first.select("sha1", "n_bytes", "keep"), "copies")
    rows = convert(arcs).join(first, ["sha1", "n_bytes"], "left")
    revisit = F.col("keep").isNotNull() & (F.octet_length("http") > 0) & ~F.col("id").eqNullSafe(F.col("keep.id"))
    rows = rows.select("id", "uri", "stamp", "mime", "n_bytes", "sha1", F.when(revisit, F.col("keep.id")).alias("refers_to"), F.when(revisit, F.col("keep.uri")).alias("first_uri"), "http", F.when(~revisit, F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, out = [], []
            for row in zip(*b.columns, strict=True):
                kind, record = warc_record(*(x.as_py() for x in row))
                kinds.append(kind)
                out.append(member(record))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string()), b.column(6), pa.array(out, pa.binary())], ["id", "record_type", "refers_to", "record"])

    return rows.mapInArrow(run, "id long, record_type string, refers_to long, record binary")


def member(record: bytes) -> bytes:
    """A record as a gzip member that doesn't hold the mark between members."""
    for level, plan in ((6, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_DEFAULT_STRATEGY), (6, zlib.Z_HUFFMAN_ONLY), (1, zlib.Z_FIXED)):
        pack = zlib.compressobj(level, zlib.DEFLATED, 31, 8, plan)
        out = pack.compress(record) + pack.flush()
        if BETWEEN not in out:
            return out
    raise ValueError("a record can't be packed without the mark between records")


def _identifier(sha1: str, key: int | None, uri: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'lodestone:{sha1}:{key}:{uri}')}>"


def _sha1(block: bytes) -> str:
    return base64.b32encode(hashlib.sha1(block).digest()).decode()


def warc_record(key: int | None, uri: str, stamp: str, mime: str, n_bytes: int, sha1: str, refers_to: int | None, first_uri: str | None, http: bytes, payload: bytes | None) -> tuple[str, bytes]:
    """A record's type and its bytes with the closing blank lines; digests are in base 32 as archives have them."""
    kind = "revisit" if refers_to is not None else "response" if http else "resource"
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_identifier(sha1, key, uri)}", f"WARC-Date: {stamp}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", f"WARC-Block-Digest: sha1:{_sha1(block)}", f"X-Payload-Length: {n_bytes}"]
    if key is not None:
        lines.append(f"X-Page-Key: {key}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_identifier(sha1, refers_to, first_uri or '-')}", f"WARC-Refers-To-Target-URI: {first_uri}", f"X-Refers-To-Key: {refers_to}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if http else mime}", f"Content-Length: {len(block)}"]
    return kind, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of a gzip member for each record; the writer's line separator is the empty member."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", BETWEEN.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads and blocks of a WARC file, gzipped or not, by their declared lengths; decompressed piece by piece."""
    packed = data[:2] == b"\x1f\x8b"
    held, at, unzip, view = b"", 0, zlib.decompressobj(31), memoryview(data)

    def more() -> bool:
        nonlocal held, at, unzip
        while at < len(view):
            piece = view[at : at + (1 << 20)]
            at += len(piece)
            if not packed:
                held += bytes(piece)
                return True
            out = unzip.decompress(piece)
            if unzip.unused_data:
                at -= len(unzip.unused_data)
                unzip = zlib.decompressobj(31)
            if out:
                held += out
                return True
        return False

    start = 0
    while True:
        while (end := held.find(b"\r\n\r\n", start)) < 0:
            held, start = held[start:], 0
            if not more():
                if held.strip():
                    raise ValueError("a record's head is cut short")
                return
        lines = held[start:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record but {lines[0][:40]!r}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(head["content-length"])
        begin = end + 4
        while len(held) < begin + length + 4:
            held, begin, start = held[begin:], 0, 0
            if not more():
                raise ValueError("a record's block is cut short")
        yield head, held[begin : begin + length]
        if held[begin + length : begin + length + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        start = begin + length + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(id, record_type, n_bytes, sha1, refers_to, uri, record_id, stamp)`` of all records in the files; digests are verified.

    A row is a record where the files come from ``write_warc``, else a whole file.
    """
    schema = pa.schema([("id", pa.int64()), ("record_type", pa.string()), ("n_bytes", pa.int64()), ("sha1", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("record_id", pa.string()), ("stamp", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_row(head, block) for data in b.column(0) for head, block in _records(data.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    lines = spark.read.option("lineSep", BETWEEN.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return lines.select(F.col("value").cast("binary").alias("data")).mapInArrow(run, "id long, record_type string, n_bytes long, sha1 string, refers_to long, uri string, record_id string, stamp string")


def _row(head: dict[str, str], block: bytes) -> tuple:
    """A record's row; ValueError if its block or payload doesn't have its digest."""
    name, kind = head.get("warc-record-id"), head.get("warc-type")
    http = head.get("content-type", "").startswith("application/http")
    payload = split_http(block)[2] if http else block
    told = head.get("warc-block-digest", "").partition(":")
    if told[0] == "sha1" and told[2] != _sha1(block):
        raise ValueError(f"block of {name} doesn't have its digest")
    told = head.get("warc-payload-digest", "").partition(":")
    if told[0] == "sha1" and kind != "revisit" and told[2] != _sha1(payload):
        raise ValueError(f"payload of {name} doesn't have its digest")
    size = int(head.get("x-payload-length", 0)) if kind == "revisit" else len(payload)
    sha1 = base64.b32decode(told[2]).hex() if told[0] == "sha1" else hashlib.sha1(payload).hexdigest()
    number = [int(head[k]) if k in head else None for k in ("x-page-key", "x-refers-to-key")]
    return number[0], kind, size, sha1, number[1], head.get("warc-target-uri"), name, head.get("warc-date")


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages through ARC archives and WARC files; what the files say."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(to_warc(to_arc(pages, id_col, url, html)), path)
    return read_warc(pages.sparkSession, path)
