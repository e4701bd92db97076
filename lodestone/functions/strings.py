"""String and path functions; limits are in bytes, as stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NAME, MAX_HASH, MAX_PATH, MAX_SIZE, MAX_HEADERS, MAX_HEADER = 64, 64, 4096, 1 << 30, 8192, 1024


# The characters that Unicode counts as white space, for patterns.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def trim_space(s: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(s, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def sanitize_log(s: Column) -> Column:
    """Control characters below 0x20 except tab become underscores; DEL stays."""
    return F.regexp_replace(s, r"[\x00-\x08\x0A-\x1F]", "_")


def has_traversal_chars(s: Column) -> Column:
    """Any slash or backslash, or exactly two dots."""
    return F.contains(s, F.lit("/")) | F.contains(s, F.lit("\\")) | (s == "..")


def is_unsafe_key(s: Column) -> Column:
    """What queries from peers refuse: two dots anywhere, or a backslash."""
    return F.contains(s, F.lit("..")) | F.contains(s, F.lit("\\"))


def normalize_path(p: Column) -> Column:
    """A struct of ``path`` and ``error``: empty stays empty; NUL, backslash or a ``..`` segment, or nothing left, is EINVAL."""
    t = trim_space(p)
    parts = F.split(t, "/", -1)
    bad = F.contains(t, F.lit("\x00")) | F.contains(t, F.lit("\\")) | F.array_contains(parts, "..")
    kept = F.filter(parts, lambda x: (x != ".") & ~x.rlike(rf"\A[{SPACE}]*\z"))
    error = F.when(t == "", None).when(bad | (F.size(kept) == 0), "EINVAL")
    return F.struct(F.when(t == "", "").when(error.isNull(), F.array_join(kept, "/")).alias("path"), error.alias("error"))


def pad(s: Column, n: int) -> Column:
    """``n`` bytes, NUL at the end; null where the text is longer."""
    b = s.cast("binary")
    return F.when(F.octet_length(b) <= n, F.rpad(b, n, F.lit(b"\x00")))


def pad_int(v: Column, n: int) -> Column:
    return pad(v.cast("string"), n)


def cut_at_null(s: Column) -> Column:
    return F.substring_index(s, "\x00", 1)


def parse_int(s: Column) -> Column:
    """A strict signed 64-bit integer before the first NUL; null for anything else."""
    t = cut_at_null(s)
    return F.when(t.rlike(r"^[+-]?[0-9]+\z"), t.try_cast("bigint"))


def replace_crlf(s: Column) -> Column:
    return F.translate(s, "\r\n", "  ")


def clean_header(s: Column) -> Column:
    """Cut at 1024 bytes, a character that the cut splits left out; line ends as blanks, trimmed."""
    b = s.cast("binary")
    tail = F.hex(F.substring(b, MAX_HEADER - 2, 4))  # the last three bytes kept and the first one lost
    lost = [F.substring(tail, 2 * k + 1, 2) for k in range(4)]
    inside = lambda x: x.between("80", "BF")
    # bytes of the character that the cut goes through: it goes through one if the byte behind it continues one
    over = F.when(~inside(lost[3]), 0).when(~inside(lost[2]), 1).when(~inside(lost[1]), 2).otherwise(3)
    cut = F.when(F.octet_length(s) > MAX_HEADER, F.decode(F.substring(b, F.lit(1), F.lit(MAX_HEADER) - over), "UTF-8")).otherwise(s)
    return trim_space(replace_crlf(cut))


def xml_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


# Error codes by HTTP status; any other status is an InternalError.
ERROR_CODES = {400: "InvalidArgument", 403: "AccessDenied", 404: "NoSuchKey", 405: "MethodNotAllowed", 409: "BucketNotEmpty", 413: "EntityTooLarge", 415: "InvalidRequest", 500: "InternalError", 503: "ServiceUnavailable"}


def error_code(status: Column) -> Column:
    """The code that an error document names for a status."""
    out = F.lit("InternalError")
    for number, code in ERROR_CODES.items():
        out = F.when(status == number, code).otherwise(out)
    return out


def csv_ints(s: Column) -> Column:
    """Comma-separated 64-bit integers without blanks; null if any isn't one or there is none."""
    parts = F.filter(F.transform(F.split(s, ",", -1), trim_space), lambda x: x != "")
    ints = F.transform(parts, lambda x: F.when(x.rlike(r"\A[+-]?[0-9]+\z"), x.try_cast("bigint")))
    return F.when((F.size(ints) > 0) & ~F.exists(ints, lambda x: x.isNull()), ints)


def _micros(ns: Column) -> Column:
    """Whole microseconds; integer division, as the one through double would round."""
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000)))


def last_modified_iso(ns: Column) -> Column:
    """ISO with milliseconds, truncated, in UTC."""
    return F.date_format(_micros(ns), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def last_modified_http(ns: Column) -> Column:
    return F.date_format(_micros(ns), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def split_bucket(host: Column, path: Column) -> Column:
    """A struct of ``bucket`` and ``key`` for virtual-host and path style."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    labels = F.split(name, r"\.", -1)
    dotted = F.contains(name, F.lit("."))
    virtual = F.when(dotted & (F.element_at(labels, -1) == "localhost"), labels[0]).when(dotted & F.contains(name, F.lit(".s3")), F.substring_index(name, ".s3", 1)).otherwise("")
    # clean: drop empty and "." segments, let ".." take the segment before it
    parts = F.filter(F.split(path, "/", -1), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    clean = F.aggregate(parts, empty, lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    by_path = F.struct(F.coalesce(F.get(clean, 0), F.lit("")).alias("bucket"), F.array_join(F.slice(clean, F.lit(2), F.greatest(F.size(clean) - 1, F.lit(0))), "/").alias("key"))
    return F.when(virtual == "", by_path).otherwise(F.struct(virtual.alias("bucket"), F.array_join(clean, "/").alias("key")))


def blob_path(h: Column) -> Column:
    """Two-character folders three deep; hashes under six characters stay flat."""
    return F.when(F.length(h) < 6, h).otherwise(F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), F.substring(h, 5, 2), h))


def encode_token(kind: Column, key: Column) -> Column:
    """A page token: the kind's letter (K key, P prefix) and the key, in base 64."""
    return F.base64(F.concat(kind, key).cast("binary"))


def decode_token(token: Column) -> Column:
    """A struct of ``kind`` and ``key``, null for anything but a token."""
    raw = F.try_to_binary(token, F.lit("base64"))
    text = F.try_validate_utf8(raw.cast("string"))
    kind = F.substring(text, 1, 1)
    return F.when((token != "") & kind.isin("K", "P"), F.struct(kind.alias("kind"), F.substring(text, F.lit(2), F.length(text)).alias("key")))


# Headers that are kept besides the x-amz-meta- ones, lower case.
STANDARD_HEADERS = ("content-type", "cache-control", "content-disposition", "content-encoding", "expires", "x-amz-server-side-encryption")


def collect_headers(headers: Column) -> Column:
    """Lower-case keys of the standard and metadata headers, values cleaned."""
    lower = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.transform_values(F.map_filter(lower, lambda k, v: (k.isin(*STANDARD_HEADERS) | F.startswith(k, F.lit("x-amz-meta-"))) & (v != "")), lambda _, v: clean_header(v))


def sse_status(headers: Column) -> Column:
    """0 where the encryption headers are fine, else the HTTP status: customer keys 400, KMS 501, other 400."""
    get = lambda k: F.coalesce(F.try_element_at(headers, F.lit(k)), F.lit(""))
    head = "x-amz-server-side-encryption"
    customer = (get(f"{head}-customer-algorithm") != "") | (get(f"{head}-customer-key") != "") | (get(f"{head}-customer-key-md5") != "")
    kms = get(f"{head}-aws-kms-key-id") != ""
    value = F.lower(get(head))
    return F.when(customer, 400).when((value == "") & ~kms, 0).when((value == "aws:kms") | kms, 501).when(value == "aes256", 0).otherwise(400)


def headers_from_json(s: Column) -> Column:
    """A header map of at most 8192 bytes; null for malformed or longer text."""
    return F.when(F.octet_length(s) <= MAX_HEADERS, F.from_json(s, "map<string,string>"))


def headers_to_json(m: Column) -> Column:
    """Null for an empty map and for one whose text is too long: nothing is written then."""
    s = F.to_json(m)
    return F.when((F.size(m) > 0) & (F.octet_length(s) <= MAX_HEADERS), s)


def mode_byte(code: Column) -> Column:
    """A handshake's mode: digits are replication modes, letters are requests."""
    return F.when(code.rlike("^[0-9]$"), F.ascii(code) - 48).when(code.isin("L", "D", "G", "O"), F.ascii(code))


def upload_error(name: Column, object_hash: Column, size: Column) -> Column:
    """Why an upload is refused, or null."""
    bad_hash = (object_hash == "") | object_hash.rlike(r"[./\\]")
    bad_name = name.isin("", ".", "..") | F.contains(name, F.lit("../")) | F.contains(name, F.lit("\\"))
    return F.when(object_hash.isNull() | bad_hash, "hash").when(name.isNull() | bad_name, "name").when(size.isNull() | (size < 0) | (size > MAX_SIZE), "size")


def row_error(name: Column, object_hash: Column, path: Column, size: Column) -> Column:
    """Why a listed row from a peer is refused, or null."""
    return (
        F.when((F.octet_length(name) > MAX_NAME) | (name == ""), "name")
        .when(F.octet_length(object_hash) > MAX_HASH, "hash")
        .when(F.octet_length(path) > MAX_PATH, "path")
        .when(is_unsafe_key(name) | is_unsafe_key(path), "traversal")
        .when((size < 0) | (size > MAX_SIZE), "size")
    )
