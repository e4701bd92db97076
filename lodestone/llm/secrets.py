"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong kinds are reported wherever they stand: ``assign`` (a key word, a sign
and a value of six characters or more), ``access`` (access key ids) and ``hex``
(runs of 24 or more hexadecimal digits).  Weak kinds are ``ident`` (client,
account or user names given to a key), ``secret`` (forty mixed base-64
characters) and ``endpoint`` (service addresses).  A weak candidate is reported
only where its complementary parts lie in its scope: an ident needs a secret,
a secret an identifier, an endpoint both.  A scope is a stretch without a blank
line (which may hold blanks, tabs and carriage returns); parts join by
intervals, at most ``REACH`` code points apart.

The interval join runs inside each row: weak candidates and parts are sorted by
start, and running maxima and minima give each candidate its nearest part on
either side.  Sums and extremes run over blocks of ``BLOCK`` elements, so a text
of very many matches stays close to linear.

Places are code points.  Null text counts as empty.  Spans of one start are in
the order of KINDS.  Repeated rows give repeated rows, empty tables empty
results; a column ``spans`` is replaced, all others are carried along whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import col

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
REACH, BLOCK, FAR = 300, 128, 1 << 40
# The patterns of the strong kinds; the others are this module's own.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
IDENT = r"""(?i)(access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
SECRET = "[A-Za-z0-9+/]{40,}"
ENDPOINT = r"(https?|ftp|jdbc:[a-z]+|mongodb|redis|postgres)://[A-Za-z0-9._/:?=&%~-]+"
#: A line without a word ends a scope.
BREAK = r"\n[\x20\t\r]*\n"
_NONE = "array<struct<s:bigint,e:bigint,m:string,g:string>>"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, as the only element of an array."""
    return F.transform(F.array(value), f)[0]


def running(a: Column, zero: int, step: Callable[[Column, Column], Column]) -> Column:
    """For each element of a bigint array the fold of all before it, in blocks of BLOCK."""
    start = F.lit(zero).cast("bigint")

    def scan(x: Column) -> Column:
        init = F.struct(F.array().cast("array<bigint>").alias("a"), start.alias("t"))
        return F.aggregate(x, init, lambda s, v: F.struct(F.concat(s["a"], F.array(s["t"])).alias("a"), step(s["t"], v).alias("t")))["a"]

    def fold(x: Column) -> Column:
        return F.aggregate(x, start, step)

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, BLOCK))

    def whole(x: Column) -> Column:
        return bind(blocks(x), lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, fold)), lambda b, t: F.transform(scan(b), lambda v: step(t, v)))))

    return bind(a, lambda x: F.when(F.size(x) == 0, F.array().cast("array<bigint>")).otherwise(whole(x)))


def spans(text: Column, pattern: str, group: int) -> Column:
    """Leftmost non-overlapping matches: start, end, match and group."""
    p = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("g"))

    def placed(z: Column) -> Column:
        ends = running(F.transform(z, lambda x: (F.length(x["p"]) + F.length(x["m"])).cast("bigint")), 0, lambda a, b: a + b)
        return F.zip_with(z, ends, lambda x, o: F.struct((o + F.length(x["p"])).alias("s"), (o + F.length(x["p"]) + F.length(x["m"])).alias("e"), x["m"].alias("m"), x["g"].alias("g")))

    return bind(F.filter(zipped, lambda x: x["m"].isNotNull()), placed)


def _beside(weak: Column, parts: Column, text: Column) -> Column:
    """The weak spans that have a part within REACH in their scope."""
    both = F.sort_array(F.concat(F.transform(weak, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(False).alias("p"), x["m"].alias("m"), x["g"].alias("g"))), F.transform(parts, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(True).alias("p"), x["m"].alias("m"), x["g"].alias("g")))))

    def open_gap(a: Column, b: Column) -> Column:
        return (b - a <= REACH) & ((b <= a) | ~F.substring(text, (a + 1).cast("int"), (b - a).cast("int")).rlike(BREAK))

    def near(z: Column) -> Column:
        ends = running(F.transform(z, lambda x: F.when(x["p"], x["e"]).otherwise(F.lit(-FAR))), -FAR, lambda a, b: F.greatest(a, b))
        starts = F.reverse(running(F.reverse(F.transform(z, lambda x: F.when(x["p"], x["s"]).otherwise(F.lit(FAR)))), FAR, lambda a, b: F.least(a, b)))
        rows = F.zip_with(F.zip_with(z, ends, lambda x, a: F.struct(x.alias("x"), a.alias("a"))), starts, lambda y, b: F.struct(y["x"].alias("x"), y["a"].alias("a"), b.alias("b")))
        kept = F.filter(rows, lambda r: ~r["x"]["p"] & (open_gap(r["a"], r["x"]["s"]) | open_gap(r["x"]["e"], r["b"])))
        return F.transform(kept, lambda r: F.struct(r["x"]["s"].alias("s"), r["x"]["e"].alias("e"), r["x"]["m"].alias("m"), r["x"]["g"].alias("g")))

    return F.when((F.size(weak) > 0) & (F.size(parts) > 0), bind(both, near)).otherwise(F.array().cast(_NONE))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: an array of (start, end, kind, matched text) by start, then kind as in KINDS."""
    none = F.array().cast(_NONE)
    t = F.col("__t")
    signs = F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))
    names = [c for c in docs.columns if c != "spans"]
    df = docs.select(F.struct(*(col(c) for c in names)).alias("row"), F.coalesce(col(text).cast("string"), F.lit("")).alias("__t"))
    df = df.withColumns({
        "__assign": F.when(signs & t.rlike("(?i)passw|secret|token|api_?key"), F.filter(spans(t, ASSIGN, 2), lambda x: F.length(x["g"]) >= 6)).otherwise(none),
        "__access": F.when(F.contains(t, F.lit("AKIA")), F.filter(spans(t, ACCESS, 0), lambda x: F.length(x["m"]) >= 20)).otherwise(none),
        # a run is long enough or not from its start on, so the short ones needn't be matched
        "__hex": F.when(t.rlike("[0-9a-f]{24}"), spans(t, "[0-9a-f]{24,}", 0)).otherwise(none),
        "__ident": F.when(signs & t.rlike("(?i)_?id|user_?name|login"), F.filter(spans(t, IDENT, 2), lambda x: F.length(x["g"]) >= 4)).otherwise(none),
        "__secret": F.when(t.rlike("[A-Za-z0-9+/]{40}"), F.filter(spans(t, SECRET, 0), lambda x: (F.length(x["m"]) == 40) & x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]") & x["m"].rlike("[0-9]"))).otherwise(none),
    })
    df = df.withColumns({"__ids": F.concat("__access", "__ident"), "__keys": F.concat("__assign", "__hex", "__secret")})
    some = (F.size("__ids") > 0) & (F.size("__keys") > 0)
    df = df.withColumn("__endpoint", F.when(some & F.contains(t, F.lit("://")), spans(t, ENDPOINT, 0)).otherwise(none))
    df = df.withColumns({
        "__linked_ident": F.when(some, _beside(F.col("__ident"), F.col("__keys"), t)).otherwise(none),
        "__linked_secret": F.when(some, _beside(F.col("__secret"), F.col("__ids"), t)).otherwise(none),
        "__linked_endpoint": F.when(some & (F.size("__endpoint") > 0), bind(_beside(F.col("__endpoint"), F.col("__ids"), t), lambda x: _beside(x, F.col("__keys"), t))).otherwise(none),
    })

    def of_kind(k: int, c: str) -> Column:
        return F.transform(c, lambda x: F.struct(x["s"].alias("start"), F.lit(k).alias("k"), x["e"].alias("end"), F.lit(KINDS[k]).alias("kind"), x["m"].alias("match")))

    found = [of_kind(k, c) for k, c in enumerate(("__assign", "__access", "__hex", "__linked_ident", "__linked_secret", "__linked_endpoint"))]
    df = df.withColumn("__all", F.sort_array(F.concat(*found)))
    return df.select("row.*", F.transform("__all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["match"].alias("match"))).alias("spans"))


def joined(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
