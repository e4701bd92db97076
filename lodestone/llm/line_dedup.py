"""Line deduplication over overlapping windows of three lines, in DataFrame functions.

Every three consecutive lines of a text are a window; windows are compared by
two 64-bit hashes over all documents.  Of a window's occurrences the first, by
``(doc_id, position)`` with null ids last, stays; the lines that a later
occurrence covers go.  The lines that go are the union of the covered places,
so overlapping windows merge.  A text of fewer than three lines is one window
of all its lines.

Windows whose lines hold no word at all never count as repeats.  Rows with
equal id and text are one document and all get its result; of rows that tie by
id and place the one of the least text hash is the first.  Very long texts are
lines like others.  Null text has no
lines and stays null.  Empty tables give empty results; other columns are
carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import boxed, col, stash, text_hash

LINES = 3


def _windows(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """``(id, th, pos, a, b)`` for every window with a word in it."""
    df = docs.select(col(id_col).alias("id"), text_hash(col(text)).alias("th"), F.split(col(text), "\n").alias("l")).where("l is not null")
    # keep the hashes apart from the lines: a later step would split the text again for each of them
    df = df.select("id", "th", F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), x.rlike(r"[^\x20\x09-\x0D]").alias("w"))).alias("h"))
    last = F.greatest(F.size("h") - width, F.lit(0))

    def window(i: Column) -> Column:
        part = [F.get("h", i + k) for k in range(width)]
        some = part[0]["w"]
        for p in part[1:]:
            some = some | F.coalesce(p["w"], F.lit(False))
        return F.struct(F.xxhash64(*(p["a"] for p in part), F.least(F.size("h"), F.lit(width))).alias("a"), F.xxhash64(*(p["b"] for p in part)).alias("b"), some.alias("w"))

    df = df.select("id", "th", F.posexplode(F.transform(F.sequence(F.lit(0), last), window)).alias("pos", "x"))
    return df.where("x.w").select("id", "th", "pos", F.col("x.a").alias("a"), F.col("x.b").alias("b"))


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = LINES) -> DataFrame:
    """``(id, th, places)``: the line numbers, from 0, that go from each document that loses any."""
    wins = _windows(docs, id_col, text, width)
    place = F.struct(F.col("id").isNull().alias("n"), "id", "th", "pos")
    firsts = wins.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    firsts = stash(firsts.select("a", "b", "first"), "repeats")
    later = wins.join(firsts.hint("merge"), ["a", "b"]).where(place != F.col("first")).select("id", "th", "pos").distinct()
    runs = later.groupBy("id", "th").agg(F.collect_list("pos").alias("p"))  # at most the lines of one document
    covered = F.flatten(F.transform("p", lambda s: F.sequence(s, s + (width - 1))))
    return runs.select("id", "th", F.sort_array(F.array_distinct(covered)).alias("places"))


def _without(lines: Column, gone: Column) -> Column:
    """The lines between the places that go; an array of one binds its value, which then is computed once."""
    cuts = F.transform(F.array(lines), lambda x: F.struct(x.alias("x"), F.concat(F.array(F.lit(-1)), F.filter(gone, lambda p: p < F.size(x)), F.array(F.size(x))).alias("g")))
    parts = F.transform(cuts, lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.size(c["g"]) - 2), lambda k: F.slice(c["x"], F.get(c["g"], k) + 2, F.get(c["g"], k + 1) - F.get(c["g"], k) - 1))))
    return parts[0]


def _cleaned(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """``(row, id, t, gone, left)``: the places that go and the lines that are left; null where nothing goes."""
    gone = stash(repeated_places(docs, id_col, text, width), "places")
    rows = docs.select(boxed(docs), col(id_col).alias("id"), col(text).alias("t"), text_hash(col(text)).alias("th"))
    gone = gone.select(F.col("id").alias("gid"), F.col("th").alias("gth"), F.col("places").alias("gone"))
    # by merge at every size: what repeats grows with the corpus, so a broadcast would end at some size
    rows = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    return rows.select("row", "id", "t", "gone", F.when(F.col("gone").isNotNull(), _without(F.split("t", "\n"), F.col("gone"))).alias("left"))


def _new() -> Column:
    return F.when(F.col("left").isNotNull(), F.array_join("left", "\n")).otherwise(F.col("t"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = LINES) -> DataFrame:
    """Each row's id, lines before, lines removed and text after."""
    n = F.when(F.col("t").isNull(), 0).otherwise(F.size(F.split("t", "\n")))
    left = F.when(F.col("left").isNull(), n).otherwise(F.size("left"))
    return _cleaned(docs.select(col(id_col), col(text)), id_col, text, width).select(F.col("id").alias(id_col), n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_removed"), _new().alias(text))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = LINES) -> DataFrame:
    """``docs`` with repeated lines removed; a document that loses every line goes."""
    out = _cleaned(docs, id_col, text, width).where(F.col("left").isNull() | (F.size("left") > 0))
    names = docs.columns
    parts = [_new().alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names]
    return out.select(*parts)
