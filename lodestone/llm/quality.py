"""Quality rules by distribution divergence, in DataFrame functions only.

A text is rejected by the base rules (too few words, too many repeated
five-word windows), or if it is long enough and its histogram of character
classes, or of its language's most common words, lies too far from the
reference of its language by Jensen-Shannon distance (base 2, 0 to 1).  The
references are counted over all documents of the language; a language of fewer
than ``MIN_REFERENCE`` words has none and rejects nothing.

Null text counts as empty and fails the base rules; a null language is a
language of its own.  Repeated rows give repeated rows and count as often in
the references; of equally frequent words the first by name is the more
common.  Very long texts are rows like others.  Empty tables give empty results.
Columns that clash with the results are replaced in ``measure`` and kept as
they are in ``keep_good``; other names matter in neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import col, stash

MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
COMMON, MIN_REFERENCE = 16, 2_000
#: Divergence counts only for texts of so many words.
GUARD_WORDS = 60
#: A text with none of the common words is at 0.322 to 0.328; the labelled good texts of sf0.1 reach 0.311.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.32
_BLANK = r"[\x20\x09-\x0D]+"
_RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def _classes(df: DataFrame, text: str) -> DataFrame:
    """Adds ``word_chars``, ``n_symbols`` and the character-class counts ``__c``; each step strips what the one before has counted.

    Small letters and spaces go in one step, as whole stretches of a text; the spaces are counted apart.  The range
    beyond ASCII is far quicker than the same class negated.
    """
    steps = ("[a-z ]+", _BLANK, "[A-Z]+", r"[\x80-\x{10FFFF}]+", "[0-9]+", "[-.,;:!?'\"()]+")
    names = [text, *(f"__t{k}" for k in range(1, 7))]
    for new, old, p in zip(names[1:], names, steps, strict=False):
        df = df.withColumn(new, F.regexp_replace(old, p, ""))
    df = df.withColumn("__sp", (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long"))
    n = [F.length(c).cast("long") for c in names]
    spaces = F.col("__sp")
    blank = spaces + n[1] - n[2]
    return df.withColumns({
        "__c": F.array(n[0] - n[1] - spaces, blank, *(a - b for a, b in zip(n[2:], n[3:], strict=False)), n[-1]),
        "word_chars": n[0] - blank,
        "n_symbols": (n[-1] - F.length(F.regexp_replace(names[-1], "[#*$%&|<>]+", ""))).cast("long"),
    }).drop("__sp", *names[1:])


def _rows(docs: DataFrame, text: str, lang: str, carry: list[str]) -> DataFrame:
    """``(row, __t, __lang)``: the columns to carry in one, so that no name clashes."""
    row = F.struct(*(col(c) for c in carry)) if carry else F.lit(None)
    return docs.select(row.alias("row"), F.coalesce(col(text).cast("string"), F.lit("")).alias("__t"), F.coalesce(col(lang).cast("string"), F.lit("")).alias("__lang"))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, ref_class, ref_words, ref_hist)``: one row for each language, counted over all documents.

    ``ref_words`` has the hashes of its ``COMMON`` most frequent words (of equally frequent ones the first by
    name), ``ref_hist`` their counts and that of all other words.
    """
    rows = _rows(docs, text, lang, []).select("__lang", "__t")
    # the blanks at a text's ends give empty pieces, which go after the explode: a generator over the bare split is one tight loop
    words = rows.select("__lang", F.explode(F.split("__t", _BLANK)).alias("w")).where("w <> ''").groupBy("__lang", "w").agg(F.count(F.lit(1)).alias("c"))
    # characters are classed once for each different word; all others of a language are blanks
    classes = _classes(words, "w").groupBy("__lang").agg(F.sum("c").alias("n"), F.array(*(F.sum(F.col("c") * F.col("__c")[k]) for k in range(7))).alias("s"))
    chars = rows.groupBy("__lang").agg(F.sum(F.length("__t").cast("long")).alias("n_chars"))
    held = F.array(F.col("s")[0], F.col("n_chars") - _sum(F.col("s")), *(F.col("s")[k] for k in range(2, 7)))
    classes = classes.where(F.col("n") >= MIN_REFERENCE).join(chars, "__lang").select("__lang", "n", held.alias("ref_class"))
    order = Window.partitionBy("__lang").orderBy(F.desc("c"), "w")
    top = words.withColumn("k", F.row_number().over(order)).where(F.col("k") <= COMMON)
    top = top.groupBy("__lang").agg(F.array_sort(F.collect_list(F.struct("k", "w", "c"))).alias("a"))
    return classes.join(top, "__lang").select(
        F.col("__lang").alias("lang"), "ref_class", F.transform("a.w", lambda w: F.xxhash64(w)).alias("ref_words"), F.concat("a.c", F.array(F.col("n") - _sum(F.col("a.c")))).alias("ref_hist")
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if one of them sums to nothing."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    def of(s: Column) -> Column:
        shares = F.zip_with(s["p"], s["q"], lambda x, y: F.struct((x / s["a"]).alias("x"), (y / s["b"]).alias("y")))
        total = F.aggregate(shares, F.lit(0.0), lambda t, z: t + (part(z["x"], z["y"]) + part(z["y"], z["x"])))
        return F.when((s["a"] > 0) & (s["b"] > 0), F.sqrt(F.greatest(total / 2, F.lit(0.0))))

    # an array of one binds the sums and shares; inside the lambdas they would be computed again for every element
    held = F.array(F.struct(p.alias("p"), q.alias("q"), _sum(p).cast("double").alias("a"), _sum(q).cast("double").alias("b")))
    return F.transform(held, of)[0]


def _repeats(wins: str) -> Column:
    """Words in windows that occur twice or more; ``wins`` names a column with a hash for each window."""
    by_hash = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(s: Column) -> Column:
        return _sum(F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1), x + WINDOW) - x)))

    held = F.transform(F.array(by_hash), starts)  # an array of one binds its value, which then is computed once
    return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0).cast("long")).otherwise(F.transform(held, covered)[0])


def _windows(h: Column) -> Column:
    """A hash for each window of an array of word hashes."""
    n = F.size(h)
    wins = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    return F.when(n >= WINDOW, wins).otherwise(F.array().cast("array<bigint>"))


def _score(rows: DataFrame, refs: DataFrame) -> DataFrame:
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(F.array_remove(F.split("__t", _BLANK), ""), lambda w: F.xxhash64(w))
    # arrays of one again: inside, the values are plain objects that no step has to copy into a row
    df = _classes(rows, "__t").withColumns({
        "__s": F.transform(F.array(hashes), lambda h: F.struct(h.alias("h"), _windows(h).alias("v")))[0],
        "n_dup_lines": F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0],
    }).drop("__t")
    df = df.withColumns({"__h": F.col("__s.h"), "__v": F.col("__s.v"), "n_words": F.size("__s.h").cast("long")}).drop("__s")
    df = df.join(refs.withColumnRenamed("lang", "__lang"), "__lang", "left")
    # a count is what removing the word takes away: a plain loop over the hashes for each common word.  The lambdas
    # of n_repeat_words keep this step out of whole-stage code, whose one method with all the loops is too long for the JIT
    tally = F.array(*(F.size("__h") - F.size(F.array_remove("__h", F.get("ref_words", F.lit(k)))) for k in range(COMMON)))
    df = df.withColumns({
        "n_repeat_words": _repeats("__v"),
        "__k": F.when(F.col("ref_words").isNotNull() & (F.col("n_words") >= GUARD_WORDS), F.slice(tally, 1, F.size("ref_words")).cast("array<bigint>")),
    })
    df = df.withColumns({"class_distance": F.when(F.col("__k").isNotNull(), distance(F.col("__c"), F.col("ref_class"))), "word_distance": distance(F.concat("__k", F.array(F.col("n_words") - _sum(F.col("__k")))), F.col("ref_hist"))})
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    far = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > MAX_WORD_DISTANCE)
    return df.withColumn("kept", ~(F.col("base_failed") | far))


def measure(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Every row of ``docs`` without its text, with counts, distances and the verdict ``kept``."""
    carry = [c for c in docs.columns if c != text and c not in _RESULTS]
    out = _score(_rows(docs, text, lang, carry), stash(references(docs, text, lang), "references"))
    return out.select(*(["row.*"] if carry else []), *_RESULTS)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    out = _score(_rows(docs, text, lang, docs.columns), stash(references(docs, text, lang), "references"))
    # the running number keeps the filter above the steps that compute its verdict; below, it would hold all of
    # them again in one expression
    return out.withColumn("__n", F.monotonically_increasing_id()).where("kept and __n >= 0").select("row.*")
