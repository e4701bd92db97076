"""The quality rules do no step once more for each element or document, and count what plain versions count."""

from __future__ import annotations

from collections import Counter, defaultdict

import brute
from pyspark.sql import functions as F

from lodestone.llm import quality


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distance_sums_once(spark):
    df = spark.createDataFrame([([1, 2], [3, 4])], "p array<bigint>, q array<bigint>")
    text = plan(df.select(quality.distance(F.col("p"), F.col("q"))))
    assert text.count("aggregate(p#") == text.count("aggregate(q#") == 1


def test_references_class_words_not_documents(spark):
    df = spark.createDataFrame([("a b", "en")], "text string, lang string")
    text = plan(quality.references(df))
    assert "regexp_replace(w#" in text
    assert "regexp_replace(__t#" not in text


def test_references_of_odd_texts(spark):
    odd = [" lead and trail\t", "\n\n", "", None, "\x0b\x0cTabs\rÄÖ é\U0001f600\U0001f600 x#$ 12.5 (a) \u2003wide\u2003 nb\xa0sp", "a  b   c \x00\x7f\x80", "'quoted'  \"so\"! [x]{y}~"]
    docs = [(t, lang) for t in odd for lang in ("en", "fr", None)] + [("the quick brown fox jumps " * 500, "en"), ("le renard brun saute haut " * 500, None)]
    got = {r.lang: r for r in quality.references(spark.createDataFrame(docs, "text string, lang string")).collect()}
    words, chars = defaultdict(Counter), defaultdict(lambda: [0] * 7)
    for t, lang in docs:
        words[lang or ""].update(brute.WORD.findall(t or ""))
        chars[lang or ""] = [a + b for a, b in zip(chars[lang or ""], brute.classes(t or ""), strict=True)]
    assert set(got) == {"en", ""}
    for lang, r in got.items():
        top = sorted(words[lang].items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON]
        assert r.ref_class == chars[lang]
        assert r.ref_hist == [n for _, n in top] + [words[lang].total() - sum(n for _, n in top)]
