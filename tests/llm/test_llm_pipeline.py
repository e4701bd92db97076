"""The pipeline against plain versions of its stages, one after the other."""

from __future__ import annotations

import hashlib
import random

import brute
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import quality
from lodestone.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def plain(rows: list[tuple[int, str | None, str | None]], items: list[tuple[int, str]]) -> dict[int, str | None]:
    """What the first four stages leave of ``(id, text, lang)``."""
    bounds = quality.COMMON, quality.MIN_REFERENCE, quality.GUARD_WORDS, quality.MAX_CLASS_DISTANCE, quality.MAX_WORD_DISTANCE
    good = [(i, t) for (i, t, _), ok in zip(rows, brute.good(rows, *bounds), strict=True) if ok]
    left = {i: t for i, (n, gone, t) in brute.without_repeats(good).items() if not (n and n == gone)}
    left = {i: left[i] for i in brute.first_of_copies(list(left.items()))}
    dirty = brute.contamination(list(left.items()), items)
    return {i: t for i, t in left.items() if not dirty[i][3]}


def check(got: dict, left: dict) -> None:
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert got.keys() == left.keys()
    for i, t in left.items():
        assert got[i].ids == lib.encode(t, add_special_tokens=False).ids
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = plain([(r.doc_id, r.text, r.lang) for r in docs.collect()], items)
    check({r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}, left)


def test_pipeline_with_edges(spark, tmp_path):
    """Nulls, ties, rows twice, near copies and other columns in the input."""
    rnd = random.Random(31)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()][:80]
    long = [(i, t, x) for i, t, x in rows if t and len(t.split()) > 100][:20]
    for i, t, x in long:
        w = t.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        rows.append((1000 + i, " ".join(w), x))
    rows += [(2000, None, "en"), (2001, "", None), (2002, " \n ", "en"), (2003, "short", "en"), (2004, long[0][1], None), (2005, "one two three " * 30, "xx")]
    twice = [long[1], long[2], (2000, None, "en")]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(9, None), (10, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, row int"
    spark.createDataFrame([(*r, "s", 0, "x", 1) for r in rows + twice], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len({r.doc_id for r in got})
    bounds = quality.COMMON, quality.MIN_REFERENCE, quality.GUARD_WORDS, quality.MAX_CLASS_DISTANCE, quality.MAX_WORD_DISTANCE
    verdicts = brute.good(rows + twice, *bounds)  # rows twice count twice in the references
    good = [(i, t) for (i, t, _), ok in zip(rows, verdicts, strict=False) if ok]
    left = {i: t for i, (n, gone, t) in brute.without_repeats(good).items() if not (n and n == gone)}
    left = {i: left[i] for i in brute.first_of_copies(list(left.items()))}
    dirty = brute.contamination(list(left.items()), items)
    check({r.doc_id: r for r in got}, {i: t for i, t in left.items() if not dirty[i][3]})


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        empty = stage(spark, docs.where("false"), SF)
        assert empty.count() == 0
