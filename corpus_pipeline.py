"""Five stages from raw documents to tokens; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, line_dedup, quality, similar
from lodestone.llm._base import col, stash
from lodestone.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null text is empty and goes; a null language is one of its own.  Equal rows get one verdict.  Other columns,
    whatever their names, are carried along, here and in the stages after it; an empty table stays empty.
    """
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that lose all of theirs; n_chars follows the text.

    Of repeats the first by doc_id stays, null ids last; equal rows are one document.  A null text stays null.
    """
    out = line_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*(col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays.

    It is the one of least doc_id, nulls last, then of least text hash; of equal rows one stays.  Null, empty and
    blank texts are copies of each other.
    """
    return similar.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; a null text has no words and stays, equal rows get one verdict."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and their decoded text's digest for every row; a null text has no ids and decodes to an empty one."""
    out = bpe.encode(docs, tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: The encoding stage has no SQL; the whole is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
