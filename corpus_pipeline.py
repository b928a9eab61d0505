"""A corpus pipeline of five operators: quality rules, near duplicates, repeated passages, source weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`, others that the table has included. Rows that repeat, have a
null or repeated id, or a null source go through all stages like others; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectpart.llm import jaccard, mixing, packing, quality, substrings
from rectpart.operators.scan import Scratch


def _retexted(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns in their order, n_chars counted anew."""
    if "n_chars" in columns:
        frame = frame.withColumn("n_chars", F.char_length("text").cast("long"))
    return frame.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts among them; failing lines go from the others, whose texts stay as they are if no line fails."""
    kept = quality.judged(docs).filter("_q.kept")
    return _retexted(kept.withColumn("text", F.when(F.col("_q.left_chars") < F.col("_q.word_chars"), F.col("_q.clean")).otherwise(F.col("text"))), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one document stays: that with the smallest id. Texts that are no copies of each other all stay, also under one id; rows without an id all stay."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that also start in a document with a smaller id are removed; halves of characters at the cuts go, too. Every row stays; a null text becomes empty."""
    text = F.col("kept").cast("string")
    left = substrings.remove_repeats(docs, carry=True).select("row.*", F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))).alias("text"))
    return _retexted(left, docs.columns)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stands as often as the mix takes it, which may be never; null texts have size 0."""
    mixed = mixing.copies_of(docs, carry=True).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in windows of 1024 ids, as op2_packing; a null text is its end id alone, a null id stays null."""
    pieces = packing.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_weights", source_weights),
    ("packing", pack),
]

#: SQL can't express the tokens of the last stage; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents. Each but the last is written as Parquet in the shared folder and read again, so that a lost executor costs no earlier stage."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
