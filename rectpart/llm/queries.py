"""The registered queries of this subpackage: thin calls of the operators with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rectpart.llm import binpack, decontamination, html, jaccard, langid, maxscore, mixing, oracles, packing, quality, resampling, substrings, toxicity, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(fold(4) != 2))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(fold(3) != 1))
    return langid.predict_languages(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *(F.col(f"_q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_chars"))
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies_of(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op8_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = binpack.segments(binpack.pack_matrices(table(spark, sf_dir, "documents")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    # from 2^52 on, every double is whole
    floored = F.transform("embedding", lambda x: F.when(F.abs(x) < float(1 << 44), F.floor(x.cast("double") * 256).cast("double")).otherwise(x.cast("double") * 256))
    good = F.when(maxscore.usable(F.col("embedding")), floored)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", good.alias("vector"))
    return maxscore.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity, "op2_packing": op2_packing, "op3_language": op3_language, "op4_substrings": op4_substrings, "op5_jaccard": op5_jaccard, "op6_quality": op6_quality, "op7_mixing": op7_mixing,
        "op8_matrices": op8_matrices, "op9_main_text": op9_main_text, "op10_maxscore": op10_maxscore, "op11_resampling": op11_resampling, "op12_decontamination": op12_decontamination, "op13_ranked_search": op13_ranked_search,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
