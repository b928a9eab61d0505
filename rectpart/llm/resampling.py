"""Importance resampling towards a target: documents are drawn by how much likelier their hashed n-grams are in target texts than in the corpus.

A document is scanned once. A ring holds the running zlib states of the runs that began at its last n words; each next word extends every state by a space and
itself and starts a state of its own, and each state gives the bucket of the run that ends there. Only a document's bucket counts are kept after that: they're summed
up for the corpus, and give the document's weight once all gains are known. Documents are then drawn by weight plus Gumbel noise made of their ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectpart.llm import terms, textops
from rectpart.operators.scan import Scratch, arrow_rows, global_rank

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Texts of about so many bytes are scanned before their counts are made.
SLICE_BYTES = 4 << 20
ROWS = 1000


def ring_states(words: Sequence[bytes], n: int) -> list[int]:
    """The checksums of all runs of 1 to n words, by the words at which they end."""
    out: list[int] = []
    ring: list[int] = []
    keep = n - 1
    for word in words:
        spaced = b" " + word
        ring = [crc32(word), *[crc32(spaced, state) for state in ring[:keep]]]
        out += ring
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features (long) and grams, an array of (bucket, n), for each row; null text has no words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = textops.buffers(batch.column(1))
            for i, j in textops.slices(offsets, SLICE_BYTES):
                part = batch.slice(i, j - i)
                n_words, sizes, keys = [], [], []
                for k, text in enumerate(part.column(1)):
                    words = terms.split(text.as_py())
                    states = np.array(ring_states(words, n), np.int64)
                    n_words.append(len(words))
                    sizes.append(len(states))
                    keys.append(states % buckets + k * buckets)
                key, count = np.unique(np.concatenate(keys), return_counts=True)
                row, bucket = np.divmod(key, buckets)
                grams = pa.StructArray.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(count.astype(np.int64))], names=["bucket", "n"])
                ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), grams)], names=["doc_id", "n_words", "n_features", "grams"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, n_words long, n_features long, grams array<struct<bucket:int,n:long>>")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs. Counts are summed up before they move; a row for each bucket comes to the driver."""
    out = np.zeros(buckets, np.int64)
    for r in found.select(F.inline("grams")).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the logarithm of its smoothed share of the target over that of the corpus, rounded down."""
    m, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + m) / ((s + 1) * (t_all + m)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the mean gain of a document's features, rounded down; 0 without features. `gain` has a number for each bucket."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("grams")
            flat, ends = grams.flatten(), np.diff(grams.offsets.to_numpy()).cumsum()
            total = np.concatenate([[0], np.cumsum(gain[flat.field("bucket").to_numpy()] * flat.field("n").to_numpy())])
            sums = np.diff(np.concatenate([[0], total[ends]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums // np.maximum(1, batch.column("n_features").to_numpy()))], names=["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (long): every row once, rank 1, 2, 3, ... for the `percent` of documents with at least `least_words` words that have the highest
    scores, null for the others.

    Ties go to smaller ids, then fewer features; a null id counts as the largest, and as an empty text where noise is made. Repeated rows each count and get ranks of their own. Null and
    empty texts have no words, weight 0 and no rank. An empty target leaves every gain to the corpus; an empty corpus gives no rows. Other columns aren't read.

    The draw is a range sort by score and id, which are only numbers; texts move nowhere.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    with arrow_rows(spark, ROWS):
        found = scratch.save(features(docs, id_col, text_col, n, buckets), "features")
        gain = gains(bucket_counts(found, buckets), bucket_counts(features(target.select(F.lit(0).alias("_id"), text_col), "_id", text_col, n, buckets), buckets))
        known = scratch.save(weighted(found, gain), "weights")
    scratch.drop("features")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")
    scored = known.withColumn("score", F.col("weight") + noise).withColumn("out", F.col("n_words") < least_words)
    drawn = scored.filter("not out").count() * percent // 100
    placed = global_rank(scored, [F.asc("out"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")])
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(~F.col("out") & (F.col("rank") < drawn), F.col("rank") + 1).alias("rank"))
