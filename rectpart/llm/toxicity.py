"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features: whether each hashed n-gram of 3 to 5 characters of the lower-cased text occurs. Each counts as its log-count ratio
r = ln((toxic documents with it + 1) / (toxic + 2)) - ln((others with it + 1) / (others + 2)); a logistic regression
is fitted on the features with the strongest evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectpart.llm import textops
from rectpart.operators.scan import Scratch

SIZES = (3, 4, 5)
BITS = 22
#: Bounds of the fit: labelled documents that are collected, characters of them, and features that are kept.
SAMPLE_ROWS, SAMPLE_CHARS, LONGEST_CHARS, FEATURES = 8_000, 30_000_000, 50_000, 6_000
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def hashed(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size, hash and row of every n-gram; ends of texts are padded with zeros."""
    pad = "\0" * (max(SIZES) - 1)
    texts = [(t or "").lower() for t in texts]
    codes = np.frombuffer((pad + pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + len(pad) for t in texts])  # n-grams that begin in the padding before a text are that text's
    h = codes.copy()
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in SIZES:
            x = h ^ (h >> np.uint32(15))
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            x = x * np.uint32(0x297A2D39 + 2 * n) >> np.uint32(32 - BITS)
            yield x, ends


def occurring(texts: list[str | None], step: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and hash of every n-gram that occurs in a row, once, a few rows at a time; made anew in each pass, as they take more memory than the texts."""
    for at in range(0, len(texts), step):
        part = []
        for x, ends in hashed(texts[at : at + step]):
            row = np.searchsorted(ends, np.arange(len(x)), "right")
            part.append(np.minimum(row, len(ends) - 1).astype(np.uint64) << np.uint64(32) | x)
        distinct = np.unique(np.concatenate(part))
        yield (distinct >> np.uint64(32)).astype(np.int32) + at, distinct.astype(np.uint32)


def fit(texts: list[str | None], labels: np.ndarray, l2: float = 2.0, steps: int = 300) -> Model:
    """labels: 0 or 1. Without both classes among them, or without an n-gram in two texts, the score is the share of ones everywhere."""
    y = np.asarray(labels, float)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    flat = Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not 0 < y.sum() < len(y):
        return flat
    with_it = np.zeros((2, 1 << BITS), np.int32)
    for row, x in occurring(texts):
        for c in (0, 1):
            with_it[c] += np.bincount(x[y[row] == c], minlength=1 << BITS).astype(np.int32)
    ones, zeros = y.sum(), len(y) - y.sum()
    p, q = (with_it[1] + 1) / (ones + 2), (with_it[0] + 1) / (zeros + 2)
    ratio = np.log(p / q)
    evidence = np.abs(ratio) / np.sqrt(1 / (with_it[1] + 1) + 1 / (with_it[0] + 1))
    evidence[with_it.sum(0) < 2] = 0
    if not evidence.any():
        return flat
    features = np.sort(np.argsort(-evidence, kind="stable")[: min(FEATURES, np.count_nonzero(evidence))]).astype(np.uint32)
    place = np.full(1 << BITS, -1, np.int32)
    place[features] = np.arange(len(features))
    kept = [(row[place[x] >= 0], place[x[place[x] >= 0]]) for row, x in occurring(texts)]
    rows, cols = (np.concatenate(c) for c in zip(*kept, strict=True))
    r = ratio[features]
    values = r[cols]
    # logistic regression by accelerated gradient steps; the curvature bound by power iteration
    v = np.ones(len(features))
    for _ in range(12):
        v /= np.linalg.norm(v) + 1e-12
        v = np.bincount(cols, values * np.bincount(rows, values * v[cols], len(y))[rows], len(features))
    rate = 1 / (np.linalg.norm(v) / 4 + len(y) / 4 + l2)
    w, b, w0, b0 = np.zeros(len(features)), flat.bias, np.zeros(len(features)), flat.bias
    for k in range(steps):
        m = k / (k + 3)
        u, c = w + m * (w - w0), b + m * (b - b0)
        miss = 1 / (1 + np.exp(-np.clip(np.bincount(rows, values * u[cols], len(y)) + c, -40, 40))) - y
        w0, b0 = w, b
        w, b = u - rate * (np.bincount(cols, values * miss[rows], len(features)) + l2 * u), c - rate * miss.sum()
    return Model(features, w * r, float(b))


def scores(model: Model, texts: list[str | None], place: np.ndarray) -> np.ndarray:
    """place: each hash's index in the model, or -1."""
    total = np.full(len(texts), model.bias)
    found = []
    for x, ends in hashed(texts):
        k = place[x]
        at = np.flatnonzero(k >= 0)
        row = np.minimum(np.searchsorted(ends, at, "right"), len(ends) - 1)
        found.append(row.astype(np.int64) << 32 | k[at])
    distinct = np.unique(np.concatenate(found))
    total += np.bincount(distinct >> 32, model.weights[distinct & 0xFFFFFFFF], len(texts)) if len(distinct) else 0
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> Model:
    """Fits on the labelled documents with the smallest hashes of their ids: SAMPLE_ROWS of them, and of these as many whole texts, in that order, as fit SAMPLE_CHARS characters.

    Texts of over LONGEST_CHARS characters aren't learned from; of an id with several texts, the first in their order is. Null labels are left out, null texts count as empty; no
    labelled rows: a score of 0.5. The ids are picked without their texts, and only the texts that fit come to the driver.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(label_col).cast("double").alias("y"))
    picked = textops.least_hashed(known.join(docs.select(F.col(id_col).alias("k")), "k", "left_semi"), "k", SAMPLE_ROWS)
    few = spark.createDataFrame([(r.k, r.y, r.h) for r in picked], "k long, y double, h long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.filter(F.char_length(text) <= LONGEST_CHARS).select(F.col(id_col).alias("k"), text.alias("t")).join(F.broadcast(few), "k")
    sample = scratch.save(found.groupBy("h", "k", "y").agg(F.min("t").alias("t")))
    chars, last = 0, None
    for r in sample.select("h", "k", "y", F.char_length("t").alias("n")).orderBy("h", "k", "y").collect():
        chars += r.n
        if chars > SAMPLE_CHARS and last is not None:
            break
        last = (r.h, r.k, r.y)
    rows = [] if last is None else sample.filter(F.struct("h", "k", "y") <= F.struct(F.lit(last[0]).cast("long").alias("h"), F.lit(last[1]).cast("long").alias("k"), F.lit(last[2]).alias("y"))).collect()
    scratch.close()
    rows.sort(key=lambda r: (r.h, r.k, r.y))
    texts, ys = [r.t for r in rows], [r.y for r in rows]
    return fit(texts, np.array(ys))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row: the probability of the label, from the whole text; null or empty text gets the score of a text without n-grams.

    One row for each input row, repeated rows and null ids included; other columns aren't read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[model.features] = np.arange(len(model.features))
        for batch in batches:
            column = batch.column(1)
            _, offsets = textops.buffers(column)
            got = [scores(model, column.slice(i, j - i).to_pylist(), place) for i, j in textops.slices(offsets, SLICE_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.concatenate(got) if got else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, "doc_id long, score double")
