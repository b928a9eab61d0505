"""Ranked lexical search by dual-sorted wavelet trees over shards of documents.

A shard's postings stand one list after another, each list by falling impact. A wavelet tree over their document numbers splits them level by level, by one bit of the number
at a time, and keeps their order: below any node, which is a range of documents, a list's postings are again a range and again stand by falling impact. So a list can be
walked by document although it's stored by impact, and the first posting of its range bounds what the list can add to any document of the node. A search takes the
nodes with the highest sums of bounds first and goes on to their halves, in which all lists are intersected with the node's documents at once; at a single
document the bound is its score. It ends when no node can reach the k-th best score known. Trees that a task has searched lend their k-th best scores to the next
ones, and their results are merged. Shards are stored small, and a task plants shards that follow each other as one tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rectpart.llm import terms, textops
from rectpart.operators.scan import Scratch, arrow_rows

#: Fixed values of the score: saturation of a term's occurrences, part of it that goes by a document's length (percent), and the whole numbers in which it's reckoned.
SATURATION, BY_LENGTH, UNIT = 12, 25, 1_000_000_000
TOP = 20
#: Bytes of text in a shard (a longer document is one of its own) and in a block of queries, which each task gets whole. The JVM holds a shard as a row, several times over.
SHARD_BYTES, BLOCK_BYTES = 1 << 18, 1 << 20
#: Documents that are read at a time, and so the most of a shard.
ROWS = 256
#: Documents and postings of a tree, but for its last shard.
TREE_SIZE = 1 << 17
#: Nodes that a search takes at a time: few at first, more as it goes on.
FEWEST, MOST = 16, 512
#: Groups in which an item's results are merged before the last merge.
SALTS = 64
SHARDS = "docs array<long>, sizes array<long>, terms binary, ends binary, dfs binary, doc binary, tf binary"
FOUND = "item int, doc_id long, score long"


def build_shards(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A saved table with a row for each shard: ids and numbers of terms of its documents, its distinct terms (their bytes and where each ends), and for each of these its documents (by place) and occurrences there. What has an entry a term or posting is bytes, so that the
    JVM makes no objects of them."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = textops.buffers(batch.column(1))
            for i, j in textops.slices(offsets, SHARD_BYTES):
                words, before = terms.terms_of(batch.column(1).slice(i, j - i))
                known, code = terms.coded(words)
                key, tf = np.unique(code.astype(np.int64) * (j - i) + np.repeat(np.arange(j - i), np.diff(before)), return_counts=True)
                term, doc = np.divmod(key, j - i)
                data, ends = textops.buffers(known)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(pa.int64()))
                packed = [pa.array([x.astype("<u4").tobytes()]) for x in (ends[1:], np.bincount(term, minlength=len(known)), doc, tf)]
                yield pa.RecordBatch.from_arrays(
                    [one(batch.column(0).slice(i, j - i)), one(pa.array(np.diff(before))), pa.array([data.tobytes()], pa.binary()), *packed], names=["docs", "sizes", "terms", "ends", "dfs", "doc", "tf"],
                )

    with arrow_rows(docs.sparkSession, ROWS, read=True):
        return scratch.save(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(shard, SHARDS), "shards", large_rows=True)


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What occurrences in a document of a given number of terms count for, without the term's weight."""
    known, at = np.unique(size, return_inverse=True)
    m = np.array([100 - BY_LENGTH + BY_LENGTH * n * n_docs // n_terms for n in known.tolist()], np.int64)[at]
    return UNIT * tf // (1000 * tf + SATURATION * m)


def weight(df: int, n_docs: int) -> int:
    """What a term counts for that stands in df documents; never negative."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Tree:
    """Postings of some shards as a wavelet tree over document numbers, with impacts at every level. Documents are numbered by id, so that of equal scores the smaller number wins."""

    def __init__(self, ends: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        """ends: where each term's list ends; doc and impact: the postings, list after list in any order."""
        self.sizes = np.diff(ends, prepend=0)
        term = np.repeat(np.arange(len(ends)), self.sizes)
        order = np.lexsort((doc, -impact, term))
        self.ends, self.n_docs = ends, n_docs
        self.levels = max(1, (n_docs - 1).bit_length())
        n = len(doc)
        #: of each level: postings before each place whose bit is 0; impacts; all zeros
        self.zeros = np.zeros((self.levels, n + 1), np.int32)
        self.impact = np.zeros((self.levels + 1, n + 1), np.int32)
        self.total = np.zeros(self.levels, np.int64)
        doc, impact = doc[order], impact[order]
        for level in range(self.levels):
            self.impact[level, :n] = impact
            zero = (doc >> (self.levels - 1 - level)) & 1 == 0
            np.cumsum(zero, out=self.zeros[level, 1:])
            self.total[level] = self.zeros[level, -1]
            split = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
            doc, impact = doc[split], impact[split]
        self.impact[self.levels, :n] = impact
        #: nodes that searches have opened
        self.opened = 0

    def search(self, term: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents by the weighted impacts of some distinct terms, by falling score, then number; none below `least`."""
        lo, hi = np.where(term > 0, self.ends[term - 1], 0)[None, :], self.ends[term][None, :]
        level, node = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = (np.where(lo < hi, self.impact[0, lo], 0) * weights).sum(1)
        doc, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        take = FEWEST
        while True:
            keep = bound >= least
            if not keep.all():
                level, node, bound, lo, hi = level[keep], node[keep], bound[keep], lo[keep], hi[keep]
            if not len(bound):
                return doc, score
            if len(bound) > take:
                first = np.argpartition(bound, -take)[-take:]
                rest = np.ones(len(bound), bool)
                rest[first] = False
            else:
                first, rest = np.arange(len(bound)), np.zeros(len(bound), bool)
            take = min(MOST, 2 * take)
            self.opened += len(first)
            down, a, b = level[first], lo[first], hi[first]
            zero_a, zero_b = self.zeros[down[:, None], a], self.zeros[down[:, None], b]
            ones = self.total[down][:, None]
            a, b = np.concatenate([zero_a, ones + a - zero_a]), np.concatenate([zero_b, ones + b - zero_b])
            down = np.concatenate([down, down]) + 1
            here = np.concatenate([2 * node[first], 2 * node[first] + 1])
            value = (np.where(a < b, self.impact[down[:, None], a], 0) * weights).sum(1)
            leaf = (down == self.levels) & (value >= least)
            if leaf.any():
                doc, score = np.concatenate([doc, here[leaf]]), np.concatenate([score, value[leaf]])
                best = np.lexsort((doc, -score))[:k]
                doc, score = doc[best], score[best]
                least = max(least, int(score[k - 1])) if len(score) == k else least
            go = (down < self.levels) & (value >= least)
            level, node, bound = np.concatenate([level[rest], down[go]]), np.concatenate([node[rest], here[go]]), np.concatenate([bound[rest], value[go]])
            lo, hi = np.concatenate([lo[rest], a[go]]), np.concatenate([hi[rest], b[go]])


def _lists(batches: Iterator[pa.RecordBatch], known: pa.LargeBinaryArray) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Each shard's batch and row, the place of each known term among its terms (-1: none), and the number of documents of each of its terms."""
    for batch in batches:
        for row in range(len(batch)):
            data, ends, dfs = (batch.column(c)[row].as_py() for c in (2, 3, 4))
            here = terms.unpacked(data, ends)
            yield batch, row, pc.fill_null(pc.index_in(known, value_set=here), -1).to_numpy(zero_copy_only=False), np.frombuffer(dfs, "<u4").astype(np.int64)


def plant(batches: Iterator[pa.RecordBatch], known: pa.LargeBinaryArray, asked: np.ndarray, n_docs: int, n_terms: int, most: int) -> Iterator[tuple[Tree, np.ndarray, np.ndarray]]:
    """Trees of the lists of asked terms, numbered as in `known`, over shards that follow each other; for each, ids of its documents by number, and which of them are null. A tree ends
    with the shard with which its documents and postings reach `most`."""
    held: list[tuple] = []
    docs = size = 0

    def tree() -> tuple[Tree, np.ndarray, np.ndarray]:
        ids = pa.concat_arrays([x[0] for x in held])
        term, doc, impact = (np.concatenate([x[c] for x in held]) for c in (1, 2, 3))
        order = pc.array_sort_indices(ids, order="ascending", null_placement="at_end").to_numpy()
        by_term = np.argsort(term, kind="stable")
        ends = np.cumsum(np.bincount(term, minlength=len(known)))
        return Tree(ends, np.argsort(order)[doc[by_term]], impact[by_term], len(ids)), pc.fill_null(ids, 0).to_numpy()[order], ids.is_null().to_numpy(zero_copy_only=False)[order]

    for batch, row, local, dfs in _lists(batches, known):
        use = np.flatnonzero(asked & (local >= 0))
        if not len(use):
            continue
        ids, sizes = (batch.column(c)[row].values for c in (0, 1))
        code = np.full(len(dfs), -1)
        code[local[use]] = use
        term = np.repeat(code, dfs)
        doc, tf = (np.frombuffer(batch.column(c)[row].as_py(), "<u4").astype(np.int64)[term >= 0] for c in (5, 6))
        held.append((ids, term[term >= 0], doc + docs, impacts(tf, sizes.to_numpy()[doc], n_docs, n_terms)))
        docs, size = docs + len(ids), size + len(ids) + len(doc)
        if size >= most:
            yield tree()
            held, docs, size = [], 0, 0
    if held:
        yield tree()


def _document_counts(shards: DataFrame, known: pa.LargeBinaryArray) -> DataFrame:
    """term (place in `known`), df over all shards, for terms that occur. Each task adds its shards up first."""
    sent = shards.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for _, _, local, dfs in _lists(batches, sent.value):
            use = np.flatnonzero(local >= 0)
            total[use] += dfs[local[use]]
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(total[term])], names=["term", "n"])

    return shards.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("df"))


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (int), doc_id, score (long): each item's k highest-scoring documents with a score above 0, equal scores by smaller id.

    Repeated rows of documents count each; of equal scores a null doc_id comes last; null and empty texts have no terms and are no documents of the counts. Rows of items are queries of
    their own, also where they share an id or it's null; items without terms, or without documents that hold one, give no rows, as do empty tables. Other columns aren't read.

    Documents move nowhere; shards are saved once. Queries come to the driver and to all tasks in blocks of BLOCK_BYTES, two jobs over the shards for each; a task gives k rows an item.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    shards = build_shards(docs, scratch, id_col, text_col)
    sizes = shards.select(F.explode("sizes").alias("n")).filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = sizes.docs, sizes.terms or 0
    kind = dict(items.dtypes)[item_col]
    parts = []
    for number, rows in enumerate(terms.blocks(items.select(F.col(item_col).alias("id"), F.col(item_text).alias("text")), "text", BLOCK_BYTES)):
        got = rows.collect()
        words, before = terms.terms_of(pa.array([r.text for r in got], pa.string()))
        known, code = terms.coded(words)
        weights = np.zeros(len(known), np.int64)
        with arrow_rows(spark, 1):
            for r in _document_counts(shards, known).collect():
                weights[r.term] = weight(r.df, n_docs)
        queries = [np.unique(code[a:b], return_counts=True) for a, b in zip(before, before[1:], strict=False)]
        sent = spark.sparkContext.broadcast((known, weights, queries, n_docs, n_terms))

        def search(batches: Iterator[pa.RecordBatch], sent=sent, most=TREE_SIZE) -> Iterator[pa.RecordBatch]:
            known, weights, queries, n_docs, n_terms = sent.value
            best: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(queries)  # ids, whether null, scores
            for tree, ids, lone in plant(batches, known, weights > 0, n_docs, n_terms, most):
                for q, (term, times) in enumerate(queries):
                    use = tree.sizes[term] > 0
                    if use.any():
                        had = best[q]
                        found, score = tree.search(term[use], (weights[term] * times)[use], k, int(had[2][-1]) if len(had[2]) == k else 1)
                        merged = [np.concatenate(x) for x in zip(had, (ids[found], lone[found], score), strict=True)]
                        top = np.lexsort((merged[0], merged[1], -merged[2]))[:k]
                        best[q] = tuple(x[top] for x in merged)
            for q, (ids, lone, score) in enumerate(best):
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, mask=lone), pa.array(score)], names=["item", "doc_id", "score"])

        with arrow_rows(spark, 1):
            names = spark.createDataFrame([(q, r.id) for q, r in enumerate(got)], f"item int, item_id {kind}")
            parts.append(scratch.save(shards.mapInArrow(search, FOUND), f"found_{number}").join(F.broadcast(names), "item").withColumn("block", F.lit(number)))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = F.row_number().over(Window.partitionBy("block", "item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))).orderBy(*order))
    found = found.withColumn("rank", salted).filter(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
