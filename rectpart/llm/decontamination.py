"""Exact and near matches of test texts in documents by a distributed positional inverted index.

The index is a table with a row for each segment, some whole documents: their ids and lengths, the distinct terms, and for each term its posting list, the
rising positions at which it stands. Positions run through the segment with one left out between documents, so that no match crosses them. Segments are made
where documents are read and nothing is shuffled. A search sends the test texts to all segments, a bounded block at a time; a task joins the lists of segments that follow each other. For a phrase, each term's list is moved by the term's
offset in the phrase, and the lists are intersected from the segment's rarest term on; phrases with a term that the segment lacks fall out before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rectpart.llm import terms, textops
from rectpart.operators.scan import Scratch, arrow_rows

WINDOW = 10
#: Bytes of text in a segment (a longer document is one of its own) and in a block of test texts, which each task gets whole. The JVM holds a segment as a row, several times over.
SEGMENT_BYTES, BLOCK_BYTES = 1 << 18, 1 << 20
#: Documents that are read at a time, and so the most of a segment.
ROWS = 256
#: Documents and positions of asked terms that are searched at a time, but for the last segment of them.
JOINED = 1 << 19
INDEX = "segment long, docs array<long>, sizes array<long>, terms binary, ends binary, counts binary, positions binary"
MATCHES = "segment long, doc int, doc_id long, item_id string, first long, last long"


def build_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", name: str = "index") -> DataFrame:
    """The index of whole texts, a saved table: every term of every row. Null text has no terms; null ids stay null; rows that repeat are documents of their own."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = textops.buffers(batch.column(1))
            for i, j in textops.slices(offsets, SEGMENT_BYTES):
                words, before = terms.terms_of(batch.column(1).slice(i, j - i))
                known, code = terms.coded(words)
                place = np.arange(len(words)) + np.repeat(np.arange(j - i), np.diff(before))
                data, ends = textops.buffers(known)
                # what has an entry a term or position is bytes, so that the JVM makes no objects of them
                packed = [pa.array([x.astype("<u4").tobytes()]) for x in (ends[1:], np.bincount(code, minlength=len(known)), place[np.argsort(code, kind="stable")])]
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), one(batch.column(0).slice(i, j - i)), one(pa.array(np.diff(before))), pa.array([data.tobytes()], pa.binary()), *packed],
                    names=["segment", "docs", "sizes", "terms", "ends", "counts", "positions"],
                )
                number += 1

    with arrow_rows(docs.sparkSession, ROWS, read=True):
        return scratch.save(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(index, INDEX), name, large_rows=True)


class Segment:
    """The posting lists of a segment, or of several as one. Lists stand one after another by term, so that (term, position) rises through all of them and one search finds any posting."""

    def __init__(self, known: pa.Array, counts: np.ndarray, positions: np.ndarray, sizes: np.ndarray):
        self.terms, self.counts = known, counts.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.positions = positions.astype(np.int64)
        #: first position of each document, and one past the last one's end
        self.docs = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.width = int(self.docs[-1]) + 1
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.width + self.positions

    def codes(self, some: pa.Array) -> np.ndarray:
        """The numbers of terms here; -1 for those that don't occur."""
        return pc.fill_null(pc.index_in(some, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of some terms one after another, and for each posting which of the terms it's from."""
        n = self.counts[term]
        owner = np.repeat(np.arange(len(term)), n)
        return self.positions[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[term], n)], owner

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether a term's list has a position, for pairs of both."""
        key = term * self.width + position
        at = np.searchsorted(self.keys, key)
        return (self.keys[np.minimum(at, len(self.keys) - 1)] == key) & (position >= 0) & (position < self.width)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the windows (a row of term numbers each) starts at which position: all occurrences."""
        here = np.flatnonzero((windows >= 0).all(1)) if len(self.keys) else np.zeros(0, np.int64)
        size = self.counts[windows[here]]
        order = np.argsort(size, 1, kind="stable")  # offsets, rarest term first
        at = lambda step: windows[here, order[:, step]]
        position, owner = self.postings(at(0))
        start = position - order[owner, 0]
        for step in range(1, windows.shape[1]):
            stay = self.has(at(step)[owner], start + order[owner, step])
            start, owner = start[stay], owner[stay]
        inside = start >= 0
        return here[owner[inside]], start[inside]

    def near(self, window: np.ndarray, span: int) -> list[tuple[int, int]]:
        """The shortest stretches [first, last) of at most `span` words of one document that hold all terms of a window, in any order: for each posting of its rarest term the leftmost
        of the shortest around it. Terms that repeat count once."""
        window = np.unique(window)
        if not len(window) or window[0] < 0 or not len(self.keys):
            return []
        window = window[np.argsort(self.counts[window], kind="stable")]
        anchor = self.positions[self.starts[window[0]] : self.starts[window[0] + 1]]
        doc = np.searchsorted(self.docs, anchor, "right") - 1
        low, high = np.maximum(anchor - span + 1, self.docs[doc]), np.minimum(anchor + span, self.docs[doc + 1] - 1)
        for term in window[1:]:
            first = np.searchsorted(self.keys, term * self.width + low)
            stay = first < np.searchsorted(self.keys, term * self.width + high)
            anchor, low, high = anchor[stay], low[stay], high[stay]
        found = set()
        for a, lo, hi in zip(anchor.tolist(), low.tolist(), high.tolist(), strict=True):
            spots = sorted((p, t) for t in window[1:].tolist() for p in self.positions[slice(*np.searchsorted(self.keys, [t * self.width + lo, t * self.width + hi]))].tolist())
            best: tuple[int, int, int] | None = None
            # a shortest stretch begins at the anchor or at a posting before it
            for first in [*(p for p, _ in spots if p < a), a]:
                last, left = a, len(window) - 1
                seen: set[int] = set()
                for p, t in spots:
                    if p >= first and t not in seen:
                        seen.add(t)
                        last, left = max(last, p), left - 1
                if not left and last - first < span and (best is None or last - first < best[0]):
                    best = (last - first, first, last + 1)
            if best:
                found.add(best[1:])
        return sorted(found)


def joined(batches: Iterator[pa.RecordBatch], asked: pa.LargeBinaryArray, most: int) -> Iterator[tuple[Segment, pa.Array, np.ndarray, np.ndarray]]:
    """Segments that follow each other as one, with the lists of asked terms only; and of each of its documents the id, the segment's number and the place there. A join ends with the
    segment with which its documents and positions reach `most`."""
    held: list[tuple] = []
    width = size = 0

    def one() -> tuple[Segment, pa.Array, np.ndarray, np.ndarray]:
        ids = pa.concat_arrays([x[0] for x in held])
        number, place, sizes, term, position = (np.concatenate([x[c] for x in held]) for c in range(1, 6))
        counts = np.bincount(term, minlength=len(asked))
        return Segment(asked.filter(pa.array(counts > 0)), counts[counts > 0], position[np.argsort(term, kind="stable")], sizes), ids, number, place

    for batch in batches:
        for k in range(len(batch)):
            number, docs, sizes, data, ends, counts, positions = (batch.column(c)[k] for c in range(7))
            local = pc.fill_null(pc.index_in(asked, value_set=terms.unpacked(data.as_py(), ends.as_py())), -1).to_numpy(zero_copy_only=False)
            use = np.flatnonzero(local >= 0)
            if not len(use):
                continue
            counts = np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
            code = np.full(len(counts), -1)
            code[local[use]] = use
            term = np.repeat(code, counts)
            sizes, position = sizes.values.to_numpy(), np.frombuffer(positions.as_py(), "<u4").astype(np.int64)[term >= 0]
            held.append((docs.values, np.full(len(sizes), number.as_py()), np.arange(len(sizes)), sizes, term[term >= 0], position + width))
            width, size = width + int((sizes + 1).sum()), size + len(sizes) + len(position)
            if size >= most:
                yield one()
                held, width, size = [], 0, 0
    if held:
        yield one()


class Block:
    """A bounded block of test texts: the windows of `window` words of each item, or one window of a shorter item's words, equal windows once."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        words, before = terms.terms_of(pa.array(texts, pa.string()))
        self.ids = ids
        self.terms, code = terms.coded(words)
        self.groups = []
        sizes = np.diff(before)
        length = np.minimum(sizes, window)
        for n in np.unique(length[length > 0]).tolist():
            item = np.flatnonzero(length == n)
            many = sizes[item] - n + 1
            owner = np.repeat(item, many)
            first = before[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            distinct, which = np.unique(code[first[:, None] + np.arange(n)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), owner], 1), axis=0)
            self.groups.append((distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))

    def exact(self, segment: Segment) -> Iterator[tuple[int, int, int]]:
        """(item, first, last) of all maximal stretches that an item's windows cover."""
        code = segment.codes(self.terms)
        for windows, begin, owners in self.groups:
            which, start = segment.phrases(code[windows])
            many = begin[which + 1] - begin[which]
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[which], many)
            item, start = owners[place], np.repeat(start, many)
            order = np.lexsort((start, item))
            item, start = item[order], start[order]
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (start[1:] > start[:-1] + windows.shape[1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(item))[: len(head)] - 1
            yield from zip(item[head].tolist(), start[head].tolist(), (start[tail] + windows.shape[1]).tolist(), strict=True)

    def near(self, segment: Segment, span: int) -> Iterator[tuple[int, int, int]]:
        """(item, first, last) of stretches of at most `span` words with all terms of one of an item's windows."""
        code = segment.codes(self.terms)
        found = set()
        for windows, begin, owners in self.groups:
            for k in np.flatnonzero((code[windows] >= 0).all(1)).tolist():
                for first, last in segment.near(code[windows[k]], span):
                    found.update((item, first, last) for item in owners[begin[k] : begin[k + 1]].tolist())
        yield from sorted(found)


def find(index: DataFrame, items: DataFrame, scratch: Scratch, window: int = WINDOW, span: int | None = None, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """segment, doc (its place there), doc_id, item_id (string), first, last: word ranges [first, last) of documents in which test windows stand, a saved table.

    Without `span`, phrases: all exact occurrences of windows, those of one item that touch joined. With it, proximity: stretches of at most `span` words that hold all terms of a
    window in any order. Items without words have no windows; rows with one item_id are one item; a null item_id stays null. Test texts come to the driver and to all tasks in
    blocks of BLOCK_BYTES, a job over the index for each.
    """
    spark = index.sparkSession
    parts = []
    for k, rows in enumerate(terms.blocks(items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), "text", BLOCK_BYTES)):
        got = rows.collect()
        sent = spark.sparkContext.broadcast(Block([r.id for r in got], [r.text for r in got], window))

        def search(batches: Iterator[pa.RecordBatch], sent=sent, most=JOINED) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for one, docs, number, place in joined(batches, block.terms, most):
                hits = np.array(list(block.exact(one) if span is None else block.near(one, span)), np.int64).reshape(-1, 3)
                doc = np.searchsorted(one.docs, hits[:, 1], "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[doc]), pa.array(place[doc].astype(np.int32)), docs.take(pa.array(doc)), pa.array([block.ids[i] for i in hits[:, 0].tolist()], pa.string()),
                     pa.array(hits[:, 1] - one.docs[doc]), pa.array(hits[:, 2] - one.docs[doc])], names=["segment", "doc", "doc_id", "item_id", "first", "last"],
                )

        with arrow_rows(spark, 1):
            parts.append(scratch.save(index.mapInArrow(search, MATCHES), f"matches{'' if span is None else span}_{k}"))
    found = spark.createDataFrame([], MATCHES)
    for part in parts:
        found = found.unionAll(part)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (array of string, sorted): for every row, its words and those that lie in an occurrence of an item's window, and the items found.

    Null and empty texts have no words; repeated rows count each; null ids stay null; items with a null id count as one, whose name is the empty string. No rows or no items give
    no hits. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession)
    index = build_index(docs, scratch, id_col, text_col)
    found = find(index, items, scratch, window, id_col=item_col)
    before = Window.partitionBy("segment", "doc").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.coalesce(F.max("last").over(before), F.lit(0))))
    hit = found.withColumn("fresh", fresh).groupBy("segment", "doc").agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set(F.coalesce("item_id", F.lit("")))).alias("items"))
    every = index.select("segment", F.posexplode(F.arrays_zip("docs", "sizes")).alias("doc", "d"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return every.join(hit, ["segment", "doc"], "left").select(
        F.col("d.docs").alias("doc_id"), F.col("d.sizes").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(names).cast("long").alias("n_items"), names.alias("item_ids"),
    )
