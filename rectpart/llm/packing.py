"""Order-preserving packing of documents into windows by dynamic programming.

The documents' ids form one stream in the order of the rows. A window is cut at a document's end, at
a sentence's end, or, inside a sentence longer than ``step`` ids, at any multiple of ``step``. The cost of a
window is its padding plus the penalty of the cut that ends it; a monotone queue over the last
``width`` ids finds each best predecessor in constant time. The rest at the end of a run of rows, shorter
than a window, is cut into powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rectpart.llm import textops, tokens

#: Paddings that a cut is worth: within a document at a sentence's end, and within a sentence.
SENTENCE_PENALTY, INNER_PENALTY = 2, 5
#: ids that are packed together, and bytes of text that are encoded together.
RUN_IDS, SLICE_BYTES = 1 << 19, 1 << 20

_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def windows(ends: np.ndarray, penalties: np.ndarray, width: int) -> np.ndarray:
    """The cheapest cuts, from 0 to ends[-1]. ends: increasing positions, at most width apart, beginning with 0."""
    position, penalty = ends.tolist(), penalties.tolist()
    n = len(position)
    before, value = [0] * n, [0.0] * n  # value: cost up to a cut, plus its position
    queue, head = [0], 0
    for j in range(1, n):
        p = position[j]
        while position[queue[head]] < p - width:
            head += 1
        best = queue[head]
        before[j] = best
        v = value[best] + width + penalty[j]
        value[j] = v
        while len(queue) > head and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(before[cuts[-1]])
    return ends[cuts[::-1]]


def cut_run(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, width: int, step: int = 16) -> np.ndarray:
    """Window bounds of one run of documents: 0 first, len(ids) last, no window longer than width."""
    total = len(ids)
    if not total:
        return np.zeros(1, np.int64)
    cost = np.full(total + 1, -1.0)
    cost[np.flatnonzero(sentence_ends) + 1] = SENTENCE_PENALTY
    cost[doc_ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    gaps = np.diff(at)
    long = gaps > step
    for a, g in zip(at[:-1][long], gaps[long], strict=True):
        cost[a + step : a + g : step] = INNER_PENALTY
    at = np.flatnonzero(cost >= 0)
    bounds = windows(at, cost[at], width)
    # the last window of the run: powers of two from its start, the largest first
    rest, start = int(bounds[-1] - bounds[-2]), int(bounds[-2])
    tail = np.cumsum([1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1])
    return np.concatenate([bounds[:-1], start + tail])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Pieces of documents placed in windows of at most `width` ids: doc_id, start, length, ids (little-endian
    uint32), doc_tokens, sequence_id, offset.

    Each document is its ids and then end_id; null or empty text is end_id alone. Each id lies in exactly one piece;
    pieces of a window are gapless from offset 0 and keep the rows' order. A window's padding up to `width` isn't
    stored; windows whose length is a power of two need none. Repeated rows are packed as often as they come, also
    with the same id; a null id stays null. An empty table gives no rows. Other columns aren't read. No shuffle: each task packs the rows
    that it scans, in runs of about RUN_IDS ids.
    """
    path = vocabulary or tokens.vocabulary_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base, number = tokens.tokenizer(path), TaskContext.get().partitionId() << 36, 0
        doc_ids, pieces, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            ids, size, doc = np.concatenate(pieces), np.concatenate(sizes), pa.chunked_array(doc_ids, pa.int64())
            ends = np.cumsum(size)
            bounds = cut_run(ids, ends, coder.ends[ids], width)
            cuts = np.union1d(bounds, ends)
            cuts = cuts[cuts > 0]
            start = np.concatenate([[0], cuts[:-1]])
            length = cuts - start
            k = np.searchsorted(ends, start, "right")
            w = np.searchsorted(bounds, start, "right") - 1
            raw = ids.astype("<u4").tobytes()
            out = pa.RecordBatch.from_arrays(
                [doc.take(pa.array(k)).combine_chunks(), pa.array(start - (ends - size)[k]), pa.array(length), pa.array([raw[a:b] for a, b in zip((4 * start).tolist(), (4 * cuts).tolist(), strict=True)], pa.binary()), pa.array(size[k]), pa.array(base + number + w), pa.array(start - bounds[w])],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            number += len(bounds)
            return out

        for batch in batches:
            column, doc = batch.column(1), batch.column(0).cast(pa.int64())
            _, offsets = textops.buffers(column)
            for i, j in textops.slices(offsets, SLICE_BYTES):
                ids, n = coder.encode_many(column.slice(i, j - i).to_pylist())
                full = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                doc_ids.append(doc.slice(i, j - i))
                pieces.append(full)
                sizes.append(n + 1)
                held += len(full)
                if held >= RUN_IDS:
                    yield flush()
                    doc_ids, pieces, sizes, held = [], [], [], 0
        if held:
            yield flush()

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(pack, _SCHEMA)
