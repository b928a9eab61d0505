"""Best-fit-decreasing packing into id matrices, with cumulative segment lengths and position resets.

Documents longer than a row are split without loss into full rows and a rest. The pieces of a pool are placed, the longest
first, into the open row with the least room that still holds them; a segment tree over the room left (0..width)
finds that row in log2(width) steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectpart.llm import textops, tokens

#: ids that are packed together (a pool), rows of one matrix, bytes of text that are encoded together.
POOL_IDS, MATRIX_ROWS, SLICE_BYTES = 1 << 20, 64, 1 << 20

_SEGMENT = "struct<row:int,offset:int,doc_id:bigint,start:bigint,length:int,doc_tokens:bigint>"
_SCHEMA = f"matrix_id long, n_rows int, width int, ids binary, positions binary, cu_seqlens array<int>, segments array<{_SEGMENT}>"


class Rooms:
    """A segment tree over the room left, 0..width: at each leaf the open rows with just that room."""

    def __init__(self, width: int):
        self.half = 1 << width.bit_length()
        self.count = [0] * (2 * self.half)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, room: int, n: int) -> None:
        k = room + self.half
        while k:
            self.count[k] += n
            k >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes a row with the least room that is at least `least`; (room, row)."""
        k = least + self.half
        if not self.count[k]:
            while k & 1 or not self.count[k + 1]:  # up, until something stands to the right
                k >>= 1
                if k <= 1:
                    return None
            k += 1
            while k < self.half:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.half
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and offset of each piece (none longer than width, none empty), and the number of rows. Ties keep their order."""
    row, offset, rooms, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), Rooms(width), 0
    sizes = lengths.tolist()
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[k]
        got = rooms.take(size)
        if got is None:
            got, n = (width, n), n + 1
        room, row[k] = got
        offset[k] = width - room
        if room > size:
            rooms.put(room - size, int(row[k]))
    return row, offset, n


def pack_matrices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, end_id: int = 0, pad_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Matrices of at most MATRIX_ROWS packed rows.

    ids and positions are little-endian uint32 matrices of n_rows x width (padding: pad_id, position 0); positions restart
    at 0 with each segment; cu_seqlens are the cumulative segment lengths of the whole matrix, row by row, a row's
    padding being a segment of its own; segments say which part of which document lies where. A document is its ids and then end_id, null or
    empty text end_id alone; every id lies in exactly one segment. Repeated rows are packed as often as they come; a null id stays null. An empty
    table gives no rows; other columns aren't read. No shuffle: each task packs its own rows in pools of about POOL_IDS ids.
    """
    path = vocabulary or tokens.vocabulary_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = tokens.tokenizer(path), TaskContext.get().partitionId() << 36
        doc_ids, held_ids, sizes, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids, size, doc = np.concatenate(held_ids), np.concatenate(sizes), pa.chunked_array(doc_ids, pa.int64()).to_pylist()
            first = np.cumsum(size) - size
            parts = -(-size // width)
            of = np.repeat(np.arange(len(size)), parts)
            start = width * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
            length = np.minimum(width, size[of] - start)
            row, offset, n = best_fit_decreasing(length, width)
            order = np.lexsort((offset, row))
            for at in range(0, n, MATRIX_ROWS):
                a, b = np.searchsorted(row[order], [at, at + MATRIX_ROWS])
                mine, rows = order[a:b], min(MATRIX_ROWS, n - at)
                matrix, places = np.full(rows * width, pad_id, "<u4"), np.zeros(rows * width, "<u4")
                here = (row[mine] - at) * width + offset[mine]
                inner = np.arange(length[mine].sum()) - np.repeat(np.cumsum(length[mine]) - length[mine], length[mine])
                to = np.repeat(here, length[mine]) + inner
                matrix[to], places[to] = ids[np.repeat(first[of[mine]] + start[mine], length[mine]) + inner], inner
                bounds = np.unique(np.concatenate([here, here + length[mine], width * np.arange(rows + 1)]))
                segments = [dict(row=int(row[k] - at), offset=int(offset[k]), doc_id=doc[of[k]], start=int(start[k]), length=int(length[k]), doc_tokens=int(size[of[k]])) for k in mine]
                yield pa.RecordBatch.from_pylist([{"matrix_id": number, "n_rows": rows, "width": width, "ids": matrix.tobytes(), "positions": places.tobytes(), "cu_seqlens": bounds.tolist(), "segments": segments}], schema)
                number += 1

        for batch in batches:
            column, doc = batch.column(1), batch.column(0).cast(pa.int64())
            _, offsets = textops.buffers(column)
            for i, j in textops.slices(offsets, SLICE_BYTES):
                ids, n = coder.encode_many(column.slice(i, j - i).to_pylist())
                full = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                doc_ids.append(doc.slice(i, j - i))
                held_ids.append(full)
                sizes.append(n + 1)
                held += len(full)
                if held >= POOL_IDS:
                    yield from flush()
                    doc_ids, held_ids, sizes, held = [], [], [], 0
        if held:
            yield from flush()

    int32 = pa.int32()
    segment = pa.struct([("row", int32), ("offset", int32), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", int32), ("doc_tokens", pa.int64())])
    schema = pa.schema([("matrix_id", pa.int64()), ("n_rows", int32), ("width", int32), ("ids", pa.binary()), ("positions", pa.binary()), ("cu_seqlens", pa.list_(int32)), ("segments", pa.list_(segment))])
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(pack, _SCHEMA)


def write_matrices(matrices: DataFrame, path: str) -> None:
    """The binary output: matrices as Parquet at a path that driver and executors share."""
    matrices.write.mode("overwrite").parquet(path)


def segments(matrices: DataFrame) -> DataFrame:
    """One row for each segment, with its ids cut out of the matrix."""
    each = matrices.select("matrix_id", "width", "ids", F.explode("segments").alias("s")).select("matrix_id", "width", "ids", "s.*")
    first = F.col("row") * F.col("width") + F.col("offset")
    return each.select(
        "doc_id", "start", F.col("length").cast("long"), F.expr("substring(ids, 4 * (row * width + offset) + 1, 4 * length)").alias("ids"), "doc_tokens",
        (F.col("matrix_id") * MATRIX_ROWS + F.col("row")).alias("sequence_id"), F.col("offset").cast("long"), first.cast("long").alias("matrix_offset"),
    )
