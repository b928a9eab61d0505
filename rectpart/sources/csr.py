"""The binary CSR layout by byte ranges: a Spark data source that reads a file in many tasks, and writers whose tasks put their values at their places in one file.

The layout: a header with the widths of ids and of weights in bytes, then rows, columns, indptr (rows + 1), indices, and weights or none, all unsigned and little-endian.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rectpart.model import SparseMatrix
from rectpart.operators.loads import marginal_prefix, running_sum
from rectpart.operators.scan import global_rank

#: The headers that there are, by widths of ids and weights.
HEADERS = {b"4 4\n": (4, 4), b"8 4\n": (8, 4), b"8 8\n": (8, 8), b"4 8\n": (4, 8)}
#: Bytes of indices that a task reads, and values that are in its memory at a time.
PARTITION_BYTES, CHUNK = 64 << 20, 1 << 20


@dataclass(frozen=True)
class Layout:
    """Where everything stands in a file."""

    path: str
    n: int
    m: int
    nnz: int
    id_bytes: int
    weight_bytes: int
    weighted: bool

    @property
    def indptr_at(self) -> int:
        return 4 + 2 * self.id_bytes

    @property
    def indices_at(self) -> int:
        return self.indptr_at + (self.n + 1) * self.id_bytes

    @property
    def weights_at(self) -> int:
        return self.indices_at + self.nnz * self.id_bytes

    @property
    def size(self) -> int:
        return self.weights_at + self.nnz * self.weight_bytes * self.weighted


def _opened(path: str) -> pa.NativeFile:
    """A local path, or the address of a store that pyarrow can open."""
    system, inner = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    return system.open_input_file(inner)


def _numbers(f: pa.NativeFile, at: int, count: int, width: int) -> np.ndarray:
    raw = f.read_at(count * width, at)
    if len(raw) < count * width:
        raise ValueError("the file ends too early")
    return np.frombuffer(raw, f"<u{width}").astype(np.int64)


def layout_of(path: str) -> Layout:
    """Reads a file's header, sizes and last indptr. ValueError if its length doesn't fit them."""
    with _opened(path) as f:
        size = f.size()
        widths = HEADERS.get(f.read_at(min(4, size), 0))
        if not widths:
            raise ValueError("the header isn't that of 4- or 8-byte ids and weights")
        ids, weights = widths
        n, m = _numbers(f, 4, 2, ids).tolist()
        if n < 0 or size < 4 + (n + 3) * ids:
            raise ValueError("the file ends within its sizes")
        nnz = int(_numbers(f, 4 + (n + 2) * ids, 1, ids)[0])
        for weighted in (False, True):
            found = Layout(path, n, m, nnz, ids, weights, weighted and nnz > 0)
            if nnz >= 0 and found.size == size:
                return found
    raise ValueError("the file's length doesn't fit its sizes")


@dataclass
class Slice(InputPartition):
    """Nonzeros [begin, end), and rows [low, high) whose indptr the task also checks."""

    begin: int
    end: int
    low: int
    high: int


class CsrReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.layout, self.bytes = layout_of(path), partition_bytes

    def partitions(self) -> list[Slice]:
        x = self.layout
        count = max(1, -(-max(x.nnz, x.n) * x.id_bytes // self.bytes))
        return [Slice(x.nnz * k // count, x.nnz * (k + 1) // count, x.n * k // count, x.n * (k + 1) // count) for k in range(count)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        x = self.layout
        with _opened(x.path) as f:
            indptr = lambda a, b: _numbers(f, x.indptr_at + a * x.id_bytes, b - a, x.id_bytes)
            if partition.low == 0 and indptr(0, 1)[0]:
                raise ValueError("indptr doesn't begin with 0")
            for a in range(partition.low, partition.high, CHUNK):
                if (np.diff(indptr(a, min(partition.high, a + CHUNK) + 1)) < 0).any():
                    raise ValueError("indptr falls")
            row = self._row_of(indptr, partition.begin) if partition.begin < partition.end else 0
            at = partition.begin
            while at < partition.end:
                ends = indptr(row + 1, min(x.n, row + CHUNK) + 1)
                if not len(ends):
                    raise ValueError("indptr falls")
                stop = min(partition.end, at + CHUNK, int(ends[-1]))
                if stop > at:
                    i = row + np.searchsorted(ends, np.arange(at, stop), "right")
                    j = _numbers(f, x.indices_at + at * x.id_bytes, stop - at, x.id_bytes)
                    if j.max() >= x.m or j.min() < 0:
                        raise ValueError("a column id is outside the matrix")
                    v = _numbers(f, x.weights_at + at * x.weight_bytes, stop - at, x.weight_bytes) if x.weighted else np.ones(stop - at, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], names=["i", "j", "v"])
                    row, at = int(i[-1]), stop
                else:
                    row += len(ends)

    def _row_of(self, indptr, position: int) -> int:
        """The row of a nonzero, by bisection over the file."""
        low, high = 0, self.layout.n
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if indptr(mid, mid + 1)[0] <= position else (low, mid - 1)
        return low


class CsrSource(DataSource):
    """spark.read.format("csr").load(path), after spark.dataSource.register(CsrSource); option partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "i long, j long, v long"

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options["path"], int(self.options.get("partitionbytes", PARTITION_BYTES)))


def read_csr(spark: SparkSession, path: str, weighted: bool = False, partition_bytes: int = PARTITION_BYTES) -> SparseMatrix:
    """A binary file in as many tasks as its size asks; the driver reads its sizes alone. A broken file is a ValueError at once or, where only a task can see it, when it's read."""
    found = layout_of(path)
    spark.dataSource.register(CsrSource)
    df = spark.read.format("csr").option("partitionBytes", partition_bytes).load(path)
    return SparseMatrix(df, found.n, found.m, weighted and found.weighted)


def is_valid(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> bool:
    """Whether a file keeps to the layout: its length, indptr from 0 and never falling, every column id inside; checked by tasks over parts of the file."""
    try:
        read_csr(spark, path, partition_bytes=partition_bytes).df.count()
    except ValueError:
        return False
    except Exception as error:
        if "ValueError" not in str(error):
            raise
        return False
    return True


# --- writing ----------------------------------------------------------------------------------------------------------


class Placed:
    """One file that many tasks write: each opens it and puts bytes where they belong, which may happen twice without harm. It gets its name when all is there; until then it has another.

    The file has to stand in a folder that the driver and all executors share as files.
    """

    def __init__(self, path: str, size: int):
        self.path, self.temporary = path, f"{path}.writing"
        with open(self.temporary, "wb") as f:
            f.truncate(size)

    def __enter__(self) -> Placed:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            os.replace(self.temporary, self.path)
        else:
            os.remove(self.temporary)

    def head(self, raw: bytes, at: int = 0) -> None:
        with open(self.temporary, "r+b") as f:
            f.seek(at)
            f.write(raw)

    def numbers(self, values: DataFrame, place: str, value: str, at: int, width: int) -> None:
        """Unsigned numbers by their places (0, 1, ...), from a byte on."""
        path = self.temporary

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with open(path, "r+b") as f:
                for batch in batches:
                    where, what = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    heads = np.flatnonzero(np.append(True, np.diff(where) != 1)) if len(where) else []
                    for a, b in zip(heads, [*heads[1:], len(where)], strict=True):
                        f.seek(at + int(where[a]) * width)
                        f.write(what[a:b].astype(f"<u{width}").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([len(where)])], names=["n"])

        values.select(F.col(place).cast("long"), F.col(value).cast("long")).mapInArrow(put, "n long").agg(F.sum("n")).collect()

    def texts(self, pieces: DataFrame, offset: str, text: str, at: int = 0) -> None:
        """Pieces of ASCII text by their offsets, from a byte on."""
        path = self.temporary

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with open(path, "r+b") as f:
                for batch in batches:
                    where, what = batch.column(0).to_numpy(), [x.encode() for x in batch.column(1).to_pylist()]
                    ends = where + np.array([len(x) for x in what], np.int64)
                    heads = np.flatnonzero(np.append(True, where[1:] != ends[:-1])) if len(where) else []
                    for a, b in zip(heads, [*heads[1:], len(where)], strict=True):
                        f.seek(at + int(where[a]))
                        f.write(b"".join(what[a:b]))
                    yield pa.RecordBatch.from_arrays([pa.array([len(where)])], names=["n"])

        pieces.select(F.col(offset).cast("long"), F.col(text)).mapInArrow(put, "n long").agg(F.sum("n")).collect()


def _ordered(a: SparseMatrix) -> DataFrame:
    """i, j, v and rank, the place of a nonzero by row, column and weight."""
    return global_rank(a.df.select("i", "j", "v"), [F.asc("i"), F.asc("j"), F.asc("v")])


def _checked(a: SparseMatrix, weight_bytes: int) -> int:
    """The number of nonzeros. ValueError for ids outside the matrix, and weights that aren't whole or don't fit their width."""
    v = F.col("v")
    inside = F.col("i").between(0, a.n_rows - 1) & F.col("j").between(0, a.n_cols - 1)
    fits = (v >= 0) & (v < F.lit(float(2 ** (8 * weight_bytes)) if weight_bytes < 8 else float(2**63))) & (v == F.floor(v)) if a.weighted else F.lit(True)
    row = a.df.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.coalesce(inside, F.lit(False))), F.lit(True)).alias("inside"), F.coalesce(F.bool_and(F.coalesce(fits, F.lit(False))), F.lit(True)).alias("fits")).first()
    if not row.inside:
        raise ValueError("a row or column id is outside the matrix")
    if not row.fits:
        raise ValueError(f"weights have to be whole numbers of {weight_bytes} bytes without a sign")
    return row.n


def write_csr(a: SparseMatrix, path: str, weight_bytes: int = 4) -> None:
    """The binary layout, nonzeros by row, column and weight. Ids have 8 bytes where 4 don't do. Ranks and prefix sums give each value its byte; no task or driver holds the file.

    ValueError, and no file, for weights that aren't whole, are negative or don't fit weight_bytes, and for ids outside the matrix.
    """
    nnz = _checked(a, weight_bytes)
    ids = 4 if max(a.n_rows, a.n_cols, nnz) < 2**32 else 8
    x = Layout(path, a.n_rows, a.n_cols, nnz, ids, weight_bytes, a.weighted and nnz > 0)
    with Placed(path, x.size) as out:
        out.head(f"{ids} {weight_bytes}\n".encode() + np.array([a.n_rows, a.n_cols]).astype(f"<u{ids}").tobytes())
        out.numbers(marginal_prefix(a).select((F.col("id") + 1).alias("id"), "prefix"), "id", "prefix", x.indptr_at, ids)
        ordered = _ordered(a)
        out.numbers(ordered, "rank", "j", x.indices_at, ids)
        if x.weighted:
            out.numbers(ordered, "rank", "v", x.weights_at, weight_bytes)


def _line(values: DataFrame, place: str, text: Column, n: int) -> tuple[DataFrame, int]:
    """A line of n values by their places with spaces between: (offset, piece), and its length."""
    piece = F.concat(text, F.when(F.col(place) == n - 1, F.lit("\n")).otherwise(F.lit(" ")))
    pieces = values.select(F.col(place).alias("_at"), piece.alias("piece")).withColumn("_len", F.length("piece").cast("long"))
    placed = running_sum(pieces, "_len", "_at", [], max(1, n), "_end")
    return placed.select((F.col("_end") - F.col("_len")).alias("offset"), "piece"), pieces.agg(F.sum("_len").alias("n")).first().n or 0


def write_csr_text(a: SparseMatrix, path: str) -> None:
    """Rows, nonzeros, indptr, indices and weights in decimal, a line each; running sums of the pieces' lengths give each its byte."""
    nnz = a.df.count()
    ordered, head = _ordered(a), f"{a.n_rows}\n{nnz}\n".encode()
    zero = a.df.sparkSession.range(1).select(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("prefix"))
    indptr = zero.unionAll(marginal_prefix(a).select((F.col("id") + 1).alias("at"), "prefix"))
    lines = [_line(indptr, "at", F.col("prefix").cast("string"), a.n_rows + 1), *(_line(ordered, "rank", F.col(c).cast("string"), nnz) for c in ("j", "v"))]
    sizes = [max(1, size) for _, size in lines]
    with Placed(path, len(head) + sum(sizes)) as out:
        out.head(head)
        at = len(head)
        for (pieces, size), held in zip(lines, sizes, strict=True):
            out.texts(pieces, "offset", "piece", at)
            if not size:
                out.head(b"\n", at)
            at += held


def write_dense_text(a: SparseMatrix, path: str) -> None:
    """The sizes and then a 0 or 1 for each cell, one a line, row by row: rows of zeros are written by ranges, and a 1 where a nonzero stands."""
    head, m = f"{a.n_rows} {a.n_cols}\n".encode(), a.n_cols
    with Placed(path, len(head) + 2 * a.n_rows * m) as out:
        out.head(head)
        path, start = out.temporary, len(head)

        def zeros(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with open(path, "r+b") as f:
                for batch in batches:
                    for i in batch.column(0).to_pylist():
                        f.seek(start + 2 * i * m)
                        for j in range(0, m, CHUNK):
                            f.write(b"0\n" * min(CHUNK, m - j))
                    yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

        a.df.sparkSession.range(a.n_rows).mapInArrow(zeros, "n long").agg(F.sum("n")).collect()
        ones = a.df.filter("v is null or v != 0").select((2 * (F.col("i") * m + F.col("j"))).alias("offset"), F.lit("1").alias("piece"))
        out.texts(ones, "offset", "piece", start)
