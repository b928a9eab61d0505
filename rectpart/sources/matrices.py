"""Matrix sources: Matrix Market text, binary CSR, points, CSR arrays, dense rows and tables."""

from __future__ import annotations

import io
import os
import sys
import uuid
from collections.abc import Sequence
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectpart.model import SparseMatrix, from_coordinates
from rectpart.operators.scan import shared_folder
from rectpart.sources import csr


def load_matrix(spark: SparkSession, path: str, weighted: bool = False) -> SparseMatrix:
    """By the path's ending: .mtx, .bin or .parquet; "-" is a binary or Matrix Market file from standard input. ValueError for anything else, FileNotFoundError where nothing is there."""
    if path == "-":  # one stream, which only the driver has
        return _standard_input(spark, weighted)
    if path.endswith(".mtx"):
        return read_matrix_market(spark, path, weighted)
    if path.endswith(".bin"):
        return read_binary_csr(spark, path, weighted)
    if path.endswith(".parquet"):
        return from_coordinates(spark.read.parquet(path), "i", "j", "v", weighted=weighted)
    raise ValueError(f"unknown kind of matrix file: {path}")


def _exists(spark: SparkSession, path: str) -> None:
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)


def read_matrix_market(spark: SparkSession, path: str, weighted: bool = False) -> SparseMatrix:
    """Coordinate files, real, integer or pattern; symmetric ones aren't expanded. Ids become 0-based; sizes are the declared ones.

    Only the banner and the size line come to the driver; coordinates are split and cast on the executors.
    """
    _exists(spark, path)
    return parse_matrix_market(spark.read.text(path), path, weighted)


def parse_matrix_market(lines: DataFrame, path: str, weighted: bool = False) -> SparseMatrix:
    """The same of lines (value) in their order."""
    banner = lines.filter(F.col("value").startswith("%%")).first()
    words = (banner.value if banner else "").lower().split()
    if len(words) < 5 or words[0] != "%%matrixmarket" or words[1] != "matrix":
        raise ValueError(f"no Matrix Market matrix: {path}")
    if words[2] != "coordinate" or words[3] not in ("real", "integer", "pattern", "double"):
        raise ValueError(f"only real, integer or pattern coordinate matrices can be read, not {' '.join(words[2:4])}")
    body = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    n_rows, n_cols, nnz = (int(x) for x in body.first().value.split()[:3])
    parts = F.split(F.trim("value"), "\\s+")
    pattern = words[3] == "pattern"
    numbered = body.withColumn("n", F.monotonically_increasing_id())
    first = numbered.agg(F.min("n").alias("n")).first().n
    coo = numbered.filter(F.col("n") != first).select((parts[0].cast("long") - 1).alias("i"), (parts[1].cast("long") - 1).alias("j"), (F.lit(1.0) if pattern else parts[2].cast("double")).alias("v"))
    if words[3] == "integer" or pattern:
        coo = coo.withColumn("v", F.col("v").cast("long"))
    if coo.count() != nnz:
        raise ValueError(f"{path} declares {nnz} nonzeros")
    return SparseMatrix(coo, n_rows, n_cols, weighted and not pattern)


def read_binary_csr(spark: SparkSession, path: str, weighted: bool = False) -> SparseMatrix:
    """Header, rows, columns, indptr, indices and optional weights, ids and weights of 4 or 8 bytes; read by byte ranges in many tasks."""
    _exists(spark, path)
    return csr.read_csr(spark, path, weighted)


def _binary_input(spark: SparkSession, stream: BinaryIO, first: bytes) -> str:
    """Copies standard input, chunk by chunk, to a file in the folder that the cluster shares, and returns its path."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.bin"
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(context._jsc.hadoopConfiguration())
    out = system.create(where)
    system.deleteOnExit(where)
    while first:
        out.write(bytearray(first))
        first = stream.read(1 << 20)
    out.close()
    return path


def _standard_input(spark: SparkSession, weighted: bool) -> SparseMatrix:
    stream = getattr(sys.stdin, "buffer", None)
    if stream is None:  # text only
        return parse_matrix_market(spark.createDataFrame([(x.rstrip("\n"),) for x in sys.stdin], "value string"), "standard input", weighted)
    first = stream.read(1 << 20)
    if first[:4] in csr.HEADERS:
        return csr.read_csr(spark, _binary_input(spark, stream, first), weighted)
    lines = io.TextIOWrapper(io.BytesIO(first + stream.read()), "utf-8")
    return parse_matrix_market(spark.createDataFrame([(x.rstrip("\n"),) for x in lines], "value string"), "standard input", weighted)


def validate_csr(path: str, spark: SparkSession | None = None) -> bool:
    """Whether a binary file keeps to the layout; parts of it are checked by tasks."""
    return csr.is_valid(spark or SparkSession.builder.getOrCreate(), path)


def from_points(spark: SparkSession, points: Sequence[tuple[int, int]], data: Sequence[float] | None = None, weighted: bool = False) -> SparseMatrix:
    """Pairs and optional weights; duplicates stay; sizes are the largest ids + 1, 0 without points."""
    values = data if data is not None else [1] * len(points)
    kind = "double" if any(isinstance(x, float) for x in values) else "long"
    df = spark.createDataFrame([(int(i), int(j), v) for (i, j), v in zip(points, values, strict=True)], f"i long, j long, v {kind}")
    return from_coordinates(df, "i", "j", "v", weighted=weighted)


def from_csr(spark: SparkSession, indptr: Sequence[int], indices: Sequence[int], data: Sequence[float] | None = None, n_cols: int | None = None, weighted: bool = False) -> SparseMatrix:
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    a = from_points(spark, list(zip(rows.tolist(), map(int, indices), strict=True)), data, weighted)
    return SparseMatrix(a.df, len(indptr) - 1, a.n_cols if n_cols is None else n_cols, weighted)


def from_dense(spark: SparkSession, rows: Sequence[Sequence[float]], weighted: bool = False) -> SparseMatrix:
    """Cells other than 0 of a dense array; its true numbers of rows and columns."""
    cells = [(i, j, v) for i, row in enumerate(rows) for j, v in enumerate(row) if v]
    a = from_points(spark, [(i, j) for i, j, _ in cells], [v for *_, v in cells], weighted)
    return SparseMatrix(a.df, len(rows), max(map(len, rows), default=0), weighted)


def from_dense_table(df: DataFrame, i: str, cells: str) -> SparseMatrix:
    """A table with a row id and an array of cells."""
    coo = df.select(F.col(i).alias("i"), F.posexplode(cells).alias("j", "v")).filter("v <> 0")
    sizes = df.agg(F.max(i).alias("n"), F.max(F.size(cells)).alias("m")).first()
    return from_coordinates(coo, "i", "j", "v", (sizes.n if sizes.n is not None else -1) + 1, sizes.m or 0)


def list_matrices(folder: str, spark: SparkSession | None = None) -> list[str]:
    """Names of matrix files, sorted; of a folder in a store, by the cluster's own file systems."""
    if "://" not in folder:
        names = os.listdir(folder)
    else:
        context = (spark or SparkSession.builder.getOrCreate()).sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(folder)
        names = [x.getPath().getName() for x in where.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(where)]
    return sorted(x for x in names if x.endswith((".mtx", ".bin")))
