"""Sinks and text forms: cuts, tiles, binary CSR, dense dumps, reports and benchmark tables."""

from __future__ import annotations

from itertools import product
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectpart.model import Cuts, SparseMatrix
from rectpart.operators import loads as L
from rectpart.sources import csr

BENCH_SCHEMA = "graph string, ordering string, algorithm string, p int, prob double, seed int, load_imbalance double, time double, norm_imbalance double, norm_time double"


def cuts_text(p: Cuts, q: Cuts) -> str:
    """Part count and cuts; a second pair of lines if columns have other cuts."""
    pairs = [p] if list(p) == list(q) else [p, q]
    return "".join(f"{len(c) - 1}\n{' '.join(map(str, c))}\n" for c in pairs)


def write_cuts(path: str, p: Cuts, q: Cuts) -> None:
    Path(path).write_text(cuts_text(p, q))


def write_tiles(a: SparseMatrix, p: Cuts, q: Cuts, path: str) -> None:
    """Each tile's nonzeros with local ids, in a folder for each (u, v): readers of one tile read only its files."""
    L.block_coordinates(a, p, q).write.partitionBy("u", "v").mode("overwrite").parquet(path)


def write_coordinates(a: SparseMatrix, path: str) -> None:
    a.df.write.mode("overwrite").parquet(path)


def write_binary_csr(a: SparseMatrix, path: str, weight_bytes: int = 4) -> None:
    csr.write_csr(a, path, weight_bytes)


def write_csr_text(a: SparseMatrix, path: str) -> None:
    csr.write_csr_text(a, path)


def write_dense_text(a: SparseMatrix, path: str) -> None:
    csr.write_dense_text(a, path)


def dense_rows(a: SparseMatrix) -> DataFrame:
    """(i, cells): a 0/1 for each column, row by row."""
    cols = a.df.filter("v is null or v != 0").groupBy("i").agg(F.collect_set("j").alias("js"))
    every = a.df.sparkSession.range(a.n_rows).withColumnRenamed("id", "i")
    cells = F.transform(F.sequence(F.lit(0), F.lit(max(0, a.n_cols - 1))), lambda c: F.array_contains(F.coalesce("js", F.array().cast("array<bigint>")), c.cast("long")).cast("int"))
    return every.join(cols, "i", "left").select("i", cells.alias("cells"))


def report(a: SparseMatrix, p: Cuts, q: Cuts, seconds: dict[str, float] | None = None) -> str:
    """Cuts, tile loads, largest loads, imbalances and times of a result."""
    tiles = L.tile_loads(a, p, q).cache()
    try:
        grid = np.zeros((len(p) - 1, len(q) - 1))
        for r in tiles.collect():
            grid[r.u, r.v] = r.load
        tri = L.max_tri_load(tiles).first().max_tri_load
    finally:
        tiles.unpersist()
    b = L.balance(a, p, q).first()
    show = lambda x: f"{x:g}"
    lines = ["Row cuts", " ".join(map(str, p)), "Column cuts", " ".join(map(str, q)), "Tile loads", *(" ".join(map(show, row)) for row in grid)]
    lines += [f"Max load: {show(grid.max(initial=0))}", f"Max tri load: {show(tri or 0)}", f"Load imbalance: {b.imbalance_nnz or 0:.5f}", f"Weighted imbalance: {b.imbalance or 0:.5f}"]
    if list(p) == list(q):
        lines += ["Row and column max loads", " ".join(map(show, np.maximum(grid.max(1), grid.max(0))))]
    else:
        lines += ["Row max loads", " ".join(map(show, grid.max(1))), "Column max loads", " ".join(map(show, grid.max(0)))]
    lines += [f"{name} time: {s:.6f} s" for name, s in (seconds or {}).items()]
    return "\n".join(lines) + "\n"


def read_bench_config(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated benchmark rows; # begins a comment."""
    return spark.read.csv(path, sep="\t", comment="#", schema=BENCH_SCHEMA)


def write_bench_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t")


def bench_configs(spark: SparkSession, graphs: list[str], orders: list[str], algorithms: list[str], parts: list[int], probs: list[float], seeds: list[int]) -> DataFrame:
    """All combinations, with -1 for results that don't exist yet. The lists are small, so rows are made on the driver."""
    rows = [(*x, -1.0, -1.0, -1.0, -1.0) for x in product(graphs, orders, algorithms, parts, probs, seeds)]
    return spark.createDataFrame(rows, BENCH_SCHEMA)
