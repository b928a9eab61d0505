"""Runs: load, order, sample, partition, evaluate on the whole matrix; and the benchmark loop over many of them."""

from __future__ import annotations

import math
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from rectpart.model import SparseMatrix
from rectpart.operators import loads, reshape, sample
from rectpart.plans import registry
from rectpart.sources import matrices, sinks


@dataclass
class Result:
    matrix: SparseMatrix
    p: list[int]
    q: list[int]
    seconds: dict[str, float] = field(default_factory=dict)

    def report(self) -> str:
        return sinks.report(self.matrix, self.p, self.q, self.seconds)

    def balance(self) -> DataFrame:
        return loads.balance(self.matrix, self.p, self.q)


def ordered(source: str | SparseMatrix, order: str = "nat", triangular: bool = False, use_data: bool = False, spark: SparkSession | None = None, seed: int = 1) -> SparseMatrix:
    a = matrices.load_matrix(spark or SparkSession.active(), source, use_data) if isinstance(source, str) else source.with_data(use_data)
    return reshape.reorder(a, order, triangular, seed=seed)


def sampled(a: SparseMatrix, p: int, q: int, prob: float, seed: int) -> SparseMatrix:
    keep = sample.keep_probability(a.nnz(), p, q or p, prob)
    return a if keep >= 1 else sample.sparsify(a, keep, seed)


def run(source: str | SparseMatrix, alg: str | Callable = "nic", order: str = "nat", p: int = 8, q: int = 0, z: float = 0, prob: float = 1.0, seed: int = 1, triangular: bool = False, use_data: bool = False, spark: SparkSession | None = None) -> Result:
    """Partitions a sample of the ordered matrix; reports and balance are of the whole one."""
    f = registry.get(alg) if isinstance(alg, str) else alg
    seconds, began = {}, time.perf_counter()

    def mark(name: str) -> None:
        nonlocal began
        now = time.perf_counter()
        seconds[name], began = now - began, now

    a = ordered(source, order, triangular, use_data, spark, seed)
    a.df.cache()
    mark("order")
    try:
        part = sampled(a, p, q, prob, seed)
        mark("sample")
        rows, cols = f(part, p, q, z, seed)
        mark("partition")
    finally:
        a.df.unpersist()
    return Result(a, list(rows), list(cols), seconds)


def bench(spark: SparkSession, configs: DataFrame, folder: str) -> DataFrame:
    """Runs each configuration (a small table) and returns it with imbalance, time and both in relation to earlier ones (1 without)."""
    out = []
    for c in configs.orderBy("graph", "ordering", "p", "prob", "seed", "algorithm").collect():
        got = run(f"{folder}/{c.graph}", c.algorithm, c.ordering, c.p, prob=c.prob, seed=c.seed, spark=spark)
        imbalance, t = got.balance().first().imbalance_nnz, got.seconds["sample"] + got.seconds["partition"]
        was = lambda old, new: new / old if old and old > 0 else 1.0
        out.append((c.graph, c.ordering, c.algorithm, c.p, c.prob, c.seed, imbalance, t, was(c.load_imbalance, imbalance), was(c.time, t)))
    return spark.createDataFrame(out, sinks.BENCH_SCHEMA)


def bench_file(spark: SparkSession, configs: str, folder: str, out: str) -> tuple[str, bool]:
    """Runs the configurations of a tab-separated file ("-": standard input), writes the results to a new file in `out`, named by the time; its path, and whether results are worse."""
    if configs == "-":
        fields = [f.split() for f in sinks.BENCH_SCHEMA.split(", ")]
        kinds = {"string": str, "int": int, "double": float}
        rows = [tuple(kinds[k](x) for x, (_, k) in zip(line.rstrip("\n").split("\t"), fields, strict=True)) for line in sys.stdin if line.strip() and not line.startswith("#")]
        config = spark.createDataFrame(rows, sinks.BENCH_SCHEMA)
    else:
        config = sinks.read_bench_config(spark, configs)
    done = bench(spark, config, folder)
    path = f"{out}/bench-{time.strftime('%Y%m%d-%H%M%S')}"
    sinks.write_bench_results(done, path)
    return path, regressed(done)


def regressed(results: DataFrame) -> bool:
    """Whether the geometric mean of imbalances against earlier ones is above 1."""
    mean = loads.geometric_mean(results, "norm_imbalance").first().geomean
    return mean is not None and not math.isclose(mean, 1, rel_tol=1e-7) and mean > 1


def sweep(spark: SparkSession, folder: str, out: str, algorithms: list[str], parts: list[int], probs: list[float], orders: list[str] = ("nat",), seed: int = 1) -> list[str]:
    """A report file for each (order, matrix, algorithm, parts, probability); existing ones are left."""
    written = []
    for order in orders:
        for name in matrices.list_matrices(folder):
            for alg in algorithms:
                for p in parts:
                    for prob in probs:
                        path = Path(out) / order / name / f"{alg}.{p}.{prob:g}.{seed}.out"
                        if not path.exists():
                            path.parent.mkdir(parents=True, exist_ok=True)
                            path.write_text(run(f"{folder}/{name}", alg, order, p, prob=prob, seed=seed, spark=spark).report())
                            written.append(str(path))
    return written
