"""Command line: python -m rectpart.plans.cli --graph file.mtx --alg pal --p 4"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from rectpart.plans import engine, registry
from rectpart.sources import matrices, sinks


def parser() -> argparse.ArgumentParser:
    x = argparse.ArgumentParser(prog="rectpart", description="Rectilinear partitioning of sparse matrices on Spark.")
    x.add_argument("--graph", help="matrix file (.mtx, .bin or .parquet), or - for Matrix Market text from standard input")
    x.add_argument("--bench", help="file of benchmark configurations, or - for standard input: runs them on matrices in --dir; exit code 1 if results are worse than those in the file")
    x.add_argument("--bench-out", default=".", help="folder for benchmark results")
    x.add_argument("--dir", default=".", help="folder that --list shows")
    x.add_argument("--alg", default="nic", help=", ".join(registry.ALGORITHMS))
    x.add_argument("--order", default="nat", choices=registry.ORDERS)
    x.add_argument("-p", "--p", type=int, default=8, help="row parts")
    x.add_argument("-q", "--q", type=int, default=0, help="column parts, by default as many")
    x.add_argument("-z", "--z", type=float, default=0, help="largest load: then as few parts as possible")
    x.add_argument("--sparsify", type=float, default=1.0, help="share of nonzeros to partition by, or above 1 an error factor")
    x.add_argument("--seed", type=int, default=1)
    x.add_argument("--res-file", help="file for the cuts")
    x.add_argument("--serialize", help="folder for the tiles, as Parquet")
    x.add_argument("--use-upper", action="store_true", help="only nonzeros above the diagonal")
    x.add_argument("--use-data", action="store_true", help="loads are weights")
    x.add_argument("--list", action="store_true", help="list matrix files")
    return x


def main(args: list[str] | None = None) -> int:
    o = parser().parse_args(args)
    if o.list:
        print("\n".join(matrices.list_matrices(o.dir)))
        return 0
    if not o.graph and not o.bench:
        parser().error("--graph is needed")
    spark = SparkSession.builder.appName("rectpart").getOrCreate()
    if o.bench:
        path, worse = engine.bench_file(spark, o.bench, o.dir, o.bench_out)
        print(path)
        return int(worse)
    got = engine.run(o.graph, o.alg, o.order, o.p, o.q, o.z, o.sparsify, o.seed, o.use_upper, o.use_data, spark)
    print(got.report(), end="")
    if o.res_file:
        sinks.write_cuts(o.res_file, got.p, got.q)
    if o.serialize:
        sinks.write_tiles(got.matrix, got.p, got.q, o.serialize)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
