"""Subgradient partitioning of objectives such as "0ij,i=j": cuts in load space move against the excess of their parts.

A term is a matrix number and two letters, one for each axis; terms are added with +, and constraints x=y follow after commas. Letters on one axis of one
matrix, or set equal, share a cut vector. Evaluating an objective is a chain of equi-joins of tile tables on shared letters: a (max, +) product.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Generator
from contextlib import ExitStack
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectpart.model import SparseMatrix
from rectpart.operators import oned
from rectpart.operators.loads import many_tile_loads, running_sum, tile_loads
from rectpart.operators.scan import saved

_TERM = re.compile(r"(\d)([a-z])([a-z])")


@dataclass(frozen=True)
class Objective:
    terms: list[tuple[int, str, str]]
    dims: dict[str, int]  # letter -> number of its cut vector
    axes: list[list[tuple[int, int]]]  # of each cut vector, the (matrix, axis) pairs that it cuts


def parse(text: str) -> Objective:
    """Reads an objective and unifies letters."""
    body, *rules = [x.strip() for x in text.split(",")]
    terms = []
    for part in body.split("+"):
        m = _TERM.fullmatch(part.strip())
        if not m:
            raise ValueError(f"not a term: {part!r}")
        terms.append((int(m[1]), m[2], m[3]))
    letters = sorted({x for _, *two in terms for x in two})
    root = {x: x for x in letters}

    def find(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    def unite(x: str, y: str) -> None:
        x, y = sorted((find(x), find(y)))
        root[y] = x

    first: dict[tuple[int, int], str] = {}
    for m, *two in terms:
        for axis, x in enumerate(two):
            unite(first.setdefault((m, axis), x), x)
    for rule in filter(None, rules):
        sides = [x.strip() for x in rule.split("=")]
        if len(sides) != 2 or any(x not in root for x in sides):
            raise ValueError(f"not a constraint on letters in use: {rule!r}")
        unite(*sides)
    names = sorted({find(x) for x in letters})
    dims = {x: names.index(find(x)) for x in letters}
    axes = [sorted({(m, axis) for m, *two in terms for axis, x in enumerate(two) if dims[x] == d}) for d in range(len(names))]
    return Objective(terms, dims, axes)


def evaluate_many(objective: Objective, matrices: list[SparseMatrix], candidates: list[list[list[int]]]) -> DataFrame:
    """(c, dim, part, cost) for each candidate's cut vectors: of each part, the heaviest task that touches it. One pass over a matrix for each pair of cut vectors that its terms
    name, for all candidates together; tile tables have P x Q rows a candidate, tasks one for each combination of parts."""
    made: dict[tuple[int, int, int], DataFrame] = {}
    spark, tasks = matrices[0].df.sparkSession, None
    every = {d: spark.createDataFrame([(c, u) for c, cuts in enumerate(candidates) for u in range(len(cuts[d]) - 1)], f"c int, p{d} int") for d in range(len(objective.axes))}
    for n, (m, x, y) in enumerate(objective.terms):
        dx, dy = objective.dims[x], objective.dims[y]
        if (m, dx, dy) not in made:
            some = many_tile_loads(matrices[m], [(cuts[dx], cuts[dy]) for cuts in candidates])
            grid = every[dx].withColumnRenamed(f"p{dx}", "u").join(every[dy].withColumnRenamed(f"p{dy}", "v"), "c")
            made[m, dx, dy] = grid.join(some, ["c", "u", "v"], "left").select("c", "u", "v", F.coalesce("load", F.lit(0)).alias("load"))
        table = made[m, dx, dy]
        table = table.filter("u = v").select("c", F.col("u").alias(x), F.col("load").alias(f"l{n}")) if x == y else table.select("c", F.col("u").alias(x), F.col("v").alias(y), F.col("load").alias(f"l{n}"))
        tasks = table if tasks is None else tasks.join(table, ["c", *(z for z in sorted({x, y}) if z in tasks.columns)])
    task = tasks.withColumn("task", reduce(lambda p, q: p + q, (F.col(f"l{n}") for n in range(len(objective.terms)))))
    touched = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(x).alias("part")) for x, d in objective.dims.items())))
    return task.select("c", "task", touched.alias("t")).groupBy("c", "t.dim", "t.part").agg(F.max("task").alias("cost"))


def evaluate(objective: Objective, matrices: list[SparseMatrix], cuts: list[list[int]]) -> DataFrame:
    """(dim, part, cost) of one candidate."""
    return evaluate_many(objective, matrices, [cuts]).drop("c")


def _costs_of_tiles(objective: Objective, matrices: list[SparseMatrix], candidates: list[list[list[int]]]) -> list[list[np.ndarray]]:
    """The costs of evaluate_many by candidate and cut vector, where all tasks fit on the driver: tile loads come there, and tasks are sums of them over a grid of all letters."""
    letters, grids = sorted(objective.dims), {}
    for m, x, y in objective.terms:
        dx, dy = objective.dims[x], objective.dims[y]
        if (m, dx, dy) not in grids:
            grids[m, dx, dy] = [np.zeros((len(cuts[dx]) - 1, len(cuts[dy]) - 1)) for cuts in candidates]
            for r in many_tile_loads(matrices[m], [(cuts[dx], cuts[dy]) for cuts in candidates]).collect():
                grids[m, dx, dy][r.c][r.u, r.v] = r.load
    out = []
    for c, cuts in enumerate(candidates):
        task = np.zeros([len(cuts[objective.dims[x]]) - 1 for x in letters])
        for m, x, y in objective.terms:
            grid = grids[m, objective.dims[x], objective.dims[y]][c]
            if x == y:
                shape = [-1 if z == x else 1 for z in letters]
                task = task + np.diagonal(grid).reshape(shape)
            else:
                grid = grid if letters.index(x) < letters.index(y) else grid.T
                task = task + grid.reshape([len(cuts[objective.dims[z]]) - 1 if z in (x, y) else 1 for z in letters])
        costs = [np.zeros(len(x) - 1) for x in cuts]
        for k, x in enumerate(letters):
            costs[objective.dims[x]] = np.maximum(costs[objective.dims[x]], task.max(tuple(i for i in range(len(letters)) if i != k)))
        out.append(costs)
    return out


class Marginal:
    """Prefix sums (leading 0) of the loads of all axes that one cut vector cuts, plus `each` for every position: an array of up to oned.LOCAL_CELLS numbers, or else a table."""

    def __init__(self, matrices: list[SparseMatrix], axes: list[tuple[int, int]], n: int, each: float = 0.0):
        self.n, parts = n, [matrices[m].loads().select(F.col("ij"[axis]).alias("pos"), F.col("w").cast("double").alias("w")) for m, axis in axes]
        sums = reduce(DataFrame.unionAll, parts).groupBy("pos").agg(F.sum("w").alias("w"))
        self.local = n < oned.LOCAL_CELLS
        if self.local:
            got, total = sums.toPandas(), np.zeros(n + 1)
            total[1:] = each
            np.add.at(total, got["pos"].to_numpy() + 1, got["w"].to_numpy())
            self.prefix = np.cumsum(total)
            self.total = float(self.prefix[-1])
        else:
            every = matrices[axes[0][0]].df.sparkSession.range(n).withColumnRenamed("id", "pos").join(sums, "pos", "left").select("pos", (F.coalesce("w", F.lit(0.0)) + each).alias("w"))
            self.table = saved(running_sum(every, "w", "pos", [], n, "prefix").select("pos", "prefix"))
            self.total = float(self.table.agg(F.max("prefix").alias("t")).first().t or 0)

    def decode(self, places: np.ndarray) -> list[int]:
        """Cuts from places in load space: the first position whose prefix reaches the place."""
        if self.local:
            found = np.searchsorted(self.prefix, places, "left").tolist()
        else:
            first = [F.min(F.when(F.col("prefix") >= float(x), F.col("pos") + 1)).alias(f"p{k}") for k, x in enumerate(places)]
            row = self.table.agg(F.lit(0), *first).first()
            found = [0 if x <= 0 else self.n if row[k + 1] is None else row[k + 1] for k, x in enumerate(places)]
        return [0, *(int(min(self.n, x)) for x in found), self.n]


def descent(places: list[np.ndarray], patience: int = 10, eps: float = 0.001, max_iter: int = 0) -> Generator[list[np.ndarray], list[np.ndarray], tuple[float, list[np.ndarray]]]:
    """Moves cuts against the running sum of their parts' excess, by a step that shrinks with time: yields places, takes the costs of their parts, and returns the best cost and places.

    Stops when parts are level within eps, or when `patience` rounds of (number of cuts) bring less than eps. Fixed values: 100, 0.001 and 10, the step's offset, eps and patience.
    """
    size = sum(len(x) + 2 for x in places)
    best, best_cost, mark, mark_cost, m = places, math.inf, 1, math.inf, 0
    while not max_iter or m < max_iter:
        m += 1
        cost = yield places
        heaviest, lightest = float(cost[0].max()), min(float(c.min()) for c in cost)
        if heaviest < best_cost:
            best, best_cost = [x.copy() for x in places], heaviest
        places = [np.sort(x - np.cumsum(c - c.mean())[: len(x)] / math.sqrt(m // (len(x) + 2) + 100)) for x, c in zip(places, cost, strict=True)]
        if lightest and (heaviest - lightest) / lightest < eps:
            break
        if m - mark > patience * size:
            if best_cost * (1 + eps) >= mark_cost:
                break
            mark, mark_cost = m, best_cost
    return best_cost, best


def descend(starts: list[list[np.ndarray]], prefixes: list[Marginal], costs: Callable[[list[list[list[int]]]], list[list[np.ndarray]]], max_iter: int = 0) -> list[list[int]]:
    """The best cuts of several descents, the first of equals. They go on together: each turn evaluates in one job all cuts that haven't come before, as most near an end have."""
    known: dict[tuple[tuple[int, ...], ...], list[np.ndarray]] = {}
    running = [descent(x, max_iter=max_iter) for x in starts]
    asked: dict[int, list[np.ndarray]] = {t: next(x) for t, x in enumerate(running)}
    ended: dict[int, tuple[float, list[np.ndarray]]] = {}
    while asked:
        keys = {t: tuple(tuple(x.decode(y)) for x, y in zip(prefixes, places, strict=True)) for t, places in asked.items()}
        # a descent goes through all turns whose costs are known before the next job
        fresh = list(dict.fromkeys(k for k in keys.values() if k not in known))
        if fresh and len(fresh) == len(set(keys.values())):
            known.update(zip(fresh, costs([[list(c) for c in k] for k in fresh]), strict=True))
        for t, key in keys.items():
            if key in known:
                try:
                    asked[t] = running[t].send(known[key])
                except StopIteration as end:
                    ended[t] = end.value
                    del asked[t]
    best = min(ended.items(), key=lambda x: (x[1][0], x[0]))[1][1]
    return [x.decode(y) for x, y in zip(prefixes, best, strict=True)]


def sgo(matrices: list[SparseMatrix], objective: str, parts: list[int], seed: int = 1, max_iter: int = 0, init: str = "random", starts: int = 1) -> list[list[int]]:
    """Cut vectors of an objective. parts: of each cut vector, in the order of its first letter. Nonnegative loads only.

    Nonzeros are summed up by coordinate and cached once; each turn with new cuts is a job over them that returns a row for each part. `starts` random beginnings, the first that
    of a single one, share these jobs; the best result counts.
    """
    o = parse(objective)
    for a in matrices:
        a.require_non_negative()
    with ExitStack() as stack:
        held = [stack.enter_context(a.held()) for a in matrices]
        sizes = [max((held[m].n_rows, held[m].n_cols)[axis] for m, axis in axes) for axes in o.axes]
        prefixes = [Marginal(held, axes, n) for axes, n in zip(o.axes, sizes, strict=True)]
        rng = np.random.Generator(np.random.PCG64(seed))
        if init == "random":
            places = [[np.sort(rng.uniform(0, x.total, p - 1)) for x, p in zip(prefixes, parts, strict=True)] for _ in range(starts)]
        else:
            places = [[x.total * np.arange(1, p) / p for x, p in zip(prefixes, parts, strict=True)]]

        def costs(candidates: list[list[list[int]]]) -> list[list[np.ndarray]]:
            if len(candidates) * math.prod(parts[d] for d in o.dims.values()) <= oned.LOCAL_CELLS:
                return _costs_of_tiles(o, held, candidates)
            out = [[np.zeros(p) for p in parts] for _ in candidates]
            for r in evaluate_many(o, held, candidates).collect():
                out[r.c][r.dim][r.part] = r.cost
            return out

        return descend(places, prefixes, costs, max_iter)


def spmv_loads(a: SparseMatrix, cuts: list[int], alpha: float, beta: float) -> DataFrame:
    """(u, v, load): tile loads plus alpha for each row and beta for each column of a tile."""
    width = F.element_at(F.array(*(F.lit(float(b - x)) for x, b in zip(cuts, cuts[1:], strict=False))), F.col("u") + 1)
    height = F.element_at(F.array(*(F.lit(float(b - x)) for x, b in zip(cuts, cuts[1:], strict=False))), F.col("v") + 1)
    return tile_loads(a, cuts, cuts).select("u", "v", (F.col("load") + alpha * width + beta * height).alias("load"))


def sgo_spmv(a: SparseMatrix, parts: int, alpha: float, beta: float, seed: int = 1, max_iter: int = 0, starts: int = 1) -> list[int]:
    """Symmetric cuts for a matrix-vector product: tiles also cost their rows and columns. Several starts share their jobs, as in sgo."""
    a.require_square()
    with a.held() as held:
        prefix = Marginal([held], [(0, 0), (0, 1)], a.size, alpha + beta)
        rng = np.random.Generator(np.random.PCG64(seed))
        places = [[np.sort(rng.uniform(0, prefix.total, parts - 1))] for _ in range(starts)]

        def costs(candidates: list[list[list[int]]]) -> list[list[np.ndarray]]:
            out = []
            for (cuts,) in candidates:  # empty tiles cost their rows and columns, too
                wide = np.diff(cuts).astype(float)
                out.append(alpha * wide[:, None] + beta * wide[None, :])
            for r in many_tile_loads(held, [(cuts, cuts) for (cuts,) in candidates]).collect():
                out[r.c][r.u, r.v] += r.load
            return [[np.maximum(x.max(1), x.max(0))] for x in out]

        return descend(places, [prefix], costs, max_iter)[0]
