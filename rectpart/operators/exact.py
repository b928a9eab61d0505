"""Optimal cuts of small matrices by branch and bound: rows first, or both dimensions cut by cut from the left. Branches are dealt over the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectpart.model import SparseMatrix
from rectpart.operators import oned
from rectpart.operators.loads import max_load
from rectpart.operators.twod import nic, pal, uniform

#: Rounds of a search, steps of the hash that deals choices to them, and numbers that a task compares at a time.
ROUNDS, STEPS, AT_A_TIME = 3, 1 << 12, 4_000_000

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _extended(choices: DataFrame, name: str, size: int, parts: int) -> DataFrame:
    """Adds every cut vector of a dimension to each choice."""
    choices = choices.withColumn(name, F.array(F.lit(0)))
    for k in range(parts - 1):
        choices = choices.withColumn("_cut", F.explode(F.sequence(F.element_at(name, -1), F.lit(size)))).withColumn(name, F.concat(name, F.array("_cut"))).drop("_cut")
        choices = choices.repartition(name) if k == 0 else choices
    return choices.withColumn(name, F.concat(name, F.array(F.lit(size))))


def columns_under(strips: np.ndarray, bound: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For many choices of row cuts at once: whether at most `parts` column parts keep all tiles to a bound, and the first such column cuts in lexicographic order.

    strips: (choice, strip, column) prefix sums of each strip's columns, with a leading 0; bound: one for each choice. Parts are taken from the right, each as wide as can be, so that
    every cut is as far left as can be.
    """
    at = np.full(len(strips), strips.shape[2] - 1)
    cuts = np.zeros((len(strips), parts + 1), np.int64)
    cuts[:, parts] = at
    for k in range(parts - 1, -1, -1):
        end = np.take_along_axis(strips, at[:, None, None], 2)
        at = np.argmax((end - strips <= bound[:, None, None]).all(1), 1)  # the first column from which on a part is light enough
        cuts[:, k] = at
    return at == 0, cuts


def tiles(table: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The heaviest tile of each pair of cuts."""
    return np.diff(np.diff(table[p[:, :, None], q[:, None, :]], axis=1), axis=2).max((1, 2))


def continued(table: np.ndarray, p: np.ndarray, parts: int, top: float) -> np.ndarray:
    """Beginnings of symmetric cuts, each with every next cut that may still lead to `parts` parts without a tile above `top`; in lexicographic order if they were.

    The next cut isn't beyond where a tile of the new row or column of tiles would be above top, and not before the first position from which on as many greedy parts as are left keep
    the tiles in the strips so far to it. Both only leave out cuts that no solution has.
    """
    k, n = p.shape[1] - 1, len(table) - 1
    last = p[:, -1]
    strips = np.concatenate([np.diff(table[p], axis=1), np.diff(table.T[p], axis=1)], 1)
    upto = lambda at: np.take_along_axis(strips, at[:, None, None], 2)
    square = np.diagonal(table)
    own = square - table[last] - table[:, last].T + square[last][:, None]
    light = (strips - upto(last) <= top).all(1) & ((own <= top) | (np.arange(n + 1) <= last[:, None]))
    high, low = light.sum(1) - 1, np.full(len(p), n)
    for _ in range(parts - k - 1):
        low = np.argmax((upto(low) - strips <= top).all(1), 1)
    low = np.maximum(low, last)
    counts = np.maximum(high - low + 1, 0)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.column_stack([np.repeat(p, counts, 0), np.repeat(low, counts) + offset])


def _batch(p: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p.tolist(), pa.list_(pa.int32()))], names=["p"])


def _blocks(p: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Rows of p in blocks of AT_A_TIME numbers, of which each row needs so many."""
    size = max(1, AT_A_TIME // max(1, cells))
    return (p[k : k + size] for k in range(0, len(p), size))


def _one_more(sent, parts: int, top: float) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column(0).flatten()).reshape(len(batch), -1)
            for block in _blocks(p, 2 * p.shape[1] * len(sent.value)):
                yield _batch(continued(sent.value, block, parts, top))

    return run


def _completed(sent, parts: int, known: float, slack: float, prune: bool) -> Step:
    """Of batches of beginnings, the lightest cuts, depth first; each that is found is the bound of the next ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, top = sent.value, known
        for batch in batches:
            open_, best = [np.asarray(batch.column(0).flatten()).reshape(len(batch), -1)], None
            while open_:
                block, *rest = _blocks(p := open_.pop(), 2 * p.shape[1] * len(table))
                if rest:
                    open_.append(p[len(block) :])
                p = continued(table, block, parts, top + slack)
                if len(p) and p.shape[1] <= parts:
                    open_.append(p)
                elif len(p):
                    load = tiles(table, p, p)
                    first = min((load[i].item(), p[i].tolist()) for i in np.flatnonzero(load == load.min()))
                    best = min(best or first, first)
                    top = min(top, best[0]) if prune else top
            if best:
                cuts = pa.array([best[1]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), cuts, cuts], names=["load", "p", "q"])

    return run


def _in_rounds(choices: DataFrame, step: Callable[[float], Step], known: float, whole: bool, prune: bool = True) -> tuple[list[int], list[int]]:
    """The lightest cuts that a step finds of all choices. The first rounds are small and bring down the bound that they're searched under."""
    found: list[tuple] = []
    share = F.pmod(F.xxhash64("p"), F.lit(STEPS))
    for k in range(ROUNDS):
        low, high = (0 if k == 0 else STEPS >> 3 * (ROUNDS - k)), STEPS >> 3 * (ROUNDS - 1 - k)
        tried = choices.filter((share >= low) & (share < high)).mapInArrow(step(known), f"load {'long' if whole else 'double'}, p array<int>, q array<int>")
        best = tried.agg(F.min(F.struct("load", "p", "q")).alias("best")).first().best
        if best is not None:
            found.append((best.load, list(best.p), list(best.q)))
            known = min(known, best.load) if prune else known
    return min(found)[1:]


def _tried(sent, known: float, whole: bool, q_parts: int) -> Step:
    """Of batches of row cuts, the lightest with its column cuts, if it isn't above what is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = known
        for batch in batches:
            rows = np.asarray(batch.column(0).flatten()).reshape(len(batch), -1)
            for p in _blocks(rows, rows.shape[1] * sent.value.shape[1]):
                strips = np.diff(sent.value[p], axis=1)
                even = strips[:, :, -1].max(1) / q_parts
                p, strips = p[even <= top], strips[even <= top]
                ok, _ = columns_under(strips, np.full(len(p), top), q_parts)
                p, strips = p[ok], strips[ok]
                if not len(p):
                    continue
                low, high = strips[:, :, -1].max(1) / q_parts, np.full(len(p), float(top))
                low = np.ceil(low) if whole else low
                while (low < high).any():
                    mid = np.floor((low + high) / 2) if whole else (low + high) / 2
                    if not whole and ((mid <= low) | (mid >= high)).all():
                        break
                    ok, _ = columns_under(strips, mid, q_parts)
                    low, high = np.where(ok, low, mid + 1 if whole else mid), np.where(ok, mid, high)
                _, q = columns_under(strips, high, q_parts)
                load = np.diff(np.take_along_axis(strips, np.repeat(q[:, None, :], strips.shape[1], 1), 2), axis=2).max((1, 2))
                first = min(np.flatnonzero(load == load.min()).tolist(), key=lambda i: p[i].tolist())
                top = min(top, load[first])
                yield pa.RecordBatch.from_arrays([pa.array(load[[first]]), pa.array([p[first].tolist()], pa.list_(pa.int32())), pa.array([q[first].tolist()], pa.list_(pa.int32()))], names=["load", "p", "q"])

    return run


def exact(a: SparseMatrix, p_parts: int, q_parts: int = 0, symmetric: bool = True) -> tuple[list[int], list[int]]:
    """Cuts with the lightest heaviest tile; the first in lexicographic order among equals.

    Symmetric: cuts grow from the left, each as far as `continued` lets it under the lightest load known. Otherwise only row cuts are tried: their best column cuts are a
    one-dimensional problem (columns_under); they go where even an even share of their heaviest strip is above the load known, or no column cuts keep to it. That load comes from diagonal
    probing or an alternation at first, and from each of ROUNDS rounds on for the next ones. Symmetric cuts of loads below 0, which know no such bounds, are all tried.

    Choices are made and tried on the executors. Each looks up its tiles in the table of two-dimensional prefix sums, which is broadcast: ValueError for
    more than oned.LOCAL_CELLS cells, as of 2800 x 2800, where the choices would be far too many.
    """
    n, m = (a.size, a.size) if symmetric else (a.n_rows, a.n_cols)
    q_parts = p_parts if symmetric else q_parts or p_parts
    if (n + 1) * (m + 1) > oned.LOCAL_CELLS:
        raise ValueError("an exact search is for small matrices; this one's prefix sums are too many to broadcast")
    spark = a.df.sparkSession
    cells = a.loads().groupBy("i", "j").agg(F.sum("w").alias("w")).toPandas()
    whole, prune = cells["w"].dtype.kind in "iu", not (cells["w"] < 0).any()
    table = np.zeros((n + 1, m + 1), np.int64 if whole else np.float64)
    table[cells["i"].to_numpy(np.int64) + 1, cells["j"].to_numpy(np.int64) + 1] = cells["w"].to_numpy(table.dtype)
    table = table.cumsum(0).cumsum(1)
    sent = spark.sparkContext.broadcast(table)
    load = lambda p, q: tiles(table, np.array([p]), np.array([q]))[0].item()
    slack = 0 if whole else 1e-9 * abs(table[-1, -1].item())  # for sums in another order
    if not symmetric:
        choices = _extended(spark.range(1).select(), "p", n, p_parts)
        return _in_rounds(choices, lambda known: _tried(sent, known, whole, q_parts), load(*nic(a, p_parts, q_parts)) + slack, whole)
    known = min(load(p, p) for p in (uniform(n, p_parts), pal(a, p_parts) if n else [0] * (p_parts + 1))) if prune else float("inf")
    choices = spark.range(1).select(F.array(F.lit(0)).alias("p"))
    for _ in range(min(2, p_parts - 1)):  # two cuts are many enough to be dealt
        choices = choices.mapInArrow(_one_more(sent, p_parts, known + slack), "p array<int>").repartition("p")
    return _in_rounds(choices, lambda known: _completed(sent, p_parts, known, slack, prune), known, whole, prune)
