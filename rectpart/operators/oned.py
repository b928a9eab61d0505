"""One-dimensional partitioning: cut positions so that the heaviest part, over one or several load arrays, is as light as possible.

Prefixes of up to LOCAL_CELLS cells are searched in numpy on the driver; longer ones stay in a table, of which the driver has the sums at some positions (TablePrefixes). The result is the greedy, left-most maximal cuts at the least feasible bound, padded with the end.

A load is a difference of two prefix sums, and keeps to a bound if that difference does. Real loads are compared as such, too: a prefix sum plus a bound is rounded, and may lie before the very position that the bound is the load of.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectpart.functions.parts import part_of
from rectpart.operators.scan import Scratch

#: Cells (stripes x positions) that may come to the driver; 8 bytes each.
LOCAL_CELLS = 8_000_000
#: Marks that a round of TablePrefixes sets in a range at least; otherwise as many as make up an eighth of LOCAL_CELLS.
MARKS = 256
#: Ranges of a round at most, and cuts that a probe without a number of parts looks for at a time.
MOST_RANGES, PROBED = 256, 64
#: Cells above which whole loads are searched in rows that aren't summed up by position first, and the new marks of all arrays together that a round of this sets.
ROW_CELLS, ROW_MARKS = 262_144, 32_768
#: Bounds that such a round tells apart where their cuts are far from each other, and old marks between two cuts that are.
BOUNDS, WIDE = 8, 64


class Prefixes(Protocol):
    n: int
    integral: bool

    def totals(self) -> tuple[float, float]:
        """The largest total of an array and the largest single element."""

    def probe(self, bound: float, parts: int | None) -> list[int]:
        """Greedy cuts under a bound; see the function of that name."""

    def bottleneck(self, parts: int) -> tuple[float, list[int]]:
        """The least feasible bound, and its cuts."""

    def close(self) -> None:
        """Frees what is stored."""


def _least(low: float, high: float, ok: Callable[[float], bool], integral: bool) -> float:
    """The least bound from low to high that is ok, down to the last digit of a real one; high if none below is."""
    while low < high:
        mid = (low + high) // 2 if integral else low + (high - low) / 2
        if not integral and not low < mid < high:
            return low if ok(low) else high
        low, high = (low, mid) if ok(mid) else (mid + 1 if integral else mid, high)
    return high


def _last(row: np.ndarray, start: int, bound: float, integral: bool) -> int:
    """The last position of a row of prefix sums whose load from start on is within the bound."""
    base = row[start]
    top = base + bound
    if not integral and math.isfinite(top):  # the largest number whose distance from base, as rounded, is within the bound
        while top - base > bound:
            top = math.nextafter(top, -math.inf)
        while (above := math.nextafter(top, math.inf)) - base <= bound:
            top = above
    return int(np.searchsorted(row, top, "right")) - 1


class LocalPrefixes:
    """Q arrays of prefix sums, each with a leading 0."""

    def __init__(self, prefixes: np.ndarray):
        self.a = np.atleast_2d(np.asarray(prefixes))
        self.n = self.a.shape[1] - 1
        self.integral = np.issubdtype(self.a.dtype, np.integer)

    def totals(self) -> tuple[float, float]:
        return self.a[:, -1].max(), np.diff(self.a, axis=1).max() if self.n else 0

    def reach(self, start: int, bound: float) -> int:
        return min(_last(row, start, bound, self.integral) for row in self.a)

    def load(self, start: int, end: int) -> float:
        return (self.a[:, end] - self.a[:, start]).max()

    def close(self) -> None:
        pass

    def probe(self, bound: float, parts: int | None) -> list[int]:
        cuts = [0]
        while cuts[-1] < self.n and (parts is None or len(cuts) <= parts):
            end = max(cuts[-1], self.reach(cuts[-1], bound))
            cuts.append(end)
            if end == cuts[-2] and parts is None:
                break
        if parts is not None:
            cuts += [cuts[-1]] * (parts + 1 - len(cuts))
        return cuts

    def bottleneck(self, parts: int) -> tuple[float, list[int]]:
        """Whole loads are bisected by value, real ones by realised loads: the range goes down to the heaviest part of feasible cuts, or up to the least load that would lengthen a part of others.

        Both are loads that occur, so that the bound is one, too. A round at least halves a range that begins at the heaviest element: 54 + log2(n) rounds at most.
        """
        total, largest = self.totals()
        if self.integral:
            low = _least(max(-(-int(total) // parts), int(largest)), int(total), lambda x: self.probe(x, parts)[-1] >= self.n, True)
            return low, self.probe(low, parts)
        low, high = float(largest), float(total)
        while low < high:
            mid = low + (high - low) / 2
            mid = mid if mid < high else low
            cuts = self.probe(mid, parts)
            pairs = list(zip(cuts, cuts[1:], strict=False))
            if cuts[-1] >= self.n:
                high = float(max(self.load(a, b) for a, b in pairs))
            else:
                low = float(min(self.load(a, b + 1) for a, b in pairs))
        return high, self.probe(high, parts)


class TablePrefixes:
    """The same over a DataFrame (q, pos, load) with positions 0..n-1 and loads that aren't negative: a two-level index of prefix sums.

    The lower level is the table, dealt by ranges of positions and sorted, so that a range is read from the files that hold it. The upper level is on the driver: the exact prefix
    sums of every array at some positions, the marks. Between two neighbouring marks they tell where a part ends; going on from the nearer and from the farther of them gives
    cuts that lie not after and not before the true ones. So every bound is probed without a job: the least that the farther marks allow and the least that the nearer ones allow
    enclose the optimum, and their cuts enclose its cuts. One job then sets marks within all of these ranges at once, until both come to the same cuts. A
    round divides the gaps in a range by MARKS or, where ranges meet, by 4 at least, whatever the number of bounds, so that jobs grow with the logarithm of n. On the driver are
    at most LOCAL_CELLS numbers, or some 4 x arrays x parts^2 where that is more.
    """

    def __init__(self, sums: DataFrame, n: int, stripes: int, integral: bool = True):
        self.n, self.stripes, self.integral, self.scratch = n, stripes, integral, Scratch(sums.sparkSession)
        kind = "long" if integral else "double"
        sums = sums.select(F.col("q").cast("int").alias("q"), F.col("pos").cast("long").alias("pos"), F.col("load").cast(kind).alias("load"))
        self.sums = self.scratch.save(sums.repartitionByRange("pos").sortWithinPartitions("pos"), "sums")
        self.largest = self.sums.agg(F.max("load").alias("m")).first().m or 0
        self.marks = self._marked(np.array([0, n]), np.zeros((stripes, 2), np.int64 if integral else np.float64), [(0, 1)] if n else [], [])

    def close(self) -> None:
        """Deletes the table."""
        self.scratch.close()

    def totals(self) -> tuple[float, float]:
        return self.marks[1][:, -1].max(), self.largest

    def _cells(self) -> int:
        return LOCAL_CELLS // 8

    def _marked(self, at: np.ndarray, prefix: np.ndarray, ranges: list[tuple[int, int]], kept: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Marks, with new ones at even distances in each range (a pair of old marks), by one job; old ones stay at the ends, and from the first of a kept pair to the one behind the second."""
        if not ranges:
            return at, prefix
        room = max(MARKS, self._cells() // max(1, self.stripes) // len(ranges))
        spans = [(int(at[a]), int(at[b])) for a, b in ranges]
        # where ranges meet and don't shrink yet, at least their widest gaps do
        widths = [-(-min((b - a) / room, np.diff(at[i : j + 1]).max() / 4) // 1) for (a, b), (i, j) in zip(spans, ranges, strict=True)]
        widths = [max(1, int(w)) for w in widths]
        counts = [-(-(b - a) // w) for (a, b), w in zip(spans, widths, strict=True)]
        first = np.concatenate([[0], np.cumsum(counts)])
        edges = [x for span in spans for x in span]  # parts 1, 3, ... of these cuts are the ranges
        of = lambda values: F.get(F.array(*(F.lit(int(v)) for v in values)), F.floor(F.col("_part") / 2).cast("int"))
        inside = self.sums.filter(F.col("pos").between(edges[0], edges[-1] - 1)).withColumn("_part", part_of("pos", [0, *edges, self.n])).filter("_part % 2 = 1")
        block = F.floor((F.col("pos") - of(a for a, _ in spans)) / of(widths)) + of(first[:-1])
        got = inside.groupBy("q", block.cast("int").alias("block")).agg(F.sum("load").alias("load")).toArrow()
        loads = np.zeros((self.stripes, int(first[-1])), prefix.dtype)
        loads[got["q"].to_numpy(), got["block"].to_numpy()] = got["load"].to_numpy().astype(prefix.dtype)
        stay = np.zeros(len(at), bool)
        stay[[0, -1]] = True
        for a, b in kept:
            stay[a : b + 2] = True
        places, sums = [at[stay]], [prefix[:, stay]]
        for k, (a, b) in enumerate(spans):
            places.append(np.minimum(a + np.arange(1, counts[k] + 1) * widths[k], b))
            sums.append(prefix[:, [ranges[k][0]]] + np.cumsum(loads[:, first[k] : first[k + 1]], 1))
        if len(at) == 2:  # the first marks: the end's sum isn't known before
            places, sums = [at[:1], *places[1:]], [prefix[:, :1], *sums[1:]]
        at, which = np.unique(np.concatenate(places), return_index=True)
        return at, np.maximum.accumulate(np.concatenate(sums, 1)[:, which], 1)  # sums of doubles may differ in their last digits

    def _walk(self, at: np.ndarray, prefix: np.ndarray, bound: float, parts: int, far: bool) -> list[int]:
        """Numbers of the marks at which greedy parts under a bound end, going on from the mark not after (far: not before) a part's end."""
        here, out = 0, [0]
        for _ in range(parts):
            here = max(here, min(_last(row, here, bound, self.integral) for row in prefix))
            if far and here + 1 < len(at) and at[here + 1] - at[here] > 1:
                here += 1
            out.append(here)
        return out

    def _unclear(self, at: np.ndarray, prefix: np.ndarray, parts: int, low: float, high: float, near: list[int], far: list[int]) -> list[tuple[int, int]]:
        """Pairs of marks, rising, between which the next round sets more."""
        return list(zip(near, far, strict=True))

    def search(self, parts: int, low: float, high: float, begin: tuple[int, np.ndarray] | None = None) -> tuple[float, list[int], np.ndarray]:
        """The least feasible bound from low to high, its cuts and the prefix sums at them; if none below is, high and its cuts. begin: a position to start at and its prefix sums."""
        at, prefix = self.marks
        if begin:
            after = at > begin[0]
            at, prefix = np.append(begin[0], at[after]), np.concatenate([begin[1][:, None], prefix[:, after]], 1)
        while True:
            last = len(at) - 1
            low = _least(low, high, lambda x: self._walk(at, prefix, x, parts, True)[-1] == last, self.integral)
            high = _least(low, high, lambda x: self._walk(at, prefix, x, parts, False)[-1] == last, self.integral)
            near, far = self._walk(at, prefix, low, parts, False), self._walk(at, prefix, high, parts, True)
            if near == far:
                return high, at[near].tolist(), prefix[:, near]
            ranges: list[tuple[int, int]] = []
            for a, b in self._unclear(at, prefix, parts, low, high, near, far):
                if a < b and (np.diff(at[a : b + 1]) > 1).any():
                    if ranges and a <= ranges[-1][1]:
                        ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
                    else:
                        ranges.append((a, b))
            at, prefix = self._marked(at, prefix, ranges[:MOST_RANGES], list(zip(near, far, strict=True)))

    def bottleneck(self, parts: int) -> tuple[float, list[int]]:
        total = self.totals()[0]
        if self.integral:
            return self.search(parts, max(-(-int(total) // parts), int(self.largest)), int(total))[:2]
        _, cuts, sums = self.search(parts, 0.0, float(total))
        return float(np.diff(sums, axis=1).max()), cuts

    def probe(self, bound: float, parts: int | None) -> list[int]:
        if parts is not None:
            return self.search(parts, bound, bound)[1]
        cuts, begin = [0], None
        while cuts[-1] < self.n:
            _, found, sums = self.search(PROBED, bound, bound, begin)
            for x in found[1:]:
                cuts.append(x)
                if x in (self.n, cuts[-2]):  # at the end, or stuck
                    return cuts
            begin = found[-1], sums[:, -1]
        return cuts


class RowPrefixes(TablePrefixes):
    """The same over rows (q, pos, load) of whole loads of which many may share a position, such as the nonzeros of a held matrix, read again in every round.

    Marks only need sums between them, so that a round moves as many sums as it sets marks, and never a sum for each position. The largest element isn't known before;
    marks at its both sides tell that no smaller bound is feasible. ROW_MARKS keeps a task's sums few beside its rows; rounds after the first only take rows between some marks.
    """

    def __init__(self, rows: DataFrame, n: int, stripes: int):
        self.n, self.stripes, self.integral, self.sums = n, stripes, True, rows
        self.marks = self._marked(np.array([0, n]), np.zeros((stripes, 2), np.int64), [(0, 1)] if n else [], [])

    def close(self) -> None:
        pass

    def _cells(self) -> int:
        return min(ROW_MARKS, super()._cells())

    def _unclear(self, at: np.ndarray, prefix: np.ndarray, parts: int, low: float, high: float, near: list[int], far: list[int]) -> list[tuple[int, int]]:
        """Where the cuts of all bounds leave wide ranges, those that single bounds leave: marks there tell which of these bounds are feasible."""
        pairs = super()._unclear(at, prefix, parts, low, high, near, far)
        if 4 * self.stripes * sum(b - a for a, b in pairs) <= self._cells():
            return pairs
        bounds = sorted({low + (high - low) * k // (BOUNDS - 1) for k in range(BOUNDS)})
        out = set()
        for x in bounds:  # up to a wide range, which narrower ones before it may resolve
            own = [pair for pair in zip(self._walk(at, prefix, x, parts, False), self._walk(at, prefix, x, parts, True), strict=True) if pair[0] < pair[1]]
            out.update(own[: max(1, next((k for k, (a, b) in enumerate(own) if b - a > WIDE), len(own)))])
        return sorted(out)

    def totals(self) -> tuple[float, float]:
        largest = self.sums.groupBy("q", "pos").agg(F.sum("load").alias("load")).agg(F.max("load").alias("m")).first().m
        return self.marks[1][:, -1].max(), largest or 0

    def bottleneck(self, parts: int) -> tuple[float, list[int]]:
        total = int(self.marks[1][:, -1].max())
        return self.search(parts, -(-total // parts), total)[:2]


def prefixes_of(sums: DataFrame, n: int, stripes: int, integral: bool = True) -> Prefixes:
    """Sums (q, pos, load) as prefixes, on the driver if they fit."""
    if stripes * (n + 1) > LOCAL_CELLS:
        return TablePrefixes(sums, n, stripes, integral)
    got = sums.select(F.col("q").cast("long"), F.col("pos").cast("long"), F.col("load").cast("long" if integral else "double")).toArrow()
    a = np.zeros((stripes, n + 1), np.int64 if integral else np.float64)
    np.add.at(a, (got["q"].to_numpy(), got["pos"].to_numpy() + 1), got["load"].to_numpy())
    return LocalPrefixes(np.cumsum(a, 1))


def as_prefixes(values: Sequence | np.ndarray) -> LocalPrefixes:
    """Plain prefix arrays: one, or several of one length."""
    return LocalPrefixes(np.asarray(values))


def probe(x: Prefixes, bound: float, parts: int | None = None) -> list[int]:
    """Greedy cuts under a bound: with `parts`, just parts + 1 cuts, padded with where it got stuck or the end; without, as many as it takes."""
    return x.probe(bound, parts)


def feasible(x: Prefixes, parts: int, bound: float) -> bool:
    return probe(x, bound, parts)[-1] >= x.n


def _checked(x: Prefixes, by_value: bool) -> Prefixes:
    if by_value and not x.integral:
        raise TypeError("bisection by value is for whole loads")
    return x


def bottleneck(x: Prefixes, parts: int, by_value: bool = False) -> float:
    """The least feasible bound."""
    return _checked(x, by_value).bottleneck(parts)[0]


def partition(x: Prefixes, parts: int, by_value: bool = False) -> list[int]:
    """parts + 1 optimal cuts."""
    return _checked(x, by_value).bottleneck(parts)[1]


def partition_sums(sums: DataFrame, n: int, stripes: int, parts: int, integral: bool = True, by_value: bool = False) -> list[int]:
    """parts + 1 optimal cuts of sums (q, pos, load); what is stored for them is deleted."""
    x = prefixes_of(sums, n, stripes, integral)
    try:
        return partition(x, parts, by_value)
    finally:
        x.close()


def partition_rows(rows: DataFrame, n: int, stripes: int, parts: int, integral: bool = True, by_value: bool = False) -> list[int]:
    """partition_sums of rows (q, pos, load) that may share a position. Above ROW_CELLS cells, whole loads aren't summed up by position."""
    if stripes * (n + 1) > min(ROW_CELLS, LOCAL_CELLS) and dict(rows.dtypes)["load"] in ("tinyint", "smallint", "int", "bigint"):
        return partition(RowPrefixes(rows, n, stripes), parts, by_value)
    return partition_sums(rows.groupBy("q", "pos").agg(F.sum("load").alias("load")), n, stripes, parts, integral, by_value)


def partition_values(values: Sequence, parts: int) -> list[int]:
    """Optimal cuts of one array of loads."""
    values = np.asarray(values)
    return partition(LocalPrefixes(np.concatenate([[values.dtype.type(0)], np.cumsum(values)])), parts)
