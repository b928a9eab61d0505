"""Two-dimensional partitioners: uniform, alternating optimal, refined symmetric and diagonal probing.

Every step over the nonzeros is a Spark job that returns sums by position and stripe; the searches over these are in ``oned``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectpart.functions.parts import part_of
from rectpart.model import Cuts, SparseMatrix
from rectpart.operators import loads as L
from rectpart.operators import oned
from rectpart.operators.scan import Scratch

#: Nonzeros, compacted, up to which diagonal probing runs on the driver.
LOCAL_NONZEROS = 2_000_000
#: Rounds in which a search for the fewest parts ends.
ROUNDS = 3
#: Blocks of positions whose loads the driver has of a larger form, and sums by strip and block that one of its windows brings there at most (or two blocks a strip).
BLOCKS, STRIP_CELLS = 65_536, 1_000_000
#: Marks of a grid search at even distances, and those that a round adds.
EVEN_MARKS, NEW_MARKS = 128, 384


def uniform(n: int, parts: int) -> list[int]:
    return [k * n // parts for k in range(parts + 1)]


def _is_integral(a: SparseMatrix) -> bool:
    return not a.weighted or dict(a.df.dtypes)["v"] in ("tinyint", "smallint", "int", "bigint") or dict(a.df.dtypes)["v"].startswith("decimal")


def _fewest(low: int, high: int, ok: Callable[[list[int]], list[bool]]) -> int:
    """The fewest parts from low to high that are ok, in ROUNDS rounds at most: each tries several numbers at even distances at once. As in a bisection, more parts count as no worse."""
    step = max(1, math.ceil((high - low + 1) ** (1 / ROUNDS)))
    while low < high:
        tried = sorted({low + (high - low) * k // (step + 1) for k in range(1, step + 1)} | {low}) if high - low > step else list(range(low, high))
        good = dict(zip(tried, ok(tried), strict=True))
        first = next((k for k in tried if good[k]), high)
        low, high = max((k + 1 for k in tried if k < first), default=low), first
    return high


def uniform_under(a: SparseMatrix, z: float) -> tuple[list[int], bool]:
    """Uniform symmetric cuts with the fewest parts whose heaviest tile is at most z, and whether they keep to z. Nonzeros are summed up by coordinate once; a round tries many numbers."""
    with a.held() as held:
        return _uniform_under(held, z)


def _uniform_under(a: SparseMatrix, z: float) -> tuple[list[int], bool]:
    n = a.size
    load = lambda ks: L.max_loads(a, [(uniform(n, k), uniform(n, k)) for k in ks])
    top = max(1, n)
    most = min(top, int(n / math.sqrt(z)) + 1)  # enough if every cell counts at most 1
    if most < top and load([most])[0] > z:
        most = top
    parts = _fewest(1, most, lambda ks: [x <= z for x in load(ks)])
    return uniform(n, parts), load([parts])[0] <= z


def nic(a: SparseMatrix, p_parts: int, q_parts: int = 0, max_iter: int = 0, by_value: bool = False, start: Cuts | None = None) -> tuple[list[int], list[int]]:
    """Alternates optimal column cuts for given row cuts and the reverse, until one comes out as it was.

    Rows start with the optimal cuts of their nonzero counts (or `start`); columns count as equal to them before the first step. The source is read once: equal coordinates are
    summed up and cached for the steps.
    """
    q_parts, integral = q_parts or p_parts, _is_integral(a)
    limit = max_iter or max(10, p_parts + q_parts)
    held = SparseMatrix(a.loads().groupBy("i", "j").agg(F.sum("w").alias("v"), F.count("*").alias("n")).cache(), a.n_rows, a.n_cols, True)
    try:
        if start is None:
            counts = held.df.select(F.lit(0).alias("q"), F.col("i").alias("pos"), F.col("n").alias("load"))
            start = oned.partition_rows(counts, a.n_rows, 1, p_parts, by_value=by_value)
        cuts = {"i": list(start), "j": list(start)}
        sizes, parts = {"i": a.n_rows, "j": a.n_cols}, {"i": p_parts, "j": q_parts}
        for step in range(1, limit + 1):
            axis, other = ("j", "i") if step % 2 else ("i", "j")
            rows = L.stripe_rows(held, cuts[other], axis)
            new = oned.partition_rows(rows, sizes[axis], len(cuts[other]) - 1, parts[axis], integral, by_value)
            same, cuts[axis] = new == cuts[axis], new
            if same:
                break
    finally:
        held.df.unpersist()
    return cuts["i"], cuts["j"]


def _refined(a: SparseMatrix, tries: list[tuple[str, Cuts, int]], full: bool) -> list[list[int]]:
    """One refinement of each (axis, cuts, parts): positions of the axis weighed by their largest load in a part of the other (full: by all loads at once).

    One pass over the nonzeros and one job for as many as the driver holds together; beyond L.FEW of them in a job, their loads are told apart by number.
    """
    n, integral = a.size, _is_integral(a)
    stripes = [len(cuts) - 1 if full else 1 for _, cuts, _ in tries]
    out: list[list[int]] = []
    while len(out) < len(tries):
        fits = [sum(stripes[len(out) : end]) * (n + 1) <= oned.LOCAL_CELLS for end in range(len(out) + 1, len(tries) + 1)]
        now = tries[len(out) : len(out) + max(1, sum(fits))]
        axis, cuts, parts = now[0]
        if full and len(now) == 1:
            out.append(oned.partition_rows(L.stripe_rows(a, cuts, axis), n, stripes[len(out)], parts, integral))
        elif not fits[0]:
            out.append(oned.partition_sums(L.row_max_sums(a, cuts, axis).withColumn("q", F.lit(0)), n, 1, parts, integral))
        else:
            out += _refined_locally(a, now, full, integral)
    return out


def _refined_locally(a: SparseMatrix, tries: list[tuple[str, Cuts, int]], full: bool, integral: bool) -> list[list[int]]:
    n, few = a.size, len(tries) <= L.FEW
    if few and not full:
        each = [L.row_max_sums(a, cuts, axis).select(F.lit(c).alias("c"), F.lit(0).alias("q"), "pos", "load") for c, (axis, cuts, _) in enumerate(tries)]
        sums = functools.reduce(DataFrame.unionAll, each)
    else:
        sums = L.many_stripe_sums(a, [(axis, cuts) for axis, cuts, _ in tries], full)
    got = sums.select("c", "q", F.col("pos").cast("long"), F.col("load").cast("long" if integral else "double")).toArrow()
    got = {name: got.column(name).to_numpy() for name in got.column_names}
    out = []
    for c, (_, cuts, parts) in enumerate(tries):
        own, grid = got["c"] == c, np.zeros((len(cuts) - 1 if full else 1, n + 1), np.int64 if integral else np.float64)
        grid[got["q"][own], got["pos"][own] + 1] = got["load"][own]
        out.append(oned.partition(oned.LocalPrefixes(np.cumsum(grid, 1)), parts))
    return out


def _square(cuts: list[int]) -> tuple[list[int], list[int]]:
    return cuts, cuts


def _rac(a: SparseMatrix, tries: list[int], max_iter: int, nic_ref: bool, best: bool) -> list[list[int]]:
    """rac for several numbers of parts, step by step together: a job for the refinements of a step, whatever their number."""
    n = a.size
    first = _refined(a, [(axis, [0] + [n] * k, k) for k in tries for axis in "ij"], nic_ref)
    loads = L.max_loads(a, [_square(c) for c in first])
    axes = ["i" if loads[2 * t] <= loads[2 * t + 1] else "j" for t in range(len(tries))]
    cuts = [first[2 * t + (axis == "j")] for t, axis in enumerate(axes)]
    seen = [(loads[2 * t + (axis == "j")], cuts[t]) for t, axis in enumerate(axes)]
    left = [max_iter or max(10, k) for k in tries]
    if len(set(axes)) > 1 or nic_ref:
        return _rac_steps(a, tries, axes, cuts, seen, left, nic_ref, best)
    with a.dealt(axes[0]) as dealt:
        return _rac_steps(dealt, tries, axes, cuts, seen, left, nic_ref, best)


def _rac_steps(a: SparseMatrix, tries: list[int], axes: list[str], cuts: list[list[int]], seen: list[tuple[float, list[int]]], left: list[int], nic_ref: bool, best: bool) -> list[list[int]]:
    going = list(range(len(tries)))
    while going := [t for t in going if left[t] > 1]:
        new = _refined(a, [(axes[t], cuts[t], tries[t]) for t in going], nic_ref)
        moved = [(t, c) for t, c in zip(going, new, strict=True) if c != cuts[t]]
        for t, c in moved:
            cuts[t], left[t] = c, left[t] - 1
        going = [t for t, _ in moved]
        if best and moved:
            for (t, c), x in zip(moved, L.max_loads(a, [_square(c) for _, c in moved]), strict=True):
                seen[t] = min(seen[t], (x, c), key=lambda y: y[0])
    return [c for _, c in seen] if best else cuts


def rac(a: SparseMatrix, parts: int, max_iter: int = 0, nic_ref: bool = False, best: bool = False) -> list[int]:
    """Refine a cut, direction first: the direction whose first refinement is lighter (rows on a tie) is refined until nothing moves.

    Returns the last cuts, or with `best` the lightest ones seen. Nonzeros are summed up by coordinate once and held for the steps.
    """
    with a.held() as held:
        return _rac(held, [parts], max_iter, nic_ref, best)[0]


def pbi(a: SparseMatrix, parts: int, max_iter: int = 0, nic_ref: bool = False) -> list[int]:
    """Refine a cut, both directions each time: the lighter one goes on, and the lightest of all is returned. Nonzeros are summed up by coordinate once; both directions are one job."""
    n, limit = a.size, max_iter or max(10, parts)
    start = [0] + [n] * parts
    with a.held() as held:

        def both(current: list[list[int]]) -> tuple[list[list[int]], list[float]]:
            new = _refined(held, [(axis, c, parts) for axis, c in zip("ij", current, strict=True)], nic_ref)
            return new, L.max_loads(held, [_square(c) for c in new])

        current, load = both([start, start])
        # the direction that is refined first is the lighter one; a tie afterwards goes to the second
        order = (0, 1) if load[0] <= load[1] else (1, 0)
        seen: tuple[float, list[int]] = (math.inf, start)
        new = current
        for k in range(limit):
            if k:
                new, load = both(current)
            pick = order[0] if load[order[0]] < load[order[1]] else order[1]
            before, current = current, [new[pick]] * 2
            if load[pick] < seen[0]:
                seen = (load[pick], new[pick])
            if k and before == current:
                break
    return seen[1]


def rac_under(a: SparseMatrix, z: float) -> tuple[list[int], bool]:
    """Refined cuts with the fewest parts whose heaviest tile is at most z, and whether they keep to z. Each of at most ROUNDS rounds refines several numbers of parts together."""
    with a.held() as held:
        most = len(_uniform_under(held, z)[0]) - 1
        made: dict[int, tuple[float, list[int]]] = {}

        def ok(ks: list[int]) -> list[bool]:
            fresh = [k for k in ks if k not in made]
            if fresh:
                cuts = _rac(held, fresh, 0, False, False)
                made.update(zip(fresh, zip(L.max_loads(held, [_square(c) for c in cuts]), cuts, strict=True), strict=True))
            return [made[k][0] <= z for k in ks]

        parts = _fewest(1, most, ok)
        good = ok([parts])[0]
        return made[parts][1], good


def diagonal_form(a: SparseMatrix) -> DataFrame:
    """(k, m, upper, w): each nonzero by its larger index, with the smaller one and whether it stands above the diagonal; equal ones summed up."""
    i, j = F.col("i"), F.col("j")
    return a.loads().groupBy(F.greatest(i, j).alias("k"), F.least(i, j).alias("m"), (i < j).alias("upper")).agg(F.sum("w").alias("w"))


class LocalDiagonal:
    def __init__(self, k: np.ndarray, m: np.ndarray, upper: np.ndarray, w: np.ndarray, n: int):
        order = np.argsort(k, kind="stable")
        self.k, self.m, self.upper, self.w, self.n = k[order], m[order], upper[order], w[order], n

    def close(self) -> None:
        pass

    def total(self) -> int:
        return int(self.w.sum())

    def reach(self, cuts: list[int], bound: float) -> int:
        """The farthest end of a new last part so that no tile of its row and column is above the bound."""
        first, inner = int(np.searchsorted(self.k, cuts[-1])), np.asarray(cuts)
        size = 4096
        while True:
            s = slice(first, min(len(self.k), first + size))
            strip = 2 * (np.searchsorted(inner, self.m[s], "right") - 1) + self.upper[s]
            strip[self.m[s] >= cuts[-1]] = 2 * len(cuts)  # the tile on the diagonal holds both sides
            order = np.argsort(strip, kind="stable")
            total = np.cumsum(self.w[s][order])
            new = np.flatnonzero(np.concatenate([[True], np.diff(strip[order]) > 0])) if len(order) else np.zeros(0, int)
            base = np.repeat((total - self.w[s][order])[new], np.diff(np.append(new, len(order))))
            over = order[total - base > bound]
            if len(over):
                return int(self.k[s][over.min()])
            if s.stop == len(self.k):
                return self.n
            size *= 8


class TableDiagonal:
    """The same over a table, dealt by ranges of k and sorted, so that a window of k is read from the files that hold it.

    The driver has the load of even blocks of k. A probe reads windows from the last cut on, each with twice the load of the one before, as sums by strip and block; what every strip has
    up to a window goes on to the next as a number. Where a strip's sum passes the bound, that block is read again in finer blocks, down to single positions. So a cut takes as
    many jobs as the strips' share of the load asks windows (a logarithm of the number of strips), and no task gets a strip.
    """

    def __init__(self, form: DataFrame, n: int, integral: bool = True):
        self.n, self.scratch, self.kind = n, Scratch(form.sparkSession), "long" if integral else "double"
        self.form = self.scratch.save(form.withColumn("w", F.col("w").cast(self.kind)).repartitionByRange("k").sortWithinPartitions("k"))
        self.width = max(1, -(-n // BLOCKS))
        got = self.form.groupBy(F.floor(F.col("k") / self.width).cast("int").alias("block")).agg(F.sum("w").alias("w")).toPandas()
        self.block = np.zeros(max(1, -(-n // self.width)), np.int64 if integral else np.float64)
        self.block[got["block"].to_numpy(int)] = got["w"].to_numpy(self.block.dtype)
        #: windows read
        self.windows = 0

    def close(self) -> None:
        self.scratch.close()

    def total(self) -> int:
        return int(self.block.sum())

    def _sums(self, cuts: list[int], a: int, b: int, width: int) -> np.ndarray:
        """Loads by strip and block of k in a window [a, b), given cuts of the parts so far; the last strip is the tile on the diagonal."""
        self.windows += 1
        last, k = cuts[-1], F.col("k")
        strip = F.when(F.col("m") >= last, F.lit(2 * len(cuts) - 2)).otherwise(2 * part_of("m", [*cuts, self.n + 1]) + F.col("upper").cast("int"))
        got = self.form.filter((k >= a) & (k < b)).groupBy(strip.alias("s"), F.floor((k - a) / width).cast("int").alias("b")).agg(F.sum("w").alias("w")).toPandas()
        out = np.zeros((2 * len(cuts) - 1, -(-(b - a) // width)), self.block.dtype)
        out[got["s"].to_numpy(int), got["b"].to_numpy(int)] = got["w"].to_numpy(self.block.dtype)
        return out

    def reach(self, cuts: list[int], bound: float) -> int:
        room = max(2, STRIP_CELLS // (2 * len(cuts) - 1))
        carry, at, load = np.zeros(2 * len(cuts) - 1, self.block.dtype), cuts[-1], max(bound, 1)
        while at < self.n:
            # up to where twice the load of the window before is sure to be
            load *= 2
            first = at // self.width
            upto = np.cumsum(self.block[first:])
            end = min(self.n, (first + max(1, int(np.searchsorted(upto, load, "right"))) + 1) * self.width)
            while True:
                width = -(-(end - at) // room)
                total = carry[:, None] + np.cumsum(self._sums(cuts, at, end, width), 1)
                over = np.flatnonzero((total > bound).any(0))
                if not len(over):
                    carry, at = total[:, -1], end
                    break
                start = at + int(over[0]) * width
                if width == 1:
                    return start
                carry, at, end = total[:, over[0] - 1] if over[0] else carry, start, min(end, start + width)
        return self.n


class GridSearch:
    """Bisection of the bound of diagonal probes over a table of whole loads that aren't negative, without a job for each probe.

    The driver has the sums of the matrix between marks, some positions of both axes. They tell between which positions a cut lies, given between which the cuts before it lie: an end at which
    a tile of the innermost parts is above the bound is too far, and one at which no tile of the outermost parts is can be reached. Where that leaves open whether a probe comes to the end (or, at last, where its
    cuts are), one job sums up the matrix between new marks within the ranges left. Ranges shrink by the number of new marks, so that jobs don't grow with the bounds probed.
    """

    def __init__(self, x: TableDiagonal):
        self.x, self.n = x, x.n
        self.even = np.unique(np.linspace(0, x.n, EVEN_MARKS + 1).astype(np.int64))
        #: jobs so far
        self.rounds, self.recent = 0, np.zeros(0, np.int64)
        self._mark(self.even)

    def _mark(self, at: np.ndarray) -> None:
        self.rounds += 1
        self.at = at
        i, j = F.when(F.col("upper"), F.col("m")).otherwise(F.col("k")), F.when(F.col("upper"), F.col("k")).otherwise(F.col("m"))
        cells = self.x.form.select(i.alias("i"), j.alias("j"), "w").groupBy(part_of("i", at.tolist()).alias("u"), part_of("j", at.tolist()).alias("v"))
        got = cells.agg(F.sum("w").alias("w")).toPandas()
        self.sums = np.zeros((len(at), len(at)), np.int64)
        self.sums[got["u"].to_numpy(int) + 1, got["v"].to_numpy(int) + 1] = got["w"].to_numpy(np.int64)
        self.sums = self.sums.cumsum(0).cumsum(1)

    def _ends(self, edges: list[tuple[int, int]], start: int, bound: int) -> np.ndarray:
        """Of each mark, whether the last part may end there: no tile of it with the parts between the edges, or with itself, is above the bound. All are numbers of marks."""
        p, e = self.sums, np.arange(start, len(self.at))
        most = p[e, e] - p[start, e] - p[e, start] + p[start, start]
        for a, b in edges:
            if a < b:
                most = np.maximum(most, (p[b, e] - p[a, e]) - (p[b, start] - p[a, start]))
                most = np.maximum(most, (p[e, b] - p[e, a]) - (p[start, b] - p[start, a]))
        return most <= bound

    def probe(self, bound: int, upper: list[tuple[int, int]], had: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """The first and last position at which each cut of diagonal_probe can lie; had: what other marks told."""
        cuts = [(0, 0)]
        for k in range(1, len(upper)):
            low = [int(np.searchsorted(self.at, a, "right")) - 1 for a, _ in cuts]  # marks around the cuts
            high = [int(np.searchsorted(self.at, b, "left")) for _, b in cuts]
            near = low[-1] + int(np.flatnonzero(self._ends(list(zip(low, high[1:], strict=False)), low[-1], bound)).max(initial=0))
            over = np.flatnonzero(~self._ends(list(zip(high, low[1:], strict=False)), high[-1], bound))
            far = int(self.at[high[-1] + over[0]]) - 1 if len(over) else self.n
            a = max(cuts[-1][0], min(int(self.at[near]), upper[k][0]))
            b = max(a, cuts[-1][1], min(far, upper[k][1]))
            cuts.append((max(a, had[k][0]), min(b, had[k][1])) if had else (a, b))
        return cuts

    def _refine(self, some: list[list[tuple[int, int]]]) -> None:
        # each by itself: within a wide one, the narrow ones of earlier cuts have to shrink, too
        ranges = sorted({(max(0, a - 1), min(self.n, b + 1)) for cuts in some for a, b in cuts if a < b})
        room = max(4, NEW_MARKS // max(1, len(ranges)))
        new = [np.unique(np.linspace(a, b, min(b - a, room) + 1).astype(np.int64)) for a, b in ranges]
        fixed = np.array([x for cuts in some for pair in cuts for x in pair], np.int64)
        new = np.unique(np.concatenate([fixed, *new]))
        old, self.recent = self.recent, new
        self._mark(np.unique(np.concatenate([self.even, old, new])))

    def search(self, low: int, high: int, parts: int, bounded: bool) -> list[int]:
        """The cuts of the least feasible bound from low to high, as diagonal_probe has them; if none below is, of high."""
        bounds = low, high
        reached: list[bool] = []  # what is known of the probes in their order
        known: dict[int, list[tuple[int, int]]] = {}  # by bound, where cuts lie as far as all marks so far have told

        def probe(bound: int, limit: list[tuple[int, int]]) -> list[tuple[int, int]]:
            known[bound] = self.probe(bound, limit, known.get(bound))
            return known[bound]

        while True:
            (low, high), limits, step = bounds, [[(self.n, self.n)] * (parts + 1)], 0
            while low < high:
                mid = (low + high) // 2
                # probes that are decided matter for their cuts alone
                cuts = probe(mid, limits[-1]) if step == len(reached) or bounded and reached[step] else []
                if step == len(reached):
                    if cuts[-1][0] < self.n <= cuts[-1][1]:
                        break
                    reached.append(cuts[-1][0] == self.n)
                if reached[step]:
                    high, limits = mid, [*limits, cuts] if bounded else limits
                else:
                    low = mid + 1
                step += 1
            else:
                # of the least feasible bound, cuts are limited by those that its probe came to before
                cuts = known[-1] = self.probe(high, limits[-1], known.get(-1))
                if all(a == b for a, b in cuts):
                    return [a for a, _ in cuts]
            some = [cuts]
            for limit in reversed(limits):
                some.append(limit)
                if all(a == b for a, b in limit):
                    break
            self._refine(some)


def diagonal(a: SparseMatrix) -> LocalDiagonal | TableDiagonal:
    form = diagonal_form(a).cache()
    try:
        if form.count() > LOCAL_NONZEROS:
            return TableDiagonal(form, a.size, _is_integral(a))
        got = form.select("k", "m", "upper", F.col("w").cast("long" if _is_integral(a) else "double")).toPandas()
        return LocalDiagonal(got["k"].to_numpy(), got["m"].to_numpy(), got["upper"].to_numpy().astype(int), got["w"].to_numpy(), a.size)
    finally:
        form.unpersist()


def diagonal_probe(x: LocalDiagonal | TableDiagonal, bound: float, upper: list[int] | None = None) -> list[int]:
    """Greedy symmetric cuts under a bound; `upper`: as many cuts as it has, none beyond it, padded with where it got stuck. The end is where no progress is possible or n."""
    cuts = [0]
    while len(cuts) < len(upper) if upper else cuts[-1] < x.n:
        end = x.reach(cuts, bound) if cuts[-1] < x.n else x.n
        end = max(cuts[-1], min(end, upper[len(cuts)]) if upper else end)
        cuts.append(end)
        if cuts[-1] == cuts[-2]:
            if upper:
                cuts += [cuts[-1]] * (len(upper) - len(cuts))
            break
    return cuts


def pal(a: SparseMatrix, parts: int, bounded: bool = True) -> list[int]:
    """Probe a load: bisects the bound of diagonal probes, the cuts of each feasible probe limiting the next ones (bounded).

    If heavy single nonzeros make even the usual upper bound infeasible, the search goes on up to the total load.
    """
    a.require_non_negative()
    x, n, integral = diagonal(a), a.size, _is_integral(a)
    total = x.total() if integral else a.total_load()
    low, high = -(-total // parts**2), min(total, -(-total // parts) + n)
    limit = [n] * (parts + 1)

    def search(low, high, limit):
        if grid:
            return grid.search(low, high, parts, bounded)
        while low < high if integral else high - low > 1e-9 * max(1.0, total):
            mid = (low + high) // 2 if integral else (low + high) / 2
            cuts = diagonal_probe(x, mid, limit)
            if cuts[-1] < n:
                low = mid + 1 if integral else mid
            else:
                high, limit = mid, cuts if bounded else limit
        return diagonal_probe(x, high, limit)

    try:
        grid = GridSearch(x) if integral and isinstance(x, TableDiagonal) else None
        cuts = search(low, high, limit)
        return cuts if cuts[-1] >= n else search(high, total, [n] * (parts + 1))
    finally:
        x.close()


def opal(a: SparseMatrix, parts: int) -> list[int]:
    """Ordered probe a load: the same search without limits from earlier probes."""
    return pal(a, parts, bounded=False)


def pal_under(a: SparseMatrix, z: float) -> tuple[list[int], bool]:
    """Diagonal cuts with no tile above z, and whether they reach the end."""
    a.require_non_negative()
    x = diagonal(a)
    try:
        cuts = diagonal_probe(x, z)
    finally:
        x.close()
    return cuts, cuts[-1] >= a.size
