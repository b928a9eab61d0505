"""Which part an id belongs to: the last cut that isn't above it, so parts of no width stay empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Above this many parts a balanced CASE no longer fits one compiled method well.
MOST_CASES = 256


def _not_above(x: Column, cuts: Sequence[int]) -> Column:
    """How many of the rising cuts aren't above x, by a balanced CASE."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(x < int(cuts[mid - 1]), between(lo, mid - 1)).otherwise(between(mid, hi))

    return between(0, len(cuts))


def part_of(column: Column | str, cuts: Sequence[int]) -> Column:
    """Part number by a balanced CASE on the inner cuts (log2 comparisons a row); beyond MOST_CASES parts, by one on every so-manieth cut and a count within that run of cuts."""
    x, inner = F.col(column) if isinstance(column, str) else column, list(cuts[1:-1])
    width = -(-len(inner) // MOST_CASES)
    if width <= 1:
        return _not_above(x, inner)
    runs = [inner[k : k + width] for k in range(0, len(inner), width)]
    run = _not_above(x, [r[-1] for r in runs])
    table = F.array(*(F.array(*(F.lit(int(c)) for c in r)) for r in runs), F.array().cast("array<int>"))
    return F.least(run * width + F.size(F.filter(F.get(table, run), lambda c: c <= x)), F.lit(len(inner)))  # the last run may be shorter


def part_sql(x: str, cuts: Sequence[int]) -> str:
    """part_of as an SQL expression of x."""

    def between(inner: Sequence[int], lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi + 1) // 2
        return f"CASE WHEN {x} < {int(inner[mid - 1])}L THEN {between(inner, lo, mid - 1)} ELSE {between(inner, mid, hi)} END"

    inner = [int(c) for c in cuts[1:-1]]
    width = max(1, -(-len(inner) // MOST_CASES))
    runs = [inner[k : k + width] for k in range(0, len(inner), width)]
    run = between([r[-1] for r in runs], 0, len(runs))
    if width == 1:
        return run
    table = f"array({', '.join('array(' + ', '.join(f'{c}L' for c in r) + ')' for r in [*runs, []])})"
    return f"least({width} * ({run}) + size(filter(get({table}, {run}), c -> c <= {x})), {len(inner)})"


def register(spark: SparkSession, name: str, cuts: Sequence[int]) -> None:
    """For SQL, for these cuts: a function name(id), the part of an id, and a table function name_cuts(), the rows (k, lo, hi) of all parts. Both are plain SQL: queries with them run in the JVM."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(id BIGINT) RETURNS INT RETURN {part_sql('id', cuts)}")
    rows = ", ".join(f"({k}, {int(lo)}L, {int(hi)}L)" for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_cuts() RETURNS TABLE (k INT, lo BIGINT, hi BIGINT) RETURN SELECT * FROM VALUES {rows} AS t(k, lo, hi)")
