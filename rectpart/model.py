"""The data model: a sparse matrix as a DataFrame of coordinates, and cut vectors.

Loads are 1 for each stored nonzero, or its weight. Stored duplicates all count, so every load is a sum. Whether a matrix is
weighted is fixed when it is made. Ids are 0-based 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Cuts = Sequence[int]


@dataclass(frozen=True)
class SparseMatrix:
    """Coordinates (i, j, v) with the declared sizes. ``loads()`` has what partitioners sum up."""

    df: DataFrame
    n_rows: int
    n_cols: int
    weighted: bool = False

    @property
    def size(self) -> int:
        return max(self.n_rows, self.n_cols)

    def loads(self) -> DataFrame:
        """(i, j, w): w is 1, or the weight of a weighted matrix."""
        return self.df.select("i", "j", (F.col("v") if self.weighted else F.lit(1).cast("long")).alias("w"))

    def nnz(self) -> int:
        return self.df.count()

    def total_load(self) -> int | float:
        return self.loads().agg(F.sum("w").alias("t")).first().t or 0

    def compacted(self) -> SparseMatrix:
        """One row for each coordinate with the sum of its loads, so that later steps read less. Cached: call unpersist() on df when done."""
        return SparseMatrix(self.loads().groupBy("i", "j").agg(F.sum("w").alias("v")).cache(), self.n_rows, self.n_cols, True)

    @contextmanager
    def held(self) -> Iterator[SparseMatrix]:
        """compacted() for the steps of one operator, freed at their end."""
        a = self.compacted()
        try:
            yield a
        finally:
            a.df.unpersist()

    @contextmanager
    def dealt(self, axis: str) -> Iterator[SparseMatrix]:
        """The same nonzeros by ranges of (position on the axis, other position) for steps that sum up by position: most positions lie in one task then, and heavy ones in several."""
        df = self.df.repartitionByRange(axis, "j" if axis == "i" else "i").cache()
        try:
            yield replace(self, df=df)
        finally:
            df.unpersist()

    def with_data(self, weighted: bool) -> SparseMatrix:
        return replace(self, weighted=weighted)

    def require_square(self) -> None:
        if self.n_rows != self.n_cols:
            raise ValueError(f"a square matrix is needed, not {self.n_rows} x {self.n_cols}")

    def require_non_negative(self) -> None:
        if self.weighted and not self.df.filter(F.col("v") < 0).isEmpty():
            raise ValueError("weights must not be negative")


def from_coordinates(df: DataFrame, i: str, j: str, v: str | None = None, n_rows: int | None = None, n_cols: int | None = None, weighted: bool | None = None) -> SparseMatrix:
    """Coordinates in two columns of any DataFrame. Sizes that aren't given are the largest ids + 1, or 0 for no rows."""
    coo = df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), (F.col(v) if v else F.lit(1).cast("long")).alias("v"))
    if n_rows is None or n_cols is None:
        top = coo.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
        n_rows = (top.i + 1 if top.i is not None else 0) if n_rows is None else n_rows
        n_cols = (top.j + 1 if top.j is not None else 0) if n_cols is None else n_cols
    return SparseMatrix(coo, n_rows, n_cols, v is not None if weighted is None else weighted)


def is_cut_vector(cuts: Cuts, n: int) -> bool:
    """Begins with 0, ends with n and never falls."""
    return len(cuts) >= 2 and cuts[0] == 0 and cuts[-1] == n and all(a <= b for a, b in zip(cuts, cuts[1:], strict=False))


def cuts_frame(spark, p: Cuts, q: Cuts | None = None) -> DataFrame:
    """(dim, k, lo, hi) for rows and, if given, columns."""
    rows = [(d, k, int(lo), int(hi)) for d, c in (("row", p), ("col", q)) if c is not None for k, (lo, hi) in enumerate(zip(c, c[1:], strict=False))]
    return spark.createDataFrame(rows, "dim string, k int, lo long, hi long")
