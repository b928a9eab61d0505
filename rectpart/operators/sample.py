"""Samples of nonzeros that depend on their coordinates and the seed alone, so that a lost task gives the same rows again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rectpart.model import SparseMatrix

STEPS = 1 << 30


def keep_probability(nnz: int, p: int, q: int, prob: float) -> float:
    """prob up to 1 is itself; above 1 it's an error factor: min(1, (P prob)(Q prob) / nnz)."""
    return prob if prob <= 1 else min(1.0, p * prob * q * prob / max(1, nnz))


def keep_probability_column(nnz: Column, p: Column, q: Column, prob: Column) -> Column:
    return F.when(prob <= 1, prob).otherwise(F.least(F.lit(1.0), p * prob * q * prob / nnz))


def mask(prob: float, seed: int, *columns: str) -> Column:
    """True with the given probability, independently for different values of the columns."""
    return F.lit(True) if prob >= 1 else F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(STEPS)) < int(prob * STEPS)


def sparsify(a: SparseMatrix, prob: float, seed: int = 1) -> SparseMatrix:
    """Keeps each distinct coordinate with the given probability; sizes and weights stay."""
    return SparseMatrix(a.df.filter(mask(prob, seed, "i", "j")), a.n_rows, a.n_cols, a.weighted)


def arithmetic_mask(prob: float, seed: int) -> Column:
    """The same with a hash that any SQL engine has; coarser (thousandths)."""
    return (F.col("i") * 2654435761 + F.col("j") * 40503 + seed) % 1000 < int(1000 * prob)
