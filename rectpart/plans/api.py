"""Short names for users: nic(a, 8), then Loads(a).max_load(p, q)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rectpart.model import Cuts, SparseMatrix
from rectpart.operators import loads as L
from rectpart.plans import registry


class Loads:
    """Load queries on one matrix; every nonzero counts 1 unless the matrix is weighted. The compacted nonzeros stay cached until close()."""

    def __init__(self, a: SparseMatrix):
        self.a = a.compacted()

    def size(self) -> int:
        return self.a.size

    def query(self, upper_left: tuple[int, int], lower_right: tuple[int, int]) -> int | float:
        return L.rectangle_query(self.a, upper_left, lower_right).first().load

    def query_table(self, rectangles: DataFrame) -> DataFrame:
        """The rows of a table (r1, c1, r2, c2) with their load."""
        return L.rectangle_loads(self.a, rectangles)

    def loads(self, p: Cuts, q: Cuts) -> list[list]:
        grid = [[0] * (len(q) - 1) for _ in range(len(p) - 1)]
        for r in L.tile_loads(self.a, p, q, fill=False).collect():
            grid[r.u][r.v] = r.load
        return grid

    def max_load(self, p: Cuts, q: Cuts) -> int | float:
        return L.max_load(self.a, p, q)

    def close(self) -> None:
        self.a.df.unpersist()


def _call(name: str):
    def f(a: SparseMatrix, p: int, q: int = 0, z: float = 0, seed: int = 1) -> tuple[list[int], list[int]]:
        return registry.get(name)(a, p, q, z, seed)

    f.__name__ = name
    return f


uni, nic, rac, pbi, pal, opal, sgo, sgo_2ds, sgo_2dr = map(_call, ("uni", "nic", "rac", "pbi", "pal", "opal", "sgo", "sgo_2ds", "sgo_2dr"))
