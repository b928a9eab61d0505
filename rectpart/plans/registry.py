"""Names of algorithms and orders. An algorithm is any callable (matrix, p, q, z, seed) -> (row cuts, column cuts)."""

from __future__ import annotations

from collections.abc import Callable

from rectpart.model import SparseMatrix
from rectpart.operators import exact as X
from rectpart.operators import subgradient as S
from rectpart.operators import twod as T

Algorithm = Callable[[SparseMatrix, int, int, float, int], tuple[list[int], list[int]]]
ALGORITHMS: dict[str, Algorithm] = {}
ORDERS = ("asc", "dsc", "rcm", "nat", "rnd")


def algorithm(*names: str) -> Callable[[Algorithm], Algorithm]:
    """Registers a partitioner under its names; users' own ones, too."""

    def add(f: Algorithm) -> Algorithm:
        ALGORITHMS.update(dict.fromkeys(names, f))
        return f

    return add


def get(name: str) -> Algorithm:
    """By name; dashes and capitals are taken as underscores and small letters."""
    key = name.lower().replace("-", "_")
    if key not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {name!r}; one of {', '.join(ALGORITHMS)}")
    return ALGORITHMS[key]


def _both(cuts: list[int]) -> tuple[list[int], list[int]]:
    return cuts, list(cuts)


@algorithm("uni")
def uni(a, p, q=0, z=0, seed=1):
    return _both(T.uniform_under(a, z)[0] if z else T.uniform(a.size, p))


@algorithm("nic")
def nic(a, p, q=0, z=0, seed=1):
    return T.nic(a, p, q)


@algorithm("nic_v")
def nic_v(a, p, q=0, z=0, seed=1):
    return T.nic(a, p, q, by_value=True)


@algorithm("rac")
def rac(a, p, q=0, z=0, seed=1):
    return _both(T.rac_under(a, z)[0] if z else T.rac(a, p))


@algorithm("pbi")
def pbi(a, p, q=0, z=0, seed=1):
    return _both(T.pbi(a, p))


@algorithm("pal")
def pal(a, p, q=0, z=0, seed=1):
    return _both(T.pal_under(a, z)[0] if z else T.pal(a, p))


@algorithm("opal")
def opal(a, p, q=0, z=0, seed=1):
    return _both(T.pal_under(a, z)[0] if z else T.opal(a, p))


@algorithm("sgo", "sgo_2ds")
def sgo(a, p, q=0, z=0, seed=1):
    return sgo_2dr(a, p, q, z, seed) if q else _both(S.sgo([a], "0ij,i=j", [p], seed)[0])


@algorithm("sgo_2dr")
def sgo_2dr(a, p, q=0, z=0, seed=1):
    return tuple(S.sgo([a], "0ij", [p, q or p], seed))


@algorithm("sgo_2dr_nic")
def sgo_2dr_nic(a, p, q=0, z=0, seed=1):
    return T.nic(a, p, q, start=sgo_2dr(a, p, q, z, seed)[0])


@algorithm("sgo_3ds")
def sgo_3ds(a, p, q=0, z=0, seed=1):
    return _both(S.sgo([a], "0ij+0jk+0ik", [p], seed)[0])


@algorithm("mip", "exact")
def exact(a, p, q=0, z=0, seed=1):
    return X.exact(a, p, q, symmetric=not q)


def sgo_3dr(a: SparseMatrix, b: SparseMatrix, p: int, q: int, r: int, seed: int = 1) -> list[list[int]]:
    """Three cut vectors for a product of two matrices."""
    return S.sgo([a, b], "0ij+1jk", [p, q, r], seed)
