"""Generated matrices against the definitions, and published results on one public graph where $MATRIX_DIR has its file: tile loads of known cuts, and the cuts themselves."""

import os

import numpy as np
import pytest

from rectpart.operators import loads, twod
from rectpart.sources import matrices

FILE = os.path.join(os.environ.get("MATRIX_DIR", ""), "email-Eu-core.mtx")


def best_cuts(load, n, parts):
    """Greedy cuts under the least feasible bound, by dynamic programming over all ends. load(a, b): the load of a part."""
    least = [[float("inf")] * (n + 1) for _ in range(parts + 1)]
    least[0][0] = 0
    for p in range(1, parts + 1):
        for b in range(n + 1):
            least[p][b] = min(max(least[p - 1][a], load(a, b)) for a in range(b + 1))
    cuts = [0]
    while len(cuts) <= parts:
        cuts.append(max(b for b in range(cuts[-1], n + 1) if load(cuts[-1], b) <= least[parts][n]))
    return cuts


def stripes(d, other):
    """Load of a part of the rows: its heaviest tile."""
    sums = np.stack([d[:, a:b].sum(1) for a, b in zip(other, other[1:])])
    upto = np.concatenate([np.zeros((len(sums), 1), int), np.cumsum(sums, 1)], 1)
    return lambda a, b: (upto[:, b] - upto[:, a]).max()


@pytest.mark.parametrize("seed", [1, 2])
def test_alternation_by_its_definition(spark, seed):
    rng = np.random.default_rng(seed)
    points = [*zip(rng.integers(0, 24, 300).tolist(), (rng.integers(0, 24, 300) ** 2 // 24).tolist()), (23, 23)]
    a, d = matrices.from_points(spark, points), np.zeros((24, 24), int)
    np.add.at(d, tuple(zip(*points)), 1)
    rows = best_cuts(stripes(d.sum(1, keepdims=True), [0, 1]), 24, 4)
    cuts = {0: rows, 1: rows}
    for step in range(10):
        axis = (step + 1) % 2
        new = best_cuts(stripes(d if axis == 0 else d.T, cuts[1 - axis]), 24, 4)
        same, cuts[axis] = new == cuts[axis], new
        if same:
            break
    assert twod.nic(a, 4) == (cuts[0], cuts[1])


@pytest.mark.parametrize("seed", [1, 2])
def test_diagonal_probes_by_their_definition(spark, seed):
    """The lightest bound under which growing diagonal tiles greedily reaches the end."""
    rng = np.random.default_rng(seed)
    points = [*zip(rng.integers(0, 24, 300).tolist(), rng.integers(0, 24, 300).tolist()), (23, 23)]
    a, d = matrices.from_points(spark, points), np.zeros((24, 24), int)
    np.add.at(d, tuple(zip(*points)), 1)

    def probe(bound, parts):
        cuts = [0]
        while len(cuts) <= parts:
            s, ends = cuts[-1], []
            for b in range(s, 25):
                spans = [(x, y) for x, y in zip(cuts, cuts[1:])] + [(s, b)]
                if all(d[s:b, x:y].sum() <= bound and d[x:y, s:b].sum() <= bound for x, y in spans):
                    ends.append(b)
            cuts.append(max(ends))
        return cuts

    least = next(z for z in range(d.sum() + 1) if probe(z, 4)[-1] == 24)
    assert twod.opal(a, 4) == probe(least, 4)
    assert loads.max_load(a, *[twod.pal(a, 4)] * 2) <= least


# Published cuts and loads.
NIC_ROWS, NIC_COLS = [0, 115, 254, 438, 1005], [0, 132, 283, 481, 1005]
NIC_LOADS = [[1914, 1502, 1562, 1379], [1655, 1914, 1572, 1262], [1626, 1621, 1923, 1248], [1584, 1408, 1484, 1917]]
PAL = [0, 124, 271, 458, 1005]
PAL_LOADS = [[1937, 1635, 1662, 1634], [1545, 1929, 1607, 1421], [1513, 1548, 1934, 1396], [1334, 1283, 1240, 1953]]
NIC_8 = ([0, 61, 113, 168, 249, 339, 434, 551, 1005], [0, 51, 125, 206, 283, 380, 495, 710, 1005])

@pytest.fixture(scope="module")
def graph(spark):
    if not os.path.exists(FILE):
        pytest.skip(f"the published matrix isn't there: {FILE}")
    a = matrices.load_matrix(spark, FILE)
    a.df.cache()
    return a


@pytest.mark.parametrize(("p", "q", "want"), [(NIC_ROWS, NIC_COLS, NIC_LOADS), (PAL, PAL, PAL_LOADS)])
def test_tile_loads(graph, p, q, want):
    assert [[r.load for r in sorted(loads.tile_loads(graph, p, q).collect()) if r.u == u] for u in range(4)] == want


def test_nic(graph):
    assert twod.nic(graph, 4) == (NIC_ROWS, NIC_COLS)
    assert twod.nic(graph, 8) == NIC_8
    assert loads.max_load(graph, *NIC_8) == 543
    assert round(loads.balance(graph, NIC_ROWS, NIC_COLS).first().imbalance_nnz, 5) == 1.20324


def test_pal(graph):
    assert twod.pal(graph, 4) == PAL and twod.opal(graph, 4) == PAL
    assert loads.max_tri_load(loads.tile_loads(graph, PAL, PAL)).first().max_tri_load == 5859
