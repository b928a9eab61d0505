"""One-dimensional partitions: cuts of small arrays, and brute force."""

import uuid
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rectpart.operators import oned as D

LOADS = [4, 9, 1, 1, 30, 2, 7, 16]


def prefix(values):
    return D.as_prefixes(np.concatenate([[0], np.cumsum(values)]))


@pytest.mark.parametrize(
    ("values", "parts", "cuts"),
    [([0, 0, 7], 1, [0, 3]), ([0, 0, 7], 3, [0, 3, 3, 3]), ([0, 0], 2, [0, 2, 2]), (LOADS, 1, [0, 8]), (LOADS, 2, [0, 5, 8]), (LOADS, 3, [0, 4, 5, 8]), (LOADS, 4, [0, 4, 5, 8, 8]),
     ([2.5, 2.5, 2.5, 2.75], 2, [0, 2, 4])],
)
def test_cuts(values, parts, cuts):
    assert D.partition_values(values, parts) == cuts


@pytest.mark.parametrize(("parts", "bound", "ok"), [(3, 29, False), (3, 30, True), (2, 44, False), (2, 45, True), (9, 29, False)])
def test_feasible(parts, bound, ok):
    assert D.feasible(prefix(LOADS), parts, bound) is ok


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=6, max_size=6), min_size=1, max_size=4), st.integers(1, 4), st.integers(1, 3))
def test_several_arrays(rows, parts, copies):
    """Several arrays at once, and some of them more than once: the least bound by trying all cuts, and greedy cuts under it."""
    upto = np.concatenate([np.zeros((len(rows), 1), int), np.cumsum(rows, 1)], 1)
    load = lambda c: max((upto[:, b] - upto[:, a]).max() for a, b in zip(c, c[1:]))
    best = min(load([0, *c, 6]) for c in combinations_with_replacement(range(7), parts - 1))
    x = D.as_prefixes(np.concatenate([upto] * copies))
    cuts = D.partition(x, parts)
    assert load(cuts) == best == D.bottleneck(x, parts) and D.feasible(x, parts, best) and (best == 0 or not D.feasible(x, parts, best - 1))
    assert all(k == 6 or (upto[:, k + 1] - upto[:, a]).max() > best for a, k in zip(cuts, cuts[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=9), st.integers(1, 5))
def test_brute_force(values, parts):
    upto = np.concatenate([[0], np.cumsum(values)])
    best = min(max(upto[b] - upto[a] for a, b in zip([0, *c], [*c, len(values)])) for c in combinations_with_replacement(range(len(values) + 1), parts - 1))
    for v in (values, [float(x) for x in values]):
        cuts = D.partition_values(v, parts)
        assert len(cuts) == parts + 1 and cuts[-1] == len(values)
        assert max(upto[b] - upto[a] for a, b in zip(cuts, cuts[1:])) == best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 99), min_size=9, max_size=9), min_size=1, max_size=2), st.sampled_from([0.01, 0.1, 7.3, 1e6, 1e-9]), st.integers(1, 6))
def test_real_loads(rows, unit, parts):
    """Decimals that doubles only come near to: the bound is the heaviest part of the cuts, to the last digit, and the least that any cuts have; few probes."""
    upto = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(np.array(rows) * unit, 1)], 1)
    load = lambda c: max((upto[:, b] - upto[:, a]).max() for a, b in zip(c, c[1:]))
    x = D.as_prefixes(upto)
    probes, plain = [], x.probe
    x.probe = lambda bound, parts: probes.append(bound) or plain(bound, parts)
    bound, cuts = x.bottleneck(parts)
    assert cuts[-1] == 9 and len(cuts) == parts + 1 and len(probes) <= 54 + np.log2(9)
    assert bound == load(cuts) == min(load([0, *c, 9]) for c in combinations_with_replacement(range(10), parts - 1))


def test_real_loads_at_the_last_digit():
    """Ranges that shrink to neighbouring doubles end, too."""
    rng = np.random.default_rng(1)
    for _ in range(2000):
        n, parts = (int(x) for x in rng.integers(1, (30, 7)))
        values = (rng.random(n) * rng.choice([1, 10, 1000])).round(2)
        x = D.as_prefixes(np.concatenate([[0], np.cumsum(values)]))
        bound, cuts = x.bottleneck(parts)
        assert cuts[-1] == n and bound == max(x.load(a, b) for a, b in zip(cuts, cuts[1:])) and not D.feasible(x, parts, np.nextafter(bound, 0))


def jobs_of(spark, action):
    """What an action returns, and how many jobs it took."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return action(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("none", "")


def some_sums(seed, stripes, n, kind):
    rng = np.random.default_rng(seed)
    loads = {"even": lambda: rng.integers(0, 30, (stripes, n)), "sparse": lambda: rng.integers(0, 9, (stripes, n)) * (rng.random((stripes, n)) < 0.02), "one heavy": lambda: rng.integers(0, 3, (stripes, n)) + 5000 * (np.arange(n) == n // 3),
             "real": lambda: rng.random((stripes, n)).round(3), "falling": lambda: (10_000 / (1 + np.arange(n))).astype(int)[None, :].repeat(stripes, 0)}[kind]()
    return loads, pd.DataFrame([(q, int(k), loads[q, k].item()) for q in range(stripes) for k in np.flatnonzero(loads[q])], columns=["q", "pos", "load"])


@pytest.mark.parametrize(("kind", "stripes", "parts"), [("even", 1, 3), ("real", 1, 3), *((kind, 3, 7) for kind in ("even", "sparse", "one heavy", "real", "falling"))])
def test_table_and_driver_agree(spark, kind, stripes, parts, monkeypatch):
    """With only 8 marks a range and no cells on the driver: the same cuts, bottleneck and probes."""
    loads, sums = some_sums(3, stripes, 700, kind)
    monkeypatch.setattr(D, "MARKS", 8)
    monkeypatch.setattr(D, "PROBED", 6)
    df, integral = spark.createDataFrame(sums), kind != "real"
    near = D.prefixes_of(df, 700, stripes, integral)
    monkeypatch.setattr(D, "LOCAL_CELLS", 0)
    far = D.prefixes_of(df, 700, stripes, integral)
    assert isinstance(far, D.TablePrefixes) and np.allclose(far.totals(), near.totals())
    assert D.partition(far, parts) == D.partition(near, parts)
    assert np.isclose(D.bottleneck(far, parts), D.bottleneck(near, parts))
    assert np.isclose(D.bottleneck(far, parts), max(loads[:, a:b].sum(1).max() for a, b in zip(D.partition(far, parts), D.partition(far, parts)[1:])))
    for bound in (float(near.totals()[0]) / 5 + 0.0001, near.totals()[1] - 1, 0):
        assert D.probe(far, bound, 9) == D.probe(near, bound, 9) and D.feasible(far, parts, bound) == D.feasible(near, parts, bound)
    for bound in (near.totals()[0] / 20 + 0.0001, 0) if stripes == 3 and kind in ("sparse", "real") else ():
        assert D.probe(far, bound) == D.probe(near, bound)
    far.close()
    assert D.partition_sums(df.limit(0), 0, stripes, 2) == [0, 0, 0] and D.partition_sums(df.limit(0), 5, stripes, 2) == [0, 5, 5]


def test_jobs_of_a_long_table(spark, monkeypatch):
    """A million positions under a bound of 0 cells: few jobs, whatever the length; and no array of prefix sums by window."""
    monkeypatch.setattr(D, "LOCAL_CELLS", 0)
    monkeypatch.setattr(D, "MARKS", 64)
    for n in (25, 1_000_000):
        df = spark.range(n).selectExpr("0 q", "id pos", "(id * 7919) % 101 load")
        cuts, jobs = jobs_of(spark, lambda df=df, n=n: D.partition_sums(df, n, 1, 8))
        values = (np.arange(n) * 7919) % 101
        assert cuts == D.partition_values(values, 8) and jobs <= 40


@pytest.mark.parametrize("kind", ["even", "sparse", "one heavy", "falling", "blocks"])
def test_rows_that_share_positions(spark, kind, monkeypatch):
    """Loads in pieces are searched by few marks a round: no sum for each position, no table, and the cuts of the driver's search."""
    loads, sums = some_sums(5, 3, 3000, "even" if kind == "blocks" else kind)
    if kind == "blocks":
        sums = sums[sums["pos"] // 1000 == sums["q"]]
    near = D.partition_sums(spark.createDataFrame(sums), 3000, 3, 5)
    rows = spark.createDataFrame(pd.concat([sums, sums, sums.assign(load=sums["load"] % 3)]))
    want = D.partition_sums(rows.groupBy("q", "pos").agg({"load": "sum"}).withColumnRenamed("sum(load)", "load"), 3000, 3, 5)
    monkeypatch.setattr(D, "MARKS", 8)
    monkeypatch.setattr(D, "ROW_CELLS", 100)
    monkeypatch.setattr(D, "ROW_MARKS", 192)
    monkeypatch.setattr(D, "WIDE", 4)

    def none(*_):
        raise AssertionError("a sum for each position")

    monkeypatch.setattr(D, "prefixes_of", none)
    assert D.partition_rows(spark.createDataFrame(sums), 3000, 3, 5) == near
    cuts, jobs = jobs_of(spark, lambda: D.partition_rows(rows, 3000, 3, 5))
    assert cuts == want and jobs <= 40
    assert D.partition_rows(rows.limit(0), 3000, 3, 2) == [0, 3000, 3000]
