"""Sources, sinks, reshaping and loads on small matrices."""

import io
from itertools import combinations, combinations_with_replacement

import numpy as np
import pytest
from pyspark.sql import functions as F

from rectpart.functions.parts import part_of, register
from rectpart.model import SparseMatrix, is_cut_vector
from rectpart.operators import exact, loads, oned, reshape, sample, subgradient, twod
from rectpart.plans import api, catalog, cli, engine, registry
from rectpart.sources import csr, matrices, sinks
from tests.test_oned import jobs_of


def random_points(n, m, k, seed):
    rng = np.random.default_rng(seed)
    return list(zip(rng.integers(0, n, k).tolist(), rng.integers(0, m, k).tolist()))


@pytest.fixture(scope="module")
def square(spark):
    a = matrices.from_points(spark, [*random_points(30, 30, 400, 1), (29, 29)], np.random.default_rng(2).integers(1, 9, 401).tolist(), weighted=True)
    a.df.cache()
    return a


def dense(a):
    out = np.zeros((a.n_rows, a.n_cols))
    for r in a.loads().collect():
        out[r.i, r.j] += r.w
    return out


def grid(d, p, q):
    return np.array([[d[a:b, c:e].sum() for c, e in zip(q, q[1:])] for a, b in zip(p, p[1:])])


def test_matrix_market(spark, tmp_path):
    f = tmp_path / "x.mtx"
    f.write_text("%%MatrixMarket matrix coordinate real general\n% a comment\n4 5 3\n1 1 2.5\n3 5 -1\n2 2 4\n")
    a = matrices.load_matrix(spark, str(f), True)
    assert (a.n_rows, a.n_cols, a.nnz()) == (4, 5, 3)
    assert sorted(map(tuple, a.df.collect())) == [(0, 0, 2.5), (1, 1, 4.0), (2, 4, -1.0)]
    with pytest.raises(ValueError):
        a.require_non_negative()
    f.write_text("%%MatrixMarket matrix array real general\n1 1\n3\n")
    with pytest.raises(ValueError):
        matrices.load_matrix(spark, str(f))
    with pytest.raises(ValueError):
        matrices.load_matrix(spark, "x.txt")
    with pytest.raises(FileNotFoundError):
        matrices.load_matrix(spark, "absent.mtx")


def test_pattern_is_unweighted(spark, tmp_path):
    f = tmp_path / "p.mtx"
    f.write_text("%%MatrixMarket matrix coordinate pattern symmetric\n3 3 2\n2 1\n3 3\n")
    a = matrices.load_matrix(spark, str(f), True)
    assert not a.weighted and sorted((r.i, r.j, r.w) for r in a.loads().collect()) == [(1, 0, 1), (2, 2, 1)]


def raw_csr(a, ids=4, weights=4):
    """The layout put together plainly."""
    rows = sorted((r.i, r.j, r.v) for r in a.df.collect())
    indptr = np.cumsum([0, *np.bincount([r[0] for r in rows], minlength=a.n_rows)]) if a.n_rows else [0]
    parts = [np.asarray(x, f"<u{ids}").tobytes() for x in ([a.n_rows, a.n_cols], indptr, [r[1] for r in rows])]
    return f"{ids} {weights}\n".encode() + b"".join(parts) + (np.asarray([r[2] for r in rows], f"<u{weights}").tobytes() if a.weighted else b"")


def test_binary_round_trip(spark, square, tmp_path):
    path = str(tmp_path / "x.bin")
    for a in (square, square.with_data(False), matrices.from_points(spark, []), matrices.from_points(spark, [(0, 1), (0, 1), (7, 0)])):
        sinks.write_binary_csr(a, path)
        assert open(path, "rb").read() == raw_csr(a) and matrices.validate_csr(path, spark)
        assert reshape.same_matrix(matrices.load_matrix(spark, path, True), a) and not (tmp_path / "x.bin.writing").exists()
    for ids, weights in ((8, 4), (8, 8), (4, 8)):
        open(path, "wb").write(raw_csr(square, ids, weights))
        assert reshape.same_matrix(matrices.load_matrix(spark, path, True), square)
    raw = raw_csr(square)
    swapped = raw[:16] + raw[20:24] + raw[16:20] + raw[24:]  # two neighbours of indptr
    for broken in (raw[:-2], raw[:3], raw[:9], b"5 4\n" + raw[4:], raw[:12] + b"\1" + raw[13:], swapped, raw[:8] + b"\2\0\0\0" + raw[12:]):
        open(path, "wb").write(broken)
        assert not matrices.validate_csr(path, spark)


def test_binary_file_in_many_tasks(spark, square, tmp_path):
    """Ten parts: hub rows over several tasks, empty rows at their borders; no task reads more than its part."""
    path, points = str(tmp_path / "x.bin"), [*((3, j) for j in range(500)), *((k, 7) for k in range(100, 400, 3))]
    a = matrices.from_points(spark, points, list(range(1, len(points) + 1)), weighted=True)
    sinks.write_binary_csr(a, path)
    b = csr.read_csr(spark, path, True, partition_bytes=-(-4 * len(points) // 10))
    assert b.df.rdd.getNumPartitions() == 10 and reshape.same_matrix(a, b)
    assert max(len(x) for x in b.df.rdd.glom().collect()) <= 61
    assert csr.is_valid(spark, path, 50)


@pytest.mark.parametrize("value", [2.75, -3, 2**33, None])
def test_weights_that_do_not_fit(spark, tmp_path, value):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 1, value if value is None else float(value))], "i long, j long, v double")
    path = tmp_path / "x.bin"
    with pytest.raises(ValueError):
        sinks.write_binary_csr(SparseMatrix(df, 2, 2, True), str(path))
    assert not path.exists()
    with pytest.raises(ValueError):
        sinks.write_binary_csr(SparseMatrix(df.fillna(1.0), 1, 2), str(path))
    if value == 2**33:
        sinks.write_binary_csr(SparseMatrix(df, 2, 2, True), str(path), weight_bytes=8)
        assert matrices.load_matrix(spark, str(path), True).total_load() == 2**33 + 1


def test_binary_from_standard_input(spark, square, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(raw_csr(square))))
    assert reshape.same_matrix(matrices.load_matrix(spark, "-", True), square)
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"%%MatrixMarket matrix coordinate integer general\n2 2 1\n2 1 5\n")))
    assert matrices.load_matrix(spark, "-", True).total_load() == 5


def test_csr_and_dense_sources(spark):
    a = matrices.from_csr(spark, [0, 2, 4, 7, 8, 8, 8], [0, 1, 1, 3, 2, 3, 4, 5], n_cols=6)
    assert (a.n_rows, a.n_cols, a.total_load()) == (6, 6, 8)
    b = matrices.from_dense(spark, dense(a).astype(int).tolist())
    assert (b.n_rows, b.n_cols) == (6, 6) and reshape.same_matrix(a, b)
    empty = matrices.from_points(spark, [])
    assert (empty.n_rows, empty.total_load()) == (0, 0)


def test_text_forms(spark, square, tmp_path):
    a = matrices.from_points(spark, [(0, 1), (0, 2), (2, 0)])
    assert [r.line for r in reshape.adjacency_lines(a).orderBy("i").collect()] == ["0 : 1 2", "1 :", "2 : 0"]
    path = tmp_path / "x.txt"
    sinks.write_dense_text(a, str(path))
    assert path.read_text() == "3 3\n0\n1\n1\n0\n0\n0\n1\n0\n0\n"
    sinks.write_csr_text(a, str(path))
    assert path.read_text() == "3\n3\n0 2 2 3\n1 2 0\n1 1 1\n"
    sinks.write_csr_text(matrices.from_points(spark, []), str(path))
    assert path.read_text() == "0\n0\n0\n\n\n"
    sinks.write_csr_text(square, str(path))
    rows = sorted((r.i, r.j, r.v) for r in square.df.collect())
    assert path.read_text().splitlines()[3:] == [" ".join(str(r[k]) for r in rows) for k in (1, 2)]
    assert sinks.cuts_text([0, 1, 3], [0, 1, 3]) == "2\n0 1 3\n" and sinks.cuts_text([0, 3], [0, 1, 3]) == "1\n0 3\n2\n0 1 3\n"


def test_tiles_sink(spark, square, tmp_path):
    path = str(tmp_path / "tiles")
    sinks.write_tiles(square, [0, 10, 30], [0, 10, 30], path)
    one = spark.read.parquet(path).filter("u = 1 and v = 0")
    assert one.count() == square.df.filter("i >= 10 and j < 10").count()
    assert {r.u for r in one.select("u").distinct().collect()} == {1}


@pytest.mark.parametrize("cuts", [[0, 30], [0, 7, 7, 20, 30], [0, 0, 30, 30], list(range(31))])
def test_loads(square, cuts):
    d, q = dense(square), [0, 11, 30]
    tiles = loads.tile_loads(square, cuts, q)
    got = np.zeros((len(cuts) - 1, 2))
    for r in tiles.collect():
        got[r.u, r.v] = r.load
    assert (got == grid(d, cuts, q)).all()
    assert loads.max_load(square, cuts, q) == got.max()
    back = {(r.u, r.v): r.load for r in loads.loads_from_corners(loads.corner_prefix_loads(tiles)).collect()}
    assert all(got[k] == v for k, v in back.items())


def test_many_parts_use_the_same_rule(spark):
    n, cuts = 2000, sorted([0, 2000, *np.random.default_rng(1).integers(0, 2000, 500).tolist()])
    got = spark.range(n).select("id", part_of("id", cuts).alias("p")).collect()
    assert all(cuts[r.p] <= r.id < cuts[r.p + 1] for r in got)
    few = cuts[::60][:-1] + [2000]
    assert all(few[r.p] <= r.id < few[r.p + 1] for r in spark.range(n).select("id", part_of("id", few).alias("p")).collect())


def test_rectangles(square):
    d = dense(square)
    assert loads.rectangle_query(square, (3, 4), (20, 9)).first().load == d[2:20, 3:9].sum()
    assert [r.load for r in loads.prefix_query(square, [(5, 6), (30, 30), (0, 3)]).collect()] == [d[:5, :6].sum(), d.sum(), 0]


@pytest.mark.parametrize(("bits", "blocks"), [(4, 1024), (1, 2), (3, 7)])
def test_table_of_rectangles(spark, square, bits, blocks, monkeypatch):
    """Against a dense array: repeated and empty rectangles, corners outside of the matrix, nulls; no nested loop in the plan."""
    monkeypatch.setattr(loads, "DIGIT_BITS", bits)
    monkeypatch.setattr(loads, "ROW_BLOCKS", blocks)
    rng, d = np.random.default_rng(4), dense(square).astype(int)
    rows = [tuple(map(int, x)) for x in np.sort(rng.integers(1, 31, (40, 2, 2)), 1).reshape(40, 4)] + [(1, 1, 30, 30)] * 2 + [(5, 5, 4, 9), (1, 1, 99, 99), (29, 30, 30, 31), (0, 1, 3, 3)]
    table = spark.createDataFrame([*((k, *x) for k, x in enumerate(rows)), (99, None, 1, 2, 2)], "id int, r1 int, c1 int, r2 int, c2 int")
    out = loads.rectangle_loads(square, table)
    got = {r.id: r.load for r in out.collect()}
    assert got == {**{k: d[max(0, a - 1) : e, max(0, b - 1) : f].sum() for k, (a, b, e, f) in enumerate(rows)}, 99: None}
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert loads.rectangle_loads(square, table.limit(0)).count() == 0
    one = api.Loads(square)
    assert one.query_table(spark.createDataFrame([(2, 3, 9, 9)], "r1 int, c1 int, r2 int, c2 int")).first().load == one.query((2, 3), (9, 9))
    one.close()


@pytest.mark.parametrize("kind", ["long", "double", "decimal(20,1)"])
def test_rectangles_by_strips(spark, square, kind, monkeypatch):
    """Many narrow strips, a hub row and a hub column: each nonzero and corner goes to two strips at most, once dealt, and loads are those of a dense array."""
    monkeypatch.setattr(loads, "STRIP_ROWS", 20)
    rng = np.random.default_rng(8)
    points = [*((int(i), int(j), int(w)) for i, j, w in rng.integers(0, 40, (300, 3))), *((7, k % 40, 2) for k in range(200)), *((k % 40, 39, 3) for k in range(200))]
    d = np.zeros((41, 41), int)
    np.add.at(d, tuple(np.array(points)[:, :2].T), np.array(points)[:, 2])
    a = SparseMatrix(spark.createDataFrame(points, "i long, j long, v long").withColumn("v", F.col("v").cast(kind)), 40, 40, True)
    rows = [(k, *map(int, (*np.sort(x[0]), *np.sort(x[1])))) for k, x in enumerate(rng.integers(1, 41, (200, 2, 2)))] + [(200, 8, 8, 1, 40), (201, 1, 40, 40, 40), (202, 1, 99, 1, 99)]
    table = spark.createDataFrame(rows, "id int, r1 int, r2 int, c1 int, c2 int")
    out = loads.rectangle_loads(a, table)
    assert {r.id: float(r.load) for r in out.collect()} == {k: d[r1 - 1 : r2, c1 - 1 : c2].sum() for k, r1, r2, c1, c2 in rows}
    p, q = loads.strip_cuts(a.df, 40, 40)
    assert {7, 8} <= set(p) and {39, 40} <= set(q) and len(p) > 20


def test_transpose_is_an_involution(square):
    t = reshape.transpose(square)
    assert (dense(t) == dense(square).T).all() and reshape.same_matrix(reshape.transpose(t), square)


@pytest.mark.parametrize("order", ["asc", "dsc", "rnd", "rcm"])
def test_orders_are_permutations(spark, square, order):
    perm = {"asc": lambda: reshape.degree_order(square), "dsc": lambda: reshape.degree_order(square, True), "rnd": lambda: reshape.random_order(spark, 30, 5), "rcm": lambda: reshape.rcm_order(square)}[order]()
    assert reshape.permutation_check(perm, 30).first().valid
    moved = reshape.permute(square, perm, perm)
    place = {r.old: r.new for r in perm.collect()}
    d, e = dense(square), dense(moved)
    assert all(d[i, j] == e[place[i], place[j]] for i in range(30) for j in range(30))


def test_rcm_of_a_path(spark):
    edges = [(0, 2), (2, 4), (4, 1), (1, 3)]
    a = matrices.from_points(spark, edges + [(j, i) for i, j in edges])
    assert {r.old: r.new for r in reshape.rcm_order(a, reverse=False).collect()} == {0: 0, 2: 1, 4: 2, 1: 3, 3: 4}


def cuthill_mckee(n, edges):
    """By its definition: from the unvisited row of least degree and id, level by level, rows by their first parent, then degree, then id."""
    degree, near = [0] * n, [set() for _ in range(n)]
    for i, j in edges:
        degree[i] += 1
        if i != j:
            near[i].add(j)
            near[j].add(i)
    order, seen = [], set()
    for start in sorted(range(n), key=lambda k: (degree[k], k)):
        level = [] if start in seen else [start]
        seen.update(level)
        while level:
            order += level
            first = {}
            for parent in level:
                for k in near[parent] - seen:
                    first.setdefault(k, level.index(parent))
            level = sorted(first, key=lambda k: (first[k], degree[k], k))
            seen.update(level)
    return {old: new for new, old in enumerate(order)}


def test_rcm_of_many_components(spark):
    """A disconnected pattern, larger than the test matrix, that isn't symmetric and has loops, hubs and isolated rows."""
    rng = np.random.default_rng(11)
    edges = [*((int(a), int(b)) for a, b in rng.integers(0, 60, (70, 2))), *((60 + k, 61 + k) for k in range(5)), *((80, 80 + k) for k in range(1, 15)), (100, 100), (110, 111)]
    a = matrices.from_points(spark, edges)
    a = SparseMatrix(a.df, 130, 130)
    assert {r.old: r.new for r in reshape.rcm_order(a, reverse=False).collect()} == cuthill_mckee(130, edges)
    paths = lambda many: SparseMatrix(matrices.from_points(spark, [(10 * c + k, 10 * c + k + 1) for c in range(many) for k in range(2)]).df, 10 * many, 10 * many)
    jobs = [jobs_of(spark, lambda m=m: reshape.rcm_order(paths(m)).count())[1] for m in (1, 12)]
    assert jobs[1] <= jobs[0] + 6


def test_rcm_reads_its_matrix_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    df = spark.range(50).selectExpr("id i", "(id * 7) % 50 j", "1L v").mapInArrow(counted, "i long, j long, v long")
    assert reshape.rcm_order(SparseMatrix(df, 50, 50)).count() == 50 and rows.value == 50


def test_permute_with_a_map_that_lacks_ids(spark, square):
    part = reshape.natural_order(spark, 30).filter("old != 7")
    with pytest.raises(Exception, match="lacks id 7"):
        reshape.permute(square, part).df.collect()
    assert reshape.permute(square, reshape.natural_order(spark, 40)).nnz() == square.nnz()


@pytest.mark.parametrize("parts", [1, 2, 7, 600])
def test_functions_for_sql(spark, parts):
    """The same parts as part_of, also of no width; no Python in the plan."""
    cuts = [0, *sorted(np.random.default_rng(parts).integers(0, 1000, parts - 1).tolist()), 1000]
    register(spark, "some_part", cuts)
    got = spark.sql("SELECT id, some_part(id) p, lo, hi FROM range(1000) JOIN some_part_cuts() c ON c.k = some_part(id)")
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    want = {r.id: r.p for r in spark.range(1000).select("id", part_of("id", cuts).alias("p")).collect()}
    rows = got.collect()
    assert {r.id: r.p for r in rows} == want and all(r.lo <= r.id < r.hi for r in rows) and len(rows) == 1000


def test_sample_depends_on_the_seed_alone(square):
    one, two = sample.sparsify(square, 0.4, 1), sample.sparsify(square, 0.4, 1)
    assert reshape.same_matrix(one, two) and 0 < one.nnz() < square.nnz()
    assert sample.keep_probability(1000, 8, 8, 0.5) == 0.5 and sample.keep_probability(1000, 8, 8, 1) == 1 and sample.keep_probability(10**6, 8, 8, 10) == 6400 / 10**6


@pytest.mark.parametrize("name", ["uni", "nic", "nic_v", "rac", "pbi", "pal", "opal"])
@pytest.mark.parametrize("parts", [1, 3, 8])
def test_partitioners_give_valid_cuts(square, name, parts):
    p, q = registry.get(name)(square, parts, 0, 0, 1)
    assert is_cut_vector(p, 30) and is_cut_vector(q, 30) and len(p) == parts + 1


def test_exact_is_a_lower_bound(spark):
    a = matrices.from_points(spark, [*random_points(8, 8, 40, 5), (7, 7)])
    p, q = exact.exact(a, 3)
    least = loads.max_load(a, p, q)
    for name in ("uni", "rac", "pbi", "pal", "opal"):
        assert loads.max_load(a, *registry.get(name)(a, 3, 0, 0, 1)) >= least
    r, c = exact.exact(a, 3, 2, symmetric=False)
    assert loads.max_load(a, r, c) <= loads.max_load(a, *twod.nic(a, 3, 2))


@pytest.mark.parametrize(("n", "m", "p", "q", "real"), [(7, 9, 3, 2, False), (6, 6, 2, 3, False), (9, 5, 3, 3, True), (5, 5, 1, 4, False)])
def test_exact_rectangular(spark, n, m, p, q, real):
    """The first of all lightest pairs of cuts, by trying them all."""
    rng = np.random.default_rng(n * m)
    d = rng.integers(0, 9, (n, m)) * (rng.random((n, m)) < 0.6) + (0.25 * rng.integers(0, 4, (n, m)) if real else 0)
    a = matrices.from_dense(spark, d.tolist(), weighted=True)
    a = SparseMatrix(a.df, n, m, True)
    cuts = lambda size, parts: ([0, *x, size] for x in combinations_with_replacement(range(size + 1), parts - 1))
    want = min((grid(d, x, y).max(), x, y) for x in cuts(n, p) for y in cuts(m, q))
    got = exact.exact(a, p, q, symmetric=False)
    assert got == tuple(want[1:]) and loads.max_load(a, *got) == want[0]


@pytest.mark.parametrize(("n", "p", "kind"), [(9, 3, "whole"), (7, 4, "real"), (6, 3, "below 0"), (5, 1, "whole"), (4, 6, "whole"), (6, 2, "none")])
def test_exact_symmetric(spark, n, p, kind):
    """The first of all lightest cuts, by trying them all; with real loads, loads below 0, no loads, and more parts than rows."""
    rng = np.random.default_rng(n * p)
    d = rng.integers(-5 if kind == "below 0" else 0, 9, (n, n)) * (rng.random((n, n)) < (0 if kind == "none" else 0.5)) * (0.25 if kind == "real" else 1)
    a = matrices.from_dense(spark, d.tolist(), weighted=True)
    a = SparseMatrix(a.df, n, n, True)
    cuts = ([0, *x, n] for x in combinations_with_replacement(range(n + 1), p - 1))
    assert exact.exact(a, p)[0] == min((grid(d, x, x).max(), x) for x in cuts)[1]


def test_exact_symmetric_of_sixty_rows(spark, monkeypatch):
    """Of 60 x 60 in 5 parts, the first of 595,665 cuts; of 150 x 150, with 22 million, few are looked at, in small blocks as well."""
    a = matrices.from_points(spark, random_points(60, 60, 900, 7))
    a = SparseMatrix(a.df, 60, 60)
    table = np.zeros((61, 61), int)
    table[1:, 1:] = dense(a).astype(int).cumsum(0).cumsum(1)
    cuts = np.array([[0, *x, 60] for x in combinations_with_replacement(range(61), 4)])
    load = np.concatenate([exact.tiles(table, x, x) for x in np.array_split(cuts, 20)])
    assert exact.exact(a, 5) == (cuts[load.argmin()].tolist(),) * 2

    points = np.array(random_points(150, 150, 3000, 8))
    table = np.zeros((151, 151), int)
    np.add.at(table, (points[:, 0] + 1, points[:, 1] + 1), 1)
    table = table.cumsum(0).cumsum(1)
    a = SparseMatrix(matrices.from_points(spark, [tuple(x) for x in points.tolist()]).df, 150, 150)
    p, looked = np.zeros((1, 1), int), 0
    top = loads.max_load(a, twod.pal(a, 5), twod.pal(a, 5))
    for _ in range(5):
        p = np.concatenate([exact.continued(table, x, 5, top) for x in np.array_split(p, max(1, len(p) // 500))])
        looked += len(p)
    best = exact.tiles(table, p, p)
    assert looked < 2_200_000 and best.min() <= top
    monkeypatch.setattr(exact, "AT_A_TIME", 20_000)
    assert exact.exact(a, 5)[0] == p[best.argmin()].tolist()


def test_exact_of_sixty_rows(spark):
    """635,376 row cuts of a 60 x 60 matrix, in 5 x 5 parts: as light as brute force over the rows with optimal columns says for a coarser grid, and no heavier than an alternation."""
    a = matrices.from_points(spark, random_points(60, 60, 900, 7))
    a = SparseMatrix(a.df, 60, 60)
    p, q = exact.exact(a, 5, 5, symmetric=False)
    assert is_cut_vector(p, 60) and is_cut_vector(q, 60)
    best, d = loads.max_load(a, p, q), dense(a).astype(int)
    assert best <= loads.max_load(a, *twod.nic(a, 5, 5))
    coarse = [[0, *(6 * k for k in x), 60] for x in combinations(range(1, 10), 4)]
    prefix = lambda x: np.concatenate([np.zeros((5, 1), int), np.cumsum([d[s:e].sum(0) for s, e in zip(x, x[1:])], 1)], 1)
    assert all(oned.bottleneck(oned.as_prefixes(prefix(x)), 5) >= best for x in coarse) and oned.bottleneck(oned.as_prefixes(prefix(p)), 5) == best


def test_bounded_loads(square):
    z = 200
    for f in (twod.uniform_under, twod.rac_under, twod.pal_under):
        cuts, ok = f(square, z)
        assert ok and is_cut_vector(cuts, 30)
    cuts = twod.pal_under(square, z)[0]
    assert loads.max_load(square, cuts, cuts) <= z
    assert twod.pal_under(square, 0.5)[1] is False


@pytest.mark.parametrize(("blocks", "cells"), [(65_536, 1_000_000), (7, 20), (1, 1)])
def test_diagonal_backends_agree(spark, square, blocks, cells, monkeypatch):
    monkeypatch.setattr(twod, "BLOCKS", blocks)
    monkeypatch.setattr(twod, "STRIP_CELLS", cells)
    large = matrices.from_points(spark, random_points(400, 400, 1500, 8), [int(x) for x in np.random.default_rng(8).integers(0, 9, 1500)], weighted=True)
    for a, n, bounds in ((square, 30, (45, 150)), (large, large.size, (3, 900, 10**6) if blocks > 7 else (900,))):
        near, far = twod.diagonal(a), twod.TableDiagonal(twod.diagonal_form(a), n)
        for bound in bounds:
            far.windows, cuts = 0, twod.diagonal_probe(near, bound)
            assert cuts == twod.diagonal_probe(far, bound)
            if blocks > n:  # a window a cut, and as many more as double the bound to the strips' share
                assert far.windows <= sum(3 + int(np.log2(2 * k + 1)) for k in range(len(cuts)))
        far.close()


def test_diagonal_searches_on_tables(square, monkeypatch):
    want = twod.pal(square, 4), twod.opal(square, 3), twod.pal_under(square, 20)
    monkeypatch.setattr(twod, "LOCAL_NONZEROS", 0)
    plans = []
    monkeypatch.setattr(twod.TableDiagonal, "_sums", lambda self, *x, f=twod.TableDiagonal._sums: plans.append(self) or f(self, *x))
    assert (twod.pal(square, 4), twod.opal(square, 3), twod.pal_under(square, 20)) == want and plans


def test_objectives(square):
    o = subgradient.parse("0ij+0jk+0ik")
    assert len(o.axes) == 1 and len(subgradient.parse("0ij").axes) == 2 and len(subgradient.parse("0ij+1jk").axes) == 3
    cuts = [0, 10, 20, 30]
    g = grid(dense(square), cuts, cuts)
    cost = {r.part: r.cost for r in subgradient.evaluate(subgradient.parse("0ij,i=j"), [square], [cuts]).collect()}
    assert all(cost[k] == max(g[k].max(), g[:, k].max()) for k in range(3))
    for bad in ("ij", "0ij,i=q", "0ijk"):
        with pytest.raises(ValueError):
            subgradient.parse(bad)


def test_subgradient_keeps_the_best(square):
    p, q = subgradient.sgo([square], "0ij", [3, 3], max_iter=4)
    assert is_cut_vector(p, 30) and is_cut_vector(q, 30)
    assert is_cut_vector(subgradient.sgo_spmv(square, 3, 1.0, 2.0, max_iter=3), 30)


def test_run_and_command_line(square, tmp_path, capsys, monkeypatch):
    got = engine.run(square, "nic", p=4, prob=0.5, use_data=True)
    assert is_cut_vector(got.p, 30) and "Max load" in got.report()
    user = lambda a, p, q, z, seed: ([0, a.n_rows], [0, a.n_cols])
    assert engine.run(square, user, p=1).p == [0, 30]
    f, out = tmp_path / "x.mtx", tmp_path / "cuts"
    f.write_text("%%MatrixMarket matrix coordinate pattern general\n3 3 3\n1 1\n2 2\n3 3\n")
    monkeypatch.setattr("pyspark.sql.SparkSession.stop", lambda self: None)
    assert cli.main(["--graph", str(f), "--alg", "UNI", "--p", "3", "--res-file", str(out)]) == 0
    assert "Max load: 1" in capsys.readouterr().out and out.read_text() == "3\n0 1 2 3\n"
    assert cli.main(["--list", "--dir", str(tmp_path)]) == 0


def test_api(square):
    x = api.Loads(square)
    p, q = api.nic(square, 3)
    assert x.size() == 30 and x.max_load(p, q) == max(max(r) for r in x.loads(p, q))
    x.close()


def test_bench_loop(spark, tmp_path):
    f = tmp_path / "x.mtx"
    f.write_text("%%MatrixMarket matrix coordinate pattern general\n3 3 3\n1 1\n2 2\n3 3\n")
    config = sinks.bench_configs(spark, ["x.mtx"], ["nat"], ["uni", "nic"], [3], [1.0], [1])
    path = str(tmp_path / "config")
    sinks.write_bench_results(config, path)
    done = engine.bench(spark, sinks.read_bench_config(spark, path), str(tmp_path))
    assert done.count() == 2 and not engine.regressed(done)


def test_bench_command_and_standard_input(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "x.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n3 3 3\n1 1\n2 2\n3 3\n")
    line = "x.mtx\tnat\tuni\t3\t1.0\t1\t{}\t-1\t-1\t-1\n"
    for was, code in ((1.0, 1), (100.0, 0)):  # three parts of one load 1 each have imbalance 3
        monkeypatch.setattr("sys.stdin", io.StringIO("# a comment\n" + line.format(was)))
        assert cli.main(["--bench", "-", "--dir", str(tmp_path), "--bench-out", str(tmp_path / f"out{code}")]) == code
    path = capsys.readouterr().out.split()[0]
    assert spark.read.csv(path, sep="\t", schema=sinks.BENCH_SCHEMA).first().load_imbalance == 3.0
    monkeypatch.setattr("sys.stdin", io.StringIO((tmp_path / "x.mtx").read_text()))
    a = matrices.load_matrix(spark, "-")
    assert (a.n_rows, a.n_cols, a.nnz()) == (3, 3, 3)
    assert cli.main(["--graph", str(tmp_path / "x.mtx"), "--p", "2", "--serialize", str(tmp_path / "tiles")]) == 0
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 3


def test_streaming(spark, square, tmp_path):
    from rectpart.streaming.loads import streaming_tile_loads

    square.loads().withColumnRenamed("w", "v_load").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, j long, v_load long").parquet(str(tmp_path / "in"))
    cuts = [0, 10, 30]
    running = streaming_tile_loads(stream, cuts, cuts).writeStream.format("memory").queryName("tiles").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    g = grid(dense(square), cuts, cuts)
    assert {(r.u, r.v): r.load for r in spark.table("tiles").collect()} == {(u, v): g[u, v] for u in range(2) for v in range(2)}


def decode(prefix, places):
    n = len(prefix) - 1
    return [0, *(int(min(n, x)) for x in np.searchsorted(prefix, places, "left")), n]


def test_marginals_on_the_driver_and_in_a_table_agree(square, monkeypatch):
    near = subgradient.Marginal([square], [(0, 0), (0, 1)], 30, 0.5)
    monkeypatch.setattr(subgradient.oned, "LOCAL_CELLS", 10)
    far = subgradient.Marginal([square], [(0, 0), (0, 1)], 30, 0.5)
    assert near.local and not far.local and near.total == far.total
    for places in ([-1.0, 0.0, 100.5, near.total, near.total + 9], [3.0], []):
        assert near.decode(np.array(places)) == far.decode(np.array(places)) == decode(near.prefix, np.array(places))


def converged(d, kind, parts):
    """The subgradient loop without a bound on its steps, over a dense matrix."""
    r, c = d.sum(1), d.sum(0)
    prefixes = [np.concatenate([[0], np.cumsum(x)]) for x in {"2ds": [r + c], "2dr": [r, c], "3ds": [r + c], "3dr": [r, c + r, c], "spmv": [r + c + 2]}[kind]]
    rng = np.random.Generator(np.random.PCG64(1))
    places = [np.sort(rng.uniform(0, x[-1], p - 1)) for x, p in zip(prefixes, parts)]

    def costs(at):
        cuts = [decode(x, y) for x, y in zip(prefixes, at)]
        g = grid(d, cuts[0], cuts[min(1, len(cuts) - 1)])
        if kind == "2dr":
            return [g.max(1), g.max(0)]
        if kind in ("2ds", "spmv"):
            g = g + (np.add.outer(np.diff(cuts[0]), np.diff(cuts[0])) if kind == "spmv" else 0)
            return [np.maximum(g.max(1), g.max(0))]
        t = g[:, :, None] + g[None] + g[:, None] if kind == "3ds" else g[:, :, None] + grid(d, cuts[1], cuts[2])[None]
        each = [t.max((1, 2)), t.max((0, 2)), t.max((0, 1))]
        return each if kind == "3dr" else [np.maximum.reduce(each)]

    # the loop by its definition: cuts move against the running sum of the excess over the mean, by steps that shrink as 1 / sqrt(100 + turns of all cuts)
    turn, best, found, checked, before = 0, np.inf, None, 1, np.inf
    while True:
        turn += 1
        cost = costs(places)
        top, low = max(c.max() for c in cost), min(c.min() for c in cost)
        if top < best:
            best, found = top, [decode(x, y) for x, y in zip(prefixes, places)]
        moved = []
        for x, c in zip(places, cost):
            excess = np.array([sum(c[: k + 1] - c.mean()) for k in range(len(x))])
            moved.append(np.sort(x - excess / (100 + turn // (len(x) + 2)) ** 0.5))
        places = moved
        if low > 0 and top - low < 0.001 * low:
            return found
        if turn - checked > 10 * sum(p + 1 for p in parts):
            if before - best <= 0.001 * best:
                return found
            checked, before = turn, best


def test_starts_share_their_jobs(spark, square):
    """Three starts: no worse than the first alone, in fewer jobs than three times its own; a candidate's costs are those that it has alone."""
    cost = lambda c: loads.max_load(square, c, c)
    one, jobs = jobs_of(spark, lambda: subgradient.sgo([square], "0ij,i=j", [4], max_iter=12)[0])
    three, more = jobs_of(spark, lambda: subgradient.sgo([square], "0ij,i=j", [4], max_iter=12, starts=3)[0])
    assert cost(three) <= cost(one) and more < 2 * jobs
    assert cost(subgradient.sgo_spmv(square, 3, 1.0, 1.0, max_iter=5, starts=2)) > 0
    o, candidates = subgradient.parse("0ij+1jk"), [[[0, 10, 30], [0, 5, 6, 30], [0, 30]], [[0, 30], [0, 15, 30], [0, 1, 2, 30]]]
    for text, tried in (("0ij+1jk", candidates), ("0ij+0jk+0ik", [[[0, 3, 11, 30]], [[0, 0, 9, 30]]]), ("0ji,i=j", [[[0, 3, 11, 30]]]), ("0ii+1ji", [[[0, 12, 30], [0, 3, 30]]])):
        o = subgradient.parse(text)
        near = subgradient._costs_of_tiles(o, [square, square], tried)
        for r in subgradient.evaluate_many(o, [square, square], tried).collect():
            assert near[r.c][r.dim][r.part] == r.cost
    o = subgradient.parse("0ij+1jk")
    together = sorted((r.c, r.dim, r.part, r.cost) for r in subgradient.evaluate_many(o, [square, square], candidates).collect())
    assert together == sorted((c, r.dim, r.part, r.cost) for c, cuts in enumerate(candidates) for r in subgradient.evaluate(o, [square, square], cuts).collect())


@pytest.mark.parametrize("few", [0, 99])
def test_many_cuts_in_one_pass(square, few, monkeypatch):
    monkeypatch.setattr(loads, "FEW", few)
    rng = np.random.default_rng(5)
    candidates = [([0, *sorted(rng.integers(0, 31, 3).tolist()), 30], [0, *sorted(rng.integers(0, 31, 2).tolist()), 30]) for _ in range(6)] + [([0, 30], [0, 0, 30, 30])]
    d, got = dense(square), {(r.c, r.u, r.v): r.load for r in loads.many_tile_loads(square, candidates).collect()}
    for c, (p, q) in enumerate(candidates):
        assert all(got.get((c, u, v), 0) == x for (u, v), x in np.ndenumerate(grid(d, p, q)))
    assert loads.max_loads(square, candidates) == [grid(d, p, q).max() for p, q in candidates]


def test_fewest_parts_in_few_rounds_and_rac_in_few_jobs(spark, square):
    for best, high in ((1, 1), (1, 40), (7, 9), (333, 1000), (1000, 1000)):
        rounds = []
        assert twod._fewest(1, high, lambda ks, rounds=rounds, best=best: rounds.append(ks) or [k >= best for k in ks]) == best and len(rounds) <= twod.ROUNDS
    cuts, ok = twod.rac_under(square, 300)
    plain = next(k for k in range(1, 31) if loads.max_load(square, *[twod.rac(square, k)] * 2) <= 300)
    assert ok and len(cuts) - 1 == plain
    d = dense(square)
    plain = next(k for k in range(1, 31) if grid(d, twod.uniform(30, k), twod.uniform(30, k)).max() <= 200)
    assert twod.uniform_under(square, 200) == (twod.uniform(30, plain), True)
    assert twod.rac_under(square, 0.5)[1] is False
    _, jobs = jobs_of(spark, lambda: twod.rac(square, 8))
    assert jobs <= 40


def test_refinements_hold_their_nonzeros_by_axis(spark, square, monkeypatch):
    """rac: no saved table where each direction fits on the driver, if not both together; the steps read nonzeros dealt by ranges of the axis, and positions' loads are columns of one row."""
    want = [twod.rac(square, 4), twod.rac(square, 4, nic_ref=True), twod.pbi(square, 4)]
    dealt, old = [], SparseMatrix.dealt
    monkeypatch.setattr(SparseMatrix, "dealt", lambda self, axis: dealt.append(axis) or old(self, axis))
    monkeypatch.setattr(oned, "LOCAL_CELLS", 40)
    monkeypatch.setattr(oned.TablePrefixes, "__init__", None)
    assert [twod.rac(square, 4), twod.rac(square, 4, nic_ref=True)] == want[:2] and len(dealt) == 1
    assert twod.pbi(square, 4) == want[2]
    one = {r.pos: r.load for r in loads.row_max_sums(square, [0, 4, 4, 9, 30, 30]).collect()}
    monkeypatch.setattr(loads, "MOST_SUMS", 0)
    assert one == {r.pos: r.load for r in loads.row_max_sums(square, [0, 4, 4, 9, 30, 30]).collect()}


def test_registered_subgradient_queries_converge(spark):
    sf = "/root/testdata/sf0.001"
    d, made = dense(catalog.nn(spark, sf)), catalog.queries()

    def cuts(name):
        rows = made[name](spark, sf).orderBy("k").collect()
        if name == "sgo_3dr":
            return [[r.spot for r in rows if r.dim == k] for k in range(3)]
        return [[*(r.lo for r in rows if r.dim == x), rows[-1].hi] for x in ("row", "col") if any(r.dim == x for r in rows)]

    for kind, parts in {"2ds": [4], "2dr": [4, 4], "3ds": [4], "3dr": [3, 3, 3], "spmv": [4]}.items():
        assert cuts(f"sgo_{kind}") == converged(d, kind, parts), kind
    polished = converged(d, "2dr", [4, 4])
    assert cuts("sgo_2dr_nic") == list(map(list, twod.nic(catalog.nn(spark, sf), 4, 4, start=polished[0])))
    best = min(grid(d, c, c).max() for c in ([0, *x, 25] for x in combinations(range(1, 25), 3)))
    assert grid(d, *cuts("sgo_2ds") * 2).max() <= 1.05 * best


@pytest.mark.parametrize("seed", range(2))
def test_grid_search_takes_few_jobs(spark, monkeypatch, seed):
    """Cuts as of the probes on the driver, also with few marks and heavy nonzeros; jobs far fewer than probes have cuts."""
    rng, n = np.random.default_rng(seed), 300
    cells = [(int(i), int(j), int(w)) for i, j, w in zip(rng.integers(0, n, 6000) ** (1 + seed % 2) % n, rng.integers(0, n, 6000), rng.integers(0, 5, 6000) ** 3, strict=True)]
    a = SparseMatrix(spark.createDataFrame(cells, "i long, j long, v long").coalesce(2), n, n, True)
    want = twod.pal(a, 6), twod.opal(a, 5)
    monkeypatch.setattr(twod, "LOCAL_NONZEROS", 0)
    monkeypatch.setattr(twod, "EVEN_MARKS", 16)
    monkeypatch.setattr(twod, "NEW_MARKS", 48)
    made, mark = [], twod.GridSearch._mark
    monkeypatch.setattr(twod.GridSearch, "_mark", lambda self, at: made.append(len(at)) or mark(self, at))
    assert (twod.pal(a, 6), twod.opal(a, 5)) == want and 2 <= len(made) < 80
