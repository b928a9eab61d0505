"""Registered queries over the test tables, and the same rows in SQL for DuckDB.

Matrices: SP = lineitem's suppliers x parts with quantities as weights; PP = parts that follow each other in an order, square; NN = customer nation x
supplier nation of each lineitem; UE = users x hours of events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectpart.functions.parts import part_of, register
from rectpart.model import SparseMatrix, cuts_frame
from rectpart.operators import exact as X
from rectpart.operators import loads as L
from rectpart.operators import oned as D
from rectpart.operators import reshape as R
from rectpart.operators import sample as P
from rectpart.operators import subgradient as S
from rectpart.operators import twod as T
from rectpart.plans import partition_sql as Q

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- matrices ---------------------------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _size(df: DataFrame, column: str) -> int:
    """Largest key + 1, from the file's statistics or one column."""
    return (df.agg(F.max(column).alias("m")).first().m or 0) + 1


def sp(spark: SparkSession, sf: str, weighted: bool = False) -> SparseMatrix:
    line = _table(spark, sf, "lineitem")
    coo = line.select(F.col("l_suppkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("j"), F.col("l_quantity").cast("long").alias("v"))
    return SparseMatrix(coo, _size(_table(spark, sf, "supplier"), "s_suppkey"), _size(_table(spark, sf, "part"), "p_partkey"), weighted)


def pp(spark: SparkSession, sf: str) -> SparseMatrix:
    line = _table(spark, sf, "lineitem")
    one = line.select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").cast("long").alias("i"))
    two = line.select("l_orderkey", (F.col("l_linenumber") - 1).cast("long").alias("n"), F.col("l_partkey").cast("long").alias("j"))
    n = _size(_table(spark, sf, "part"), "p_partkey")
    return SparseMatrix(one.join(two, ["l_orderkey", "n"]).select("i", "j", F.lit(1).cast("long").alias("v")), n, n)


def nn(spark: SparkSession, sf: str) -> SparseMatrix:
    line, orders = _table(spark, sf, "lineitem"), _table(spark, sf, "orders")
    customer, supplier = _table(spark, sf, "customer"), _table(spark, sf, "supplier")
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    coo = rows.groupBy(F.col("c_nationkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(F.count("*").alias("v"))
    n = _size(_table(spark, sf, "nation"), "n_nationkey")
    return SparseMatrix(coo, n, n, True)


def ue(spark: SparkSession, sf: str) -> SparseMatrix:
    events = _table(spark, sf, "events")
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600)
    coo = events.select(F.col("user_id").cast("long").alias("i"), hour.cast("long").alias("j"), F.lit(1).cast("long").alias("v"))
    return SparseMatrix(coo, _size(events, "user_id"), 744)


_SP = """sp AS (SELECT CAST(l_suppkey AS BIGINT) i, CAST(l_partkey AS BIGINT) j, CAST(l_quantity AS BIGINT) v FROM lineitem),
size AS (SELECT (SELECT max(s_suppkey) + 1 FROM supplier) n, (SELECT max(p_partkey) + 1 FROM part) m)"""
_PP = """pp AS (SELECT CAST(a.l_partkey AS BIGINT) i, CAST(b.l_partkey AS BIGINT) j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber),
size AS (SELECT max(p_partkey) + 1 n FROM part)"""
_NN = """nn AS (SELECT CAST(c_nationkey AS BIGINT) i, CAST(s_nationkey AS BIGINT) j, count(*) v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
size AS (SELECT max(n_nationkey) + 1 n FROM nation)"""


def _parts(name: str, size: str, k: int) -> str:
    """SQL for uniform parts of a dimension."""
    return f"{name} AS (SELECT CAST(r AS INTEGER) k, r * {size} // {k} lo, (r + 1) * {size} // {k} hi FROM range({k}) t(r), size)"


def _tiles(matrix: str, p: int, q: int, n: str = "n", m: str = "m", w: str = "1") -> str:
    return f"""{_parts("p", n, p)}, {_parts("q", m, q)},
tiles AS (SELECT p.k u, q.k v, CAST(coalesce(t.load, 0) AS BIGINT) load FROM p CROSS JOIN q LEFT JOIN
 (SELECT p.k a, q.k b, sum({w}) load FROM {matrix} x JOIN p ON x.i >= p.lo AND x.i < p.hi JOIN q ON x.j >= q.lo AND x.j < q.hi GROUP BY 1, 2) t ON t.a = p.k AND t.b = q.k)"""


_SP_TILES = f"WITH {_SP}, {_tiles('sp', 8, 8)}"
_SP_WEIGHTED = f"WITH {_SP}, {_tiles('sp', 8, 8, w='x.v')}"
_NN_TILES = f"WITH {_NN}, {_tiles('nn', 5, 5, 'n', 'n', 'x.v')}"
_PP_TILES = f"WITH {_PP}, {_tiles('pp', 6, 6, 'n', 'n')}"


def _uniform(a: SparseMatrix, p: int, q: int) -> tuple[list[int], list[int]]:
    return T.uniform(a.n_rows, p), T.uniform(a.n_cols, q)


def _tile_table(a: SparseMatrix, p: int, q: int) -> DataFrame:
    return L.tile_loads(a, *_uniform(a, p, q))


# --- loads ------------------------------------------------------------------------------------------------------------


@query("total_load", f"WITH {_SP} SELECT count(*) nnz, CAST(sum(v) AS BIGINT) total_load FROM sp")
def total_load(spark, sf):
    return sp(spark, sf, True).loads().agg(F.count("*").alias("nnz"), F.sum("w").alias("total_load"))


@query("tile_loads_uniform", f"{_SP_TILES} SELECT u, v, load FROM tiles")
def tile_loads_uniform(spark, sf):
    return _tile_table(sp(spark, sf), 8, 8)


@query("tile_loads_weighted", f"{_SP_WEIGHTED} SELECT u, v, load FROM tiles")
def tile_loads_weighted(spark, sf):
    return _tile_table(sp(spark, sf, True), 8, 8)


_UNEVEN_SQL = f"""WITH {_NN}, p AS (SELECT * FROM (VALUES (0, 0, 3), (1, 3, 3), (2, 3, 10), (3, 10, 25)) t(k, lo, hi)),
tiles AS (SELECT a.k u, b.k v, CAST(coalesce((SELECT sum(x.v) FROM nn x WHERE x.i >= a.lo AND x.i < a.hi AND x.j >= b.lo AND x.j < b.hi), 0) AS BIGINT) load FROM p a CROSS JOIN p b)
SELECT u, v, load FROM tiles"""


@query("tile_loads_uneven", _UNEVEN_SQL)
def tile_loads_uneven(spark, sf):
    return L.tile_loads(nn(spark, sf), [0, 3, 3, 10, 25], [0, 3, 3, 10, 25])


@query("max_load", f"{_SP_TILES} SELECT max(load) max_load FROM tiles")
def max_load(spark, sf):
    return _tile_table(sp(spark, sf), 8, 8).agg(F.max("load").alias("max_load"))


@query("max_load_of_strip", f"{_SP_TILES} SELECT max(load) max_load FROM tiles WHERE v = 3")
def max_load_of_strip(spark, sf):
    return L.max_load_of_strip(_tile_table(sp(spark, sf), 8, 8), 3, column=True)


@query("argmax_tile", f"{_SP_TILES} SELECT u, v, load FROM tiles ORDER BY load DESC, u, v LIMIT 1")
def argmax_tile(spark, sf):
    return L.heaviest_tile(_tile_table(sp(spark, sf), 8, 8))


@query("strip_max_symmetric", f"{_NN_TILES} SELECT k, max(load) max_load FROM (SELECT u k, load FROM tiles UNION ALL SELECT v, load FROM tiles) GROUP BY 1")
def strip_max_symmetric(spark, sf):
    return L.strip_max_symmetric(_tile_table(nn(spark, sf), 5, 5))


@query("row_col_max", f"{_SP_TILES} SELECT 'row' dim, u k, max(load) max_load FROM tiles GROUP BY u UNION ALL SELECT 'col', v, max(load) FROM tiles GROUP BY v")
def row_col_max(spark, sf):
    return L.strip_max(_tile_table(sp(spark, sf), 8, 8))


@query("row_col_max_grouping_sets", f"{_SP_TILES} SELECT u, v, max(load) max_load FROM tiles GROUP BY GROUPING SETS ((u), (v), ())")
def row_col_max_grouping_sets(spark, sf):
    tiles = _tile_table(sp(spark, sf), 8, 8)
    return tiles.groupingSets([["u"], ["v"], []], "u", "v").agg(F.max("load").alias("max_load"))


@query("tri_load", f"{_NN_TILES} SELECT max(a.load + b.load + c.load) max_tri_load FROM tiles a JOIN tiles b ON a.v = b.u JOIN tiles c ON c.u = a.u AND c.v = b.v")
def tri_load(spark, sf):
    return L.max_tri_load(_tile_table(nn(spark, sf), 5, 5))


@query("load_imbalance", f"""WITH {_SP}, {_tiles('sp', 8, 8, w='x.v')}, s AS (SELECT count(*) nnz, CAST(sum(v) AS BIGINT) total_load FROM sp)
SELECT max(load) max_load, nnz, total_load, max(load) * 64.0::DOUBLE / nnz imbalance_nnz, max(load) * 64.0::DOUBLE / total_load imbalance FROM tiles, s GROUP BY nnz, total_load""")
def load_imbalance(spark, sf):
    a = sp(spark, sf, True)
    return L.balance(a, *_uniform(a, 8, 8))


@query("row_degree", f"WITH {_SP} SELECT r id, CAST(coalesce(d, 0) AS BIGINT) degree FROM size, range(n) t(r) LEFT JOIN (SELECT i, count(*) d FROM sp GROUP BY 1) ON i = r")
def row_degree(spark, sf):
    return L.degrees(sp(spark, sf))


@query("marginal_prefix", f"""WITH {_SP}, d AS (SELECT r id, CAST(coalesce(d, 0) AS BIGINT) degree FROM size, range(n) t(r) LEFT JOIN (SELECT i, count(*) d FROM sp GROUP BY 1) ON i = r)
SELECT id, degree, CAST(sum(degree) OVER (ORDER BY id) AS BIGINT) prefix FROM d""")
def marginal_prefix(spark, sf):
    return L.marginal_prefix(sp(spark, sf)).select("id", "degree", "prefix")


_STRIPES = f"""WITH {_SP}, {_parts('q', 'm', 4)}, s AS (SELECT q.k q, i pos, CAST(sum(v) AS BIGINT) load FROM sp JOIN q ON j >= lo AND j < hi GROUP BY 1, 2)"""


@query("stripe_prefix", f"{_STRIPES} SELECT q, pos, load, CAST(sum(load) OVER (PARTITION BY q ORDER BY pos) AS BIGINT) prefix FROM s")
def stripe_prefix(spark, sf):
    a = sp(spark, sf, True)
    return L.stripe_prefix(a, T.uniform(a.n_cols, 4)).select("q", "pos", "load", "prefix")


@query("row_max_prefix", f"{_STRIPES}, m AS (SELECT pos, max(load) load FROM s GROUP BY 1) SELECT pos, load, CAST(sum(load) OVER (ORDER BY pos) AS BIGINT) prefix FROM m")
def row_max_prefix(spark, sf):
    a = sp(spark, sf, True)
    return L.running_sum(L.row_max_sums(a, T.uniform(a.n_cols, 4)), "load", "pos", [], a.n_rows, "prefix").select("pos", "load", "prefix")


_CORNERS = [(3, 50), (10, 200), (57, 999), (0, 10), (100, 2000)]


@query("prefix_query_batch", f"WITH {_SP}, c AS (SELECT * FROM (VALUES {', '.join(f'({r}::BIGINT, {c}::BIGINT)' for r, c in _CORNERS)}) t(r, c)) SELECT r, c, CAST((SELECT coalesce(sum(v), 0) FROM sp WHERE i < r AND j < c) AS BIGINT) load FROM c")
def prefix_query_batch(spark, sf):
    return L.prefix_query(sp(spark, sf, True), _CORNERS)


@query("rectangle_query", f"WITH {_SP} SELECT CAST(coalesce(sum(v), 0) AS BIGINT) load FROM sp WHERE i BETWEEN 1 AND 7 AND j BETWEEN 9 AND 149")
def rectangle_query(spark, sf):
    return L.rectangle_query(sp(spark, sf, True), (2, 10), (8, 150))


_BOXES = """SELECT o_custkey, CAST(min(l_suppkey) + 1 AS BIGINT) r1, CAST(min(l_partkey) + 1 AS BIGINT) c1, CAST(max(l_suppkey) + 1 AS BIGINT) r2, CAST(max(l_partkey) + 1 AS BIGINT) c2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey"""


@query("rectangle_table", f"WITH {_SP}, b AS ({_BOXES}) SELECT o_custkey, r1, c1, r2, c2, CAST(sum(v) AS BIGINT) load FROM b JOIN sp ON i BETWEEN r1 - 1 AND r2 - 1 AND j BETWEEN c1 - 1 AND c2 - 1 GROUP BY ALL")
def rectangle_table(spark, sf):
    """Of each customer, the load of the suppliers and parts between the first and the last of theirs."""
    bought = _table(spark, sf, "lineitem").join(_table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    side = lambda f, column: (f(column) + 1).cast("long")
    boxes = bought.groupBy("o_custkey").agg(side(F.min, "l_suppkey").alias("r1"), side(F.min, "l_partkey").alias("c1"), side(F.max, "l_suppkey").alias("r2"), side(F.max, "l_partkey").alias("c2"))
    return L.rectangle_loads(sp(spark, sf, True), boxes)


@query("prefix_corner_loads", f"{_SP_TILES} SELECT a.u, a.v, CAST(sum(b.load) AS BIGINT) prefix FROM tiles a JOIN tiles b ON b.u <= a.u AND b.v <= a.v GROUP BY 1, 2")
def prefix_corner_loads(spark, sf):
    return L.corner_prefix_loads(_tile_table(sp(spark, sf), 8, 8))


@query("loads_from_corners", f"{_SP_TILES} SELECT u, v, load FROM tiles")
def loads_from_corners(spark, sf):
    return L.loads_from_corners(L.corner_prefix_loads(_tile_table(sp(spark, sf), 8, 8)))


@query("block_local_ids", f"WITH {_SP}, {_parts('p', 'n', 4)}, {_parts('q', 'm', 4)} SELECT p.k u, q.k v, i - p.lo i, j - q.lo j, v w FROM (SELECT i, j, v FROM sp) s JOIN p ON i >= p.lo AND i < p.hi JOIN q ON j >= q.lo AND j < q.hi".replace("v w FROM (SELECT i, j, v FROM sp)", "s.v w FROM (SELECT i, j, v FROM sp)"))
def block_local_ids(spark, sf):
    a = sp(spark, sf, True)
    return L.block_coordinates(a, *_uniform(a, 4, 4))


@query("geometric_mean", "SELECT round(exp(avg(ln(l_quantity))), 6) geomean FROM lineitem")
def geometric_mean(spark, sf):
    """Of the whole column; rounded, as sums of doubles differ in their last digits with the order."""
    return L.geometric_mean(_table(spark, sf, "lineitem"), "l_quantity").select(F.round("geomean", 6).alias("geomean"))


@query("geometric_mean_column")
def geometric_mean_column(spark, sf):
    """The same with all digits."""
    return L.geometric_mean(_table(spark, sf, "lineitem"), "l_quantity")


@query("user_hour_loads", """WITH x AS (SELECT CAST(user_id AS BIGINT) i, CAST(date_diff('hour', TIMESTAMP '2024-01-01', CAST(ts AS TIMESTAMP)) AS BIGINT) j FROM events), size AS (SELECT (SELECT max(user_id) + 1 FROM events) n, 744 m),
""" + _tiles("x", 4, 31) + " SELECT u, v, load FROM tiles")
def user_hour_loads(spark, sf):
    return _tile_table(ue(spark, sf), 4, 31)


# --- cuts, reshaping, samples -----------------------------------------------------------------------------------------


@query("uniform_cuts", f"WITH size AS (SELECT max(p_partkey) + 1 n FROM part), {_parts('p', 'n', 7)} SELECT 'row' dim, k, CAST(lo AS BIGINT) lo, CAST(hi AS BIGINT) hi FROM p")
def uniform_cuts(spark, sf):
    return cuts_frame(spark, T.uniform(_size(_table(spark, sf, "part"), "p_partkey"), 7))


@query("part_of_id", f"WITH {_SP}, {_parts('q', 'm', 300)} SELECT k part, count(*) n FROM sp JOIN q ON j >= lo AND j < hi GROUP BY 1")
def part_of_id(spark, sf):
    a = sp(spark, sf)
    return a.df.groupBy(part_of("j", T.uniform(a.n_cols, 300)).alias("part")).agg(F.count("*").alias("n"))


@query("part_of_in_sql", f"WITH {_SP}, {_parts('q', 'm', 300)} SELECT k part, lo, hi, CAST(sum(v) AS BIGINT) load FROM sp JOIN q ON j >= lo AND j < hi GROUP BY ALL")
def part_of_in_sql(spark, sf):
    """Loads of 300 parts of the columns in SQL, by the functions that are registered for cuts."""
    a = sp(spark, sf, True)
    register(spark, "column_part", T.uniform(a.n_cols, 300))
    loads = spark.sql("SELECT column_part(j) k, sum(w) load FROM {a} GROUP BY 1", a=a.loads())
    return spark.sql("SELECT c.k part, lo, hi, load FROM {loads} l JOIN column_part_cuts() c ON c.k = l.k", loads=loads)


@query("cut_validity", f"WITH size AS (SELECT max(p_partkey) + 1 n FROM part), {_parts('p', 'n', 7)} SELECT min(lo) = 0 AND max(hi) = (SELECT n FROM size) AND bool_and(lo <= hi) valid FROM p")
def cut_validity(spark, sf):
    n = _size(_table(spark, sf, "part"), "p_partkey")
    return cuts_frame(spark, T.uniform(n, 7)).agg(((F.min("lo") == 0) & (F.max("hi") == n) & F.bool_and(F.col("lo") <= F.col("hi"))).alias("valid"))


@query("transpose", f"WITH {_SP} SELECT j i, i j, v FROM sp")
def transpose(spark, sf):
    return R.transpose(sp(spark, sf)).df


@query("sorted_coordinates", f"WITH {_SP} SELECT i, j, v FROM sp ORDER BY i, j")
def sorted_coordinates(spark, sf):
    return R.sorted_coordinates(sp(spark, sf))


@query("upper_triangle", f"WITH {_PP} SELECT i, j FROM pp WHERE j > i")
def upper_triangle(spark, sf):
    return R.upper_triangle(pp(spark, sf)).df.select("i", "j")


_DEGREES = f"WITH {_PP}, d AS (SELECT r id, coalesce(d, 0) degree FROM size, range(n) t(r) LEFT JOIN (SELECT i, count(*) d FROM pp GROUP BY 1) ON i = r)"


@query("order_asc", f"{_DEGREES} SELECT id AS old, row_number() OVER (ORDER BY degree, id) - 1 AS new FROM d")
def order_asc(spark, sf):
    return R.degree_order(pp(spark, sf))


@query("order_desc", f"{_DEGREES} SELECT id AS old, row_number() OVER (ORDER BY degree DESC, id) - 1 AS new FROM d")
def order_desc(spark, sf):
    return R.degree_order(pp(spark, sf), True)


_MAP = f"{_DEGREES}, m AS (SELECT id, row_number() OVER (ORDER BY degree, id) - 1 AS k FROM d)"


@query("reorder_asc", f"{_MAP} SELECT a.k i, b.k j FROM pp JOIN m a ON i = a.id JOIN m b ON j = b.id")
def reorder_asc(spark, sf):
    return R.reorder(pp(spark, sf), "asc").df.select("i", "j")


@query("permute_rows", f"{_MAP} SELECT a.k i, j FROM pp JOIN m a ON i = a.id")
def permute_rows(spark, sf):
    a = pp(spark, sf)
    return R.permute(a, rows=R.degree_order(a)).df.select("i", "j")


@query("permute_cols", f"{_MAP} SELECT i, b.id j FROM pp JOIN m b ON j = b.k")
def permute_cols(spark, sf):
    a = pp(spark, sf)
    return R.permute(a, cols=R.degree_order(a), cols_new_to_old=True).df.select("i", "j")


@query("inverse_permutation", f"{_MAP} SELECT k AS old, id AS new FROM m")
def inverse_permutation(spark, sf):
    return R.inverse(R.degree_order(pp(spark, sf)))


@query("permutation_check", f"{_MAP} SELECT count(DISTINCT k) = (SELECT n FROM size) AND min(k) = 0 AND max(k) = (SELECT n FROM size) - 1 valid FROM m")
def permutation_check(spark, sf):
    a = pp(spark, sf)
    return R.permutation_check(R.degree_order(a), a.n_rows)


@query("natural_order", "SELECT r AS old, r AS new FROM (SELECT max(p_partkey) + 1 n FROM part), range(n) t(r)")
def natural_order(spark, sf):
    return R.natural_order(spark, _size(_table(spark, sf, "part"), "p_partkey"))


@query("random_order", """SELECT r AS old, row_number() OVER (ORDER BY h, r) - 1 AS new FROM (SELECT r, CAST('0x' || substring(md5(r || ':1'), 1, 15) AS BIGINT) h FROM (SELECT max(p_partkey) + 1 n FROM part), range(n) t(r))""")
def random_order(spark, sf):
    return R.random_order(spark, _size(_table(spark, sf, "part"), "p_partkey"))


@query("rcm_order")
def rcm_order(spark, sf):
    return R.rcm_order(pp(spark, sf))


@query("coordinate_compress", f"WITH {_PP}, u AS (SELECT DISTINCT i AS old FROM (SELECT i FROM pp UNION ALL SELECT 0)) SELECT old, row_number() OVER (ORDER BY old) - 1 AS new FROM u")
def coordinate_compress(spark, sf):
    return R.compress(pp(spark, sf).df, "i")


@query("csr_rows", f"WITH {_PP} SELECT r i, array_to_string(coalesce(l, []), ' ') cols FROM size, range(n) t(r) LEFT JOIN (SELECT i, list(j ORDER BY j) l FROM pp GROUP BY 1) ON i = r")
def csr_rows(spark, sf):
    return R.csr_rows(pp(spark, sf)).select("i", F.array_join(F.col("cols").cast("array<string>"), " ").alias("cols"))


@query("adjacency_lines", f"WITH {_PP} SELECT r i, r || ' :' || CASE WHEN l IS NULL THEN '' ELSE ' ' || array_to_string(l, ' ') END line FROM size, range(n) t(r) LEFT JOIN (SELECT i, list(j ORDER BY j) l FROM pp GROUP BY 1) ON i = r")
def adjacency_lines(spark, sf):
    return R.adjacency_lines(pp(spark, sf))


@query("matrix_check", f"WITH {_SP} SELECT bool_and(i >= 0 AND i < n AND j >= 0 AND j < m) valid FROM sp, size")
def matrix_check(spark, sf):
    return R.matrix_check(sp(spark, sf))


_TWICE = "(SELECT count(*) FROM (SELECT i, j, v FROM nn EXCEPT ALL SELECT {0}, v FROM nn)) + (SELECT count(*) FROM (SELECT {0}, v FROM nn EXCEPT ALL SELECT i, j, v FROM nn)) = 0"


@query("matrix_equality", f"WITH {_NN} SELECT {_TWICE.format('i, j')} same_as_itself, {_TWICE.format('j, i')} same_as_transposed")
def matrix_equality(spark, sf):
    a = nn(spark, sf)
    return spark.createDataFrame([(R.same_matrix(a, R.transpose(R.transpose(a))), R.same_matrix(a, R.transpose(a)))], "same_as_itself boolean, same_as_transposed boolean")


@query("hash_sparsify", f"WITH {_SP} SELECT i, j, v FROM sp WHERE (i * 2654435761 + j * 40503 + 7) % 1000 < 250")
def hash_sparsify(spark, sf):
    return sp(spark, sf).df.filter(P.arithmetic_mask(0.25, 7))


@query("sparsify")
def sparsify(spark, sf):
    return P.sparsify(sp(spark, sf), 0.1, 3).df


@query("keep_probability", f"WITH {_SP}, c AS (SELECT * FROM (VALUES (8::BIGINT, 0.01::DOUBLE), (8, 1.0), (16, 2.5), (32, 100.0)) t(p, prob)) SELECT p, prob, CASE WHEN prob <= 1 THEN prob ELSE least(1.0, p * prob * p * prob / (SELECT count(*) FROM sp)) END keep FROM c")
def keep_probability(spark, sf):
    c = spark.createDataFrame([(8, 0.01), (8, 1.0), (16, 2.5), (32, 100.0)], "p long, prob double")
    n = sp(spark, sf).df.agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(n)).select("p", "prob", P.keep_probability_column(F.col("n"), F.col("p"), F.col("p"), F.col("prob")).alias("keep"))


# --- one-dimensional partitioning -------------------------------------------------------------------------------------

_PREFIX = f"""WITH RECURSIVE {_NN}, d AS (SELECT r i, coalesce(sum(v), 0) w FROM size, range(n) t(r) LEFT JOIN nn ON nn.i = r GROUP BY 1),
x AS (SELECT list_prepend(0::BIGINT, list(CAST(s AS BIGINT) ORDER BY i)) pre FROM (SELECT i, sum(w) OVER (ORDER BY i) s FROM d)),
"""
_BOUND = _PREFIX + """bis(lo, hi, k, pos) AS (
 SELECT greatest((pre[len(pre)] + 4) // 5, 0), pre[len(pre)], 0, 0 FROM x
 UNION ALL
 SELECT CASE WHEN k < 5 THEN lo WHEN pos >= len(pre) - 1 THEN lo ELSE (lo + hi) // 2 + 1 END,
  CASE WHEN k < 5 THEN hi WHEN pos >= len(pre) - 1 THEN (lo + hi) // 2 ELSE hi END,
  CASE WHEN k < 5 THEN k + 1 ELSE 0 END,
  CASE WHEN k < 5 THEN len(list_filter(pre, lambda y: y <= pre[pos + 1] + (lo + hi) // 2)) - 1 ELSE 0 END
 FROM bis, x WHERE lo < hi),
best AS (SELECT min(hi) l FROM bis),
cut(k, spot) AS (SELECT 0, 0::BIGINT UNION ALL SELECT k + 1, len(list_filter(pre, lambda y: y <= pre[spot + 1] + l)) - 1 FROM cut, x, best WHERE k < 5)
"""


def _nn_rows(spark: SparkSession, sf: str) -> D.Prefixes:
    a = nn(spark, sf)
    return D.prefixes_of(L.stripe_sums(a, [0, a.n_cols]), a.n_rows, 1)


def _cut_rows(spark: SparkSession, cuts: list[int], name: str = "spot") -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(int, cuts))), f"k int, {name} long")


@query("oned_partition", f"{_BOUND} SELECT CAST(k AS INTEGER) k, spot FROM cut")
def oned_partition(spark, sf):
    return _cut_rows(spark, D.partition(_nn_rows(spark, sf), 5))


@query("oned_bottleneck", f"{_BOUND} SELECT CAST(l AS BIGINT) bottleneck FROM best")
def oned_bottleneck(spark, sf):
    return spark.createDataFrame([(int(D.bottleneck(_nn_rows(spark, sf), 5)),)], "bottleneck long")


_PROBE = _PREFIX + "cut(k, spot) AS (SELECT 0, 0::BIGINT UNION ALL SELECT k + 1, len(list_filter(pre, lambda y: y <= pre[spot + 1] + pre[len(pre)] // 4)) - 1 FROM cut, x WHERE k < 5)"


@query("oned_probe", f"{_PROBE} SELECT CAST(k AS INTEGER) k, spot FROM cut")
def oned_probe(spark, sf):
    x = _nn_rows(spark, sf)
    return _cut_rows(spark, D.probe(x, int(x.totals()[0]) // 4, 5))


@query("oned_feasible", f"{_PROBE} SELECT max(spot) >= (SELECT n FROM size) feasible FROM cut")
def oned_feasible(spark, sf):
    x = _nn_rows(spark, sf)
    return spark.createDataFrame([(bool(D.feasible(x, 5, int(x.totals()[0]) // 4)),)], "feasible boolean")


_MULTI = f"""WITH RECURSIVE {_NN}, {_parts('q', 'n', 3)}, d AS (SELECT q.k q, r i, coalesce(sum(x.v), 0) w FROM size, range(n) t(r) CROSS JOIN q LEFT JOIN nn x ON x.i = r AND x.j >= q.lo AND x.j < q.hi GROUP BY 1, 2),
x AS (SELECT q, list_prepend(0::BIGINT, list(CAST(s AS BIGINT) ORDER BY i)) pre FROM (SELECT q, i, sum(w) OVER (PARTITION BY q ORDER BY i) s FROM d) GROUP BY q),
all_x AS (SELECT list(pre ORDER BY q) ps, max(pre[len(pre)]) t FROM x),
cut(k, spot) AS (SELECT 0, 0::BIGINT UNION ALL SELECT k + 1, list_min(list_transform(ps, lambda pre: len(list_filter(pre, lambda y: y <= pre[spot + 1] + t // 3)) - 1)) FROM cut, all_x WHERE k < 6)
SELECT CAST(k AS INTEGER) k, spot FROM cut"""


@query("multi_prefix_probe", _MULTI)
def multi_prefix_probe(spark, sf):
    a = nn(spark, sf)
    x = D.prefixes_of(L.stripe_sums(a, T.uniform(a.n_cols, 3)), a.n_rows, 3)
    return _cut_rows(spark, D.probe(x, int(x.totals()[0]) // 3, 6))


_MULTI_SUMS = "sums AS MATERIALIZED (SELECT q.k q, i pos, CAST(sum(v) AS BIGINT) load FROM nn JOIN q ON j >= lo AND j < hi GROUP BY 1, 2)"


@query("multi_prefix_partition", f"WITH RECURSIVE {_NN}, {_parts('q', 'n', 3)}, {_MULTI_SUMS}, {Q.optimal('t', 'sums', 'n', 4)} SELECT CAST(k AS INTEGER) k, spot FROM t")
def multi_prefix_partition(spark, sf):
    a = nn(spark, sf)
    return _cut_rows(spark, D.partition_sums(L.stripe_sums(a, T.uniform(a.n_cols, 3)), a.n_rows, 3, 4, by_value=True))


_PRICES = "prices AS MATERIALIZED (SELECT 0 q, CAST(l_suppkey AS BIGINT) pos, CAST(round(sum(l_extendedprice) * 100) AS BIGINT) load FROM lineitem GROUP BY 2), size AS (SELECT max(s_suppkey) + 1 n FROM supplier)"


@query("oned_real_loads", f"WITH RECURSIVE {_PRICES}, {Q.optimal('t', 'prices', 'n', 6)} SELECT CAST(k AS INTEGER) k, spot FROM t")
def oned_real_loads(spark, sf):
    """Suppliers in 6 parts with even sales: real loads. The SQL counts whole cents."""
    sums = _table(spark, sf, "lineitem").groupBy(F.lit(0).alias("q"), F.col("l_suppkey").cast("long").alias("pos")).agg(F.sum(F.col("l_extendedprice").cast("double")).alias("load"))
    return _cut_rows(spark, D.partition_sums(sums, _size(_table(spark, sf, "supplier"), "s_suppkey"), 1, 6, integral=False))


# --- two-dimensional partitioners -------------------------------------------------------------------------------------

_NN_X = f"{_NN}, x AS MATERIALIZED (SELECT i, j, v w FROM nn)"
_PP_X = f"{_PP}, x AS MATERIALIZED (SELECT i, j, count(*) w FROM pp GROUP BY 1, 2)"
_SP_X = f"{_SP}, x AS MATERIALIZED (SELECT i, j, sum(v) w FROM sp GROUP BY 1, 2)"


def _result(spark: SparkSession, p: list[int], q: list[int] | None = None) -> DataFrame:
    return cuts_frame(spark, p, q)


@query("uniform_bound_a_load", f"""WITH {_NN}, c AS (SELECT CAST(r AS BIGINT) p FROM range(1, 26) t(r)), z AS (SELECT sum(v) // 30 z FROM nn),
tiles AS (SELECT p, list_position(list_transform(range(p), lambda k: ((k + 1) * n // p > i)::INT), 1) u, list_position(list_transform(range(p), lambda k: ((k + 1) * n // p > j)::INT), 1) w, sum(v) load FROM nn, size, c GROUP BY 1, 2, 3)
SELECT min(p) parts FROM (SELECT p, max(load) load FROM tiles GROUP BY 1), z WHERE load <= z""")
def uniform_bound_a_load(spark, sf):
    a = nn(spark, sf)
    cuts, _ = T.uniform_under(a, a.total_load() // 30)
    return spark.createDataFrame([(len(cuts) - 1,)], "parts long")


@query("nic", Q.nic(_SP_X, "SELECT 0 q, i pos, count(*) load FROM sp GROUP BY i", "n", "m", 8))
def nic(spark, sf):
    return _result(spark, *T.nic(sp(spark, sf, True), 8, 8))


@query("nic_v", Q.nic(_NN_X, "SELECT 0 q, i pos, count(*) load FROM nn GROUP BY i", "n", "n", 4))
def nic_v(spark, sf):
    return _result(spark, *T.nic(nn(spark, sf), 4, 4, by_value=True))


@query("rac", Q.rac(_PP_X, 8))
def rac(spark, sf):
    return _result(spark, T.rac(pp(spark, sf), 8))


@query("rac_nic_refinement", Q.rac(_NN_X, 4, full=True))
def rac_nic_refinement(spark, sf):
    return _result(spark, T.rac(nn(spark, sf), 4, nic_ref=True))


@query("pbi", Q.pbi(_NN_X, 4))
def pbi(spark, sf):
    return _result(spark, T.pbi(nn(spark, sf), 4))


@query("rac_bound_a_load", Q.rac_under(_NN_X, "sum(w) // 10", 8))
def rac_bound_a_load(spark, sf):
    a = nn(spark, sf)
    return _result(spark, T.rac_under(a, a.total_load() // 10)[0])


@query("ordered_transform", f"WITH {_PP} SELECT greatest(i, j) k, least(i, j) m, i < j AS \"upper\", count(*) w FROM pp GROUP BY 1, 2, 3")
def ordered_transform(spark, sf):
    return T.diagonal_form(pp(spark, sf))


_PAL_PROBE = f"""WITH RECURSIVE {_NN}, z AS (SELECT sum(v) // 20 z FROM nn), f AS (SELECT greatest(i, j) k, least(i, j) m, i < j up, sum(v) w FROM nn GROUP BY 1, 2, 3),
cut(cs, spot, stop) AS (
 SELECT [0::BIGINT], 0::BIGINT, false
 UNION ALL
 SELECT list_append(cs, e), e, e = spot FROM (SELECT cs, spot, coalesce((SELECT min(k) FROM (
   SELECT k, sum(w) OVER (PARTITION BY s ORDER BY k) t FROM (
    SELECT k, CASE WHEN m >= spot THEN -1 ELSE 2 * len(list_filter(cs, lambda c: c <= m)) + up::INT END s, sum(w) w FROM f WHERE k >= spot GROUP BY 1, 2)) WHERE t > (SELECT z FROM z)), (SELECT n FROM size)) e
  FROM cut WHERE NOT stop AND spot < (SELECT n FROM size)))
SELECT CAST(len(cs) - 1 AS INTEGER) k, spot FROM cut"""


@query("pal_probe", _PAL_PROBE)
def pal_probe(spark, sf):
    a = nn(spark, sf)
    return _cut_rows(spark, T.pal_under(a, a.total_load() // 20)[0])


@query("pal", Q.pal(_PP_X, 8, True))
def pal(spark, sf):
    return _result(spark, T.pal(pp(spark, sf), 8))


@query("opal", Q.pal(_PP_X, 8, False))
def opal(spark, sf):
    return _result(spark, T.opal(pp(spark, sf), 8))


@query("exact", Q.exact(_NN_X))
def exact(spark, sf):
    return _result(spark, *X.exact(nn(spark, sf), 3))


# --- objectives -------------------------------------------------------------------------------------------------------


def _objective(spark: SparkSession, a: SparseMatrix, text: str, parts: int) -> DataFrame:
    o = S.parse(text)
    return S.evaluate(o, [a, a], [T.uniform(a.n_rows, parts)] * len(o.axes))


@query("objective_2dr", f"{_NN_TILES} SELECT 0 dim, u part, max(load) cost FROM tiles GROUP BY u UNION ALL SELECT 1, v, max(load) FROM tiles GROUP BY v")
def objective_2dr(spark, sf):
    return _objective(spark, nn(spark, sf), "0ij", 5)


@query("objective_2ds", f"{_NN_TILES} SELECT 0 dim, part, max(load) cost FROM (SELECT u part, load FROM tiles UNION ALL SELECT v, load FROM tiles) GROUP BY part")
def objective_2ds(spark, sf):
    return _objective(spark, nn(spark, sf), "0ij,i=j", 5)


_TASKS = "tasks AS (SELECT a.u i, a.v j, b.v k, a.load + b.load + c.load t FROM tiles a JOIN tiles b ON a.v = b.u JOIN tiles c ON c.u = a.u AND c.v = b.v)"


@query("objective_3ds", f"{_NN_TILES}, {_TASKS} SELECT 0 dim, part, max(t) cost FROM (SELECT i part, t FROM tasks UNION ALL SELECT j, t FROM tasks UNION ALL SELECT k, t FROM tasks) GROUP BY part")
def objective_3ds(spark, sf):
    return _objective(spark, nn(spark, sf), "0ij+0jk+0ik,i=j,j=k", 5)


@query("objective_spgemm", f"{_NN_TILES}, tasks AS (SELECT a.u i, a.v j, b.v k, a.load + b.load t FROM tiles a JOIN tiles b ON a.v = b.u) SELECT 0 dim, i part, max(t) cost FROM tasks GROUP BY i UNION ALL SELECT 1, j, max(t) FROM tasks GROUP BY j UNION ALL SELECT 2, k, max(t) FROM tasks GROUP BY k")
def objective_spgemm(spark, sf):
    return _objective(spark, nn(spark, sf), "0ij+1jk", 5)


@query("spmv_load", f"{_NN_TILES} SELECT t.u, t.v, t.load + 2.0::DOUBLE * (a.hi - a.lo) + 0.5::DOUBLE * (b.hi - b.lo) load FROM tiles t JOIN p a ON a.k = t.u JOIN p b ON b.k = t.v")
def spmv_load(spark, sf):
    a = nn(spark, sf)
    return S.spmv_loads(a, T.uniform(a.n_rows, 5), 2.0, 0.5)


@query("sgo_2ds")
def sgo_2ds(spark, sf):
    return _result(spark, S.sgo([nn(spark, sf)], "0ij,i=j", [4])[0])


@query("sgo_2dr")
def sgo_2dr(spark, sf):
    return _result(spark, *S.sgo([nn(spark, sf)], "0ij", [4, 4]))


@query("sgo_2dr_nic")
def sgo_2dr_nic(spark, sf):
    a = nn(spark, sf)
    return _result(spark, *T.nic(a, 4, 4, start=S.sgo([a], "0ij", [4, 4])[0]))


@query("sgo_3ds")
def sgo_3ds(spark, sf):
    return _result(spark, S.sgo([nn(spark, sf)], "0ij+0jk+0ik", [4])[0])


@query("sgo_3dr")
def sgo_3dr(spark, sf):
    a = nn(spark, sf)
    found = S.sgo([a, a], "0ij+1jk", [3, 3, 3])
    return spark.createDataFrame([(d, k, int(c)) for d, cuts in enumerate(found) for k, c in enumerate(cuts)], "dim int, k int, spot long")


@query("sgo_spmv")
def sgo_spmv(spark, sf):
    return _result(spark, S.sgo_spmv(nn(spark, sf), 4, 1.0, 1.0))
