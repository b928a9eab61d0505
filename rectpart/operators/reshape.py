"""Transposition, relabelling and filters of a matrix; every relabelling is a join with a permutation (old, new)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectpart.model import SparseMatrix
from rectpart.operators.loads import degrees
from rectpart.operators.scan import Scratch, global_rank


def transpose(a: SparseMatrix) -> SparseMatrix:
    return SparseMatrix(a.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a.n_cols, a.n_rows, a.weighted)


def sorted_coordinates(a: SparseMatrix) -> DataFrame:
    """All nonzeros by row, then column; weights move with their coordinates."""
    return a.df.orderBy("i", "j")


def upper_triangle(a: SparseMatrix) -> SparseMatrix:
    """The nonzeros strictly above the diagonal."""
    return SparseMatrix(a.df.filter("j > i"), a.n_rows, a.n_cols, a.weighted)


def ranked(ids: DataFrame, order: list) -> DataFrame:
    """(old, new): 0-based ranks of `id` in an order. Ranks come from range partitions and their sizes, so no task holds all ids."""
    return global_rank(ids, order).select(F.col("id").alias("old"), F.col("rank").alias("new"))


def degree_order(a: SparseMatrix, descending: bool = False) -> DataFrame:
    """(old, new) by the number of nonzeros in a row, ties by id. Square matrices only, as rows and columns share the map."""
    a.require_square()
    key = F.desc("degree") if descending else F.asc("degree")
    return ranked(degrees(a), [key, F.asc("id")])


def random_order(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(old, new): a permutation that depends on the seed alone, by a hash that any SQL engine has."""
    ids = spark.range(n).withColumn("h", F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 15), 16, 10).cast("long"))
    return ranked(ids, [F.asc("h"), F.asc("id")])


def natural_order(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("old"), F.col("id").alias("new"))


def components(edges: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, c): the smallest number of each node's component, for nodes (x) and edges (x, y) in both directions. Labels take the smallest neighbour's and then that label's own, so
    that rounds grow with the logarithm of a component's depth where its numbers fall along it, and never beyond the depth."""
    own = nodes.select("x", F.col("x").alias("c"))
    label, turn = scratch.save(own, "label0"), 0
    while True:
        near = edges.join(label.select(F.col("x").alias("y"), F.col("c").alias("d")), "y").groupBy("x").agg(F.min("d").alias("d"))
        low = label.join(near, "x", "left").select("x", "c", F.least("c", F.coalesce("d", "c")).alias("low"))
        jump = label.select(F.col("x").alias("low"), F.col("c").alias("lower"))
        turn += 1
        step = scratch.save(low.join(jump, "low").select("x", "c", F.least("low", "lower").alias("next")), f"label{turn}")
        scratch.drop(f"label{turn - 1}")
        label = step.select("x", F.col("next").alias("c"))
        if step.filter("next < c").isEmpty():
            return label


def rcm_order(a: SparseMatrix, reverse: bool = True) -> DataFrame:
    """(old, new) by (reverse) Cuthill-McKee on a symmetric pattern; of another, on its union with its transpose.

    Components come by their row of least degree, from which each is searched breadth first; a level's rows stand by their first parent's place, then degree. Ties go to smaller ids. All
    components are searched together, a level of each at a time: rows are first numbered by degree and id, so that a component's start is its smallest number, and a level's
    order needs parent's place and number alone. So there are as many turns as the deepest component has levels; isolated rows are components of one level.
    """
    a.require_square()
    n, scratch = a.n_rows, Scratch(a.df.sparkSession)
    pairs = scratch.save(a.df.select("i", "j"), "pairs")  # read twice
    number = scratch.save(ranked(degrees(SparseMatrix(pairs, n, n)), [F.asc("degree"), F.asc("id")]), "numbers")
    edge = pairs.filter("i != j")
    one, two = (number.select(F.col("old").alias(old), F.col("new").alias(new)) for old, new in (("i", "x"), ("j", "y")))
    edges = scratch.save(edge.unionAll(edge.select("j", "i")).distinct().join(one, "i").join(two, "j").select("x", "y"), "edges")
    scratch.drop("pairs")
    part = scratch.save(components(edges, number.select(F.col("new").alias("x")), scratch), "parts")
    level = scratch.save(part.filter("x = c").select("x", F.col("x").alias("place"), F.lit(0).alias("level")), "level0")
    before, turn = level.limit(0), 0
    while True:
        reached = edges.join(level, "x").groupBy("y").agg(F.min("place").alias("parent")).withColumnRenamed("y", "x")
        # a level's neighbours lie in the level before, in it, or in the next
        reached = reached.join(before.unionAll(level).select("x"), "x", "left_anti")
        turn += 1
        placed = global_rank(reached, [F.asc("parent"), F.asc("x")]).select("x", F.col("rank").alias("place"), F.lit(turn).alias("level"))
        before, level = level, scratch.save(placed, f"level{turn}")
        if level.isEmpty():
            break
    paths = [f"{scratch.path}/level{k}" for k in range(turn)]
    found = a.df.sparkSession.read.schema(level.schema).parquet(*paths).join(part, "x").join(number.withColumnRenamed("new", "x"), "x")
    order = global_rank(found.select("old", "c", "level", "place"), [F.asc("c"), F.asc("level"), F.asc("place")])
    return order.select("old", (F.lit(n - 1) - F.col("rank") if reverse else F.col("rank")).alias("new"))


def inverse(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("new").alias("old"), F.col("old").alias("new"))


def permutation_check(perm: DataFrame, n: int, least: int = 0) -> DataFrame:
    """valid: n rows whose new ids are least..least+n-1, each once."""
    seen = perm.agg(F.count("*").alias("n"), F.countDistinct("new").alias("d"), F.min("new").alias("lo"), F.max("new").alias("hi"))
    return seen.select(((F.col("n") == n) & (F.col("d") == n) & ((F.col("n") == 0) | ((F.col("lo") == least) & (F.col("hi") == least + n - 1)))).alias("valid"))


def permute(a: SparseMatrix, rows: DataFrame | None = None, cols: DataFrame | None = None, rows_new_to_old: bool = False, cols_new_to_old: bool = False) -> SparseMatrix:
    """Relabels rows and columns by maps (old, new); the flags say that a map is read from new to old instead. A job that meets a nonzero whose id a map lacks fails."""
    df = a.df
    for axis, perm, flip in (("i", rows, rows_new_to_old), ("j", cols, cols_new_to_old)):
        if perm is not None:
            perm = inverse(perm) if flip else perm
            new = F.coalesce("_new", F.raise_error(F.concat(F.lit("the map lacks id "), F.col(axis).cast("string"))).cast("long"))
            df = df.join(perm.select(F.col("old").alias(axis), F.col("new").alias("_new")), axis, "left").withColumn(axis, new).drop("_new")
    return SparseMatrix(df.select("i", "j", "v"), a.n_rows, a.n_cols, a.weighted)


def reorder(a: SparseMatrix, order: str = "nat", triangular: bool = False, reverse: bool = True, seed: int = 1) -> SparseMatrix:
    """nat, asc, dsc, rnd or rcm on rows and columns alike; triangular: then only the part above the diagonal."""
    if order == "nat":
        out = a
    else:
        a.require_square()
        makers = {"asc": lambda: degree_order(a), "dsc": lambda: degree_order(a, True), "rnd": lambda: random_order(a.df.sparkSession, a.n_rows, seed), "rcm": lambda: rcm_order(a, reverse)}
        if order not in makers:
            raise ValueError(f"unknown order {order!r}; one of nat, {', '.join(makers)}")
        perm = makers[order]()
        out = permute(a, perm, perm)
    return upper_triangle(out) if triangular else out


def compress(ids: DataFrame, column: str) -> DataFrame:
    """(old, new): dense ranks of the ids in use; 0 always counts as used."""
    used = ids.select(F.col(column).cast("long").alias("id")).unionAll(ids.sparkSession.range(1)).distinct()
    return ranked(used, [F.asc("id")])


def csr_rows(a: SparseMatrix) -> DataFrame:
    """(i, cols): sorted column ids of each row, empty rows included."""
    some = a.df.groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("cols"))
    every = a.df.sparkSession.range(a.n_rows).withColumnRenamed("id", "i")
    return every.join(some, "i", "left").select("i", F.coalesce("cols", F.array().cast("array<bigint>")).alias("cols"))


def adjacency_lines(a: SparseMatrix) -> DataFrame:
    """(i, line): `i : j j j` for each row."""
    return csr_rows(a).select("i", F.concat(F.col("i").cast("string"), F.lit(" :"), F.when(F.size("cols") > 0, F.concat(F.lit(" "), F.array_join(F.transform("cols", lambda c: c.cast("string")), " "))).otherwise("")).alias("line"))


def same_matrix(a: SparseMatrix, b: SparseMatrix) -> bool:
    """Equal sizes and equal nonzeros, duplicates and weights included."""
    if (a.n_rows, a.n_cols) != (b.n_rows, b.n_cols):
        return False
    x, y = a.loads(), b.loads()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def matrix_check(a: SparseMatrix) -> DataFrame:
    """valid: every id lies within the declared sizes."""
    inside = (F.col("i") >= 0) & (F.col("i") < a.n_rows) & (F.col("j") >= 0) & (F.col("j") < a.n_cols)
    return a.df.agg(F.coalesce(F.bool_and(inside), F.lit(True)).alias("valid"))
