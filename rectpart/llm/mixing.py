"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in the order of size class, salt, size and id. Each has the same expected number of copies,
the source's target over its size; the running sum of these, plus one random offset of the source, crosses
an integer once for each copy. Standing by size, every source's copies have nearly the mean size of its documents.

The running sum never needs a source in one task: documents are counted by (source, size class, salt), the counts are
summed up over salts and then over classes, and only the place within one such cell comes from a window over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rectpart.llm.textops import SPACE_CLASS
from rectpart.operators.scan import saved

#: Rows of the whole table for which one more salt is used.
ROWS_PER_SALT = 500_000
#: Steps of the random offset.
STEPS = 1 << 20


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text, 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")).cast("long")


def _hash(value: Column, steps: Column | int) -> Column:
    """A number below `steps` from the MD5 of a value; plain SQL engines have the same."""
    return F.conv(F.substring(F.md5(value), 1, 7), 16, 10).cast("long") % steps


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """One row for each source of `sizes` (source, size): source, source_size, target, rate, offset.

    Sources by code point, null last, have the given weights in turn and share all sizes; a target stops at `most` times its source's size, and
    the rest is shared anew by weight. A source without any words has target and rate 0. The table has a row for each source,
    so its windows are small.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = by_source.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long").alias("weight"))
    # sources in the order in which they reach their bound; the first k are held at it, the others share what is left
    everything = Window.partitionBy()
    upto = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total, total_weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    held = F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * most
    share = (total - held) / (total_weight - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    shares = weighed.withColumn("share", share)
    full = F.col("source_size") * most <= F.col("weight") * F.col("share")
    level = F.max("share").over(everything)  # rises as long as sources are full, then falls
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") * level)
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).when(full, F.lit(float(most))).otherwise(target / F.col("source_size"))
    offset = _hash(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), "source"), F.lit(""))), STEPS) / F.lit(float(STEPS))
    return shares.select("source", "source_size", target.alias("target"), rate.alias("rate"), offset.alias("offset"))


def copies_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row: how often the mix takes it; carry: also `row`, a struct of all its columns.

    Null sources are a source of their own, null texts have size 0. Rows that repeat, also with the same id or a null id, each take part; of rows with one size
    and id, that with the smaller hash of its text (then, with carry, of its columns) comes first, so that the same rows give the same copies again. An empty table gives no rows. A source's size is the words of its
    documents; no document is taken more than `most` times. A source of empty documents is never taken. Other columns aren't read. Two passes over the texts: one counts
    the cells, which are saved, one places the rows, which go over the network once: the window and the join have the same keys.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("key")  # null is a source of its own
    # rows of one id and text that are carried are told apart by their other columns
    plain = [docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    whole = [F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.xxhash64(*plain).alias("tie")] if carry else []
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"), F.md5(docs[text_col]).alias("th"), *whole)
    salts = 8 + docs.count() // ROWS_PER_SALT
    bits = F.length(F.bin("size"))
    size_class = F.when(F.col("size") < 16, F.col("size")).otherwise(bits * 8 + F.expr("shiftright(size, cast(length(bin(size)) as int) - 4)") % 8)
    rows = rows.withColumns({"size_class": size_class.cast("int"), "salt": _hash(F.concat_ws(":", F.col("doc_id").cast("string"), "th"), salts).cast("int")})
    cells = saved(rows.groupBy("source", "size_class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    targets = source_targets(cells, weights, most)
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    classes = cells.groupBy("source", "size_class").agg(F.sum("n").alias("n"))
    classes = classes.select(F.col("source").alias("s1"), F.col("size_class").alias("c1"), F.coalesce(F.sum("n").over(before("size_class").partitionBy("source")), F.lit(0)).alias("class_start"))
    starts = cells.select(F.col("source").alias("s2"), key, F.col("size_class"), F.col("salt"), F.coalesce(F.sum("n").over(before("salt").partitionBy("source", "size_class")), F.lit(0)).alias("salt_start"))
    starts = starts.join(classes, F.col("s1").eqNullSafe(F.col("s2")) & (F.col("c1") == F.col("size_class")))
    starts = starts.join(targets.withColumnRenamed("source", "s3"), F.col("s3").eqNullSafe(F.col("s2")))
    starts = starts.select("key", "size_class", "salt", (F.col("class_start") + F.col("salt_start")).alias("start"), "source_size", "target", "rate", "offset")
    place = F.row_number().over(Window.partitionBy("key", "size_class", "salt").orderBy("size", "doc_id", "th", *(["tie"] if carry else [])))
    placed = rows.withColumn("key", key).withColumn("place", place).join(starts, ["key", "size_class", "salt"])
    upto = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    n = F.col("start") + F.col("place")
    return placed.select("doc_id", "source", "size", "source_size", "target", F.least(F.lit(most), upto(n) - upto(n - 1)).cast("int").alias("copies"), *(["row"] if carry else []))
