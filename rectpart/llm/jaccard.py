"""Similarity join of documents by the Jaccard similarity of their word shingles: a grouped prefix join.

1. Every document becomes the set of hashes of its 5-word shingles, in one order for all: rare ones first, by counts in a fixed-size sketch of the whole
   corpus, then by hash. Equal sets are one class.
2. Two sets that link share one of their first n - ceil(0.8 n) + 1 shingles (the prefix). Classes with the same size and prefix are one group.
3. Groups that share a prefix shingle are candidates if their sizes allow the similarity, the shingle stands early enough in both to be the first common one of
   linked sets, and the parity bitmaps of two single classes differ in no more places than linked sets can.
4. Candidate pairs are expanded to classes, filtered by size and bitmap, and verified on their whole sets.

Links only matter for components. So each shingle's list of groups is first linked along its order and to its first group; pairs in one component by then need no
test. All other pairs are then tested, without exception: only pairs that are already connected are left out. In each of the two rounds, texts of candidates that pass the
bitmaps go to the tasks of hubs: of a pair's two classes, that with more pairs. A hub's text goes once for each of the salts over which its pairs are dealt, other texts once for each pair.
A shingle's long list is joined with itself in cells of two blocks, so that no task has the list.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rectpart.llm import graph, textops
from rectpart.operators.scan import Scratch, arrow_rows

WORDS = 5
#: Similarity as a fraction.
PART, WHOLE = 4, 5
#: Cells of the sketch by the corpus' bytes, and their bounds (bits). A rank of one byte for each is sent to the executors: 4 MB at most.
BYTES_PER_CELL, LEAST_BITS, MOST_BITS, SKETCH_BLOCKS = 256, 12, 22, 32
#: Text for a shingle, about; a cell with the corpus' mean count or less has rank 0.
BYTES_PER_WORD = 7
SLICE_BYTES = 1 << 20
#: Rows with texts that come to a worker at a time.
BATCH_ROWS = 1_000
#: Groups in a token's list for which one more salt is used.
ROWS_PER_SALT = 100_000
#: Groups in a token's list for which the list, when it is joined with itself, is split once more.
ROWS_PER_BLOCK = 2_000
#: Pairs of a class for which its text is sent once more.
PAIRS_PER_COPY = 1_000
#: 64-bit words of a set's parity bitmap.
BITMAP_WORDS = 8
BITMAP = [f"bits{i}" for i in range(BITMAP_WORDS)]
_STEPS = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every shingle, and the number of shingles before each text (length rows + 1).

    Words are lower-cased (A-Z); a text of fewer than WORDS words is one shingle, one without words has none.
    """
    starts, ends, before = textops.words(data, offsets)
    word = textops.span_hash(textops.prefix_hash(data, lower=True), starts, ends)
    n = np.diff(before)
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    upto = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(before[:-1] - upto[:-1], count) + np.arange(upto[-1])
    size = np.repeat(np.minimum(n, WORDS), count)
    h = size.astype(np.uint64)
    for k in range(WORDS):
        w = word[np.minimum(first + k, len(word) - 1)] if len(word) else word
        h = np.where(k < size, textops.mix(h * _STEPS + w), h)
    return h, upto


def cell_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def ordered_tokens(h: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Shingles as numbers whose order is the join's order: the rank of the sketch's cell, then 56 bits of hash."""
    return ranks[cell_of(h, len(ranks).bit_length() - 1)].astype(np.uint64) << np.uint64(56) | (h & np.uint64((1 << 56) - 1))


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits of a set of tokens."""
    return np.array([textops.mix(tokens).sum(), textops.mix(tokens ^ _STEPS).sum()], np.uint64).tobytes()


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Of each bit, whether an odd number of tokens falls on it. Two sets differ in at least as many tokens as their bitmaps do in bits."""
    odd = np.bincount((textops.mix(tokens) % np.uint64(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(docs: DataFrame) -> np.ndarray:
    """Counts of all shingles of the corpus by cell, as ranks 0..255 (log scale). There is a cell for every BYTES_PER_CELL bytes of text, within bounds.

    The ranks only order shingles; whatever the number of cells, the join's results are the same.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_PER_CELL).bit_length()))
    typical = max(1.0, size / BYTES_PER_WORD / (1 << bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            data, offsets = textops.buffers(batch.column(0))
            for i, j in textops.slices(offsets, SLICE_BYTES):
                h, _ = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                np.add.at(total, cell_of(h, bits), 1)
        if total.any():
            # a task's counts are small numbers: by planes of bytes, most of which are zeros
            parts = [zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T), 1) for x in np.split(total, SKETCH_BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=["block", "counts"])

    def total_of(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // SKETCH_BLOCKS)
        for x in table["counts"]:
            total += np.ascontiguousarray(np.frombuffer(zlib.decompress(x.as_py()), np.uint8).reshape(4, -1).T).view("<u4").ravel()
        ranks = np.clip(8 * np.log2(np.maximum(1.0, total / typical)), 0, 255).astype(np.uint8)
        return pa.table({"block": table["block"][:1], "ranks": pa.array([ranks.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(total_of, "block int, ranks binary").collect()
    ranks = np.zeros((SKETCH_BLOCKS, (1 << bits) // SKETCH_BLOCKS), np.uint8)
    for r in rows:
        ranks[r.block] = np.frombuffer(r.ranks, np.uint8)
    return ranks.ravel()


def document_sets(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """doc_id, th (both as in docs), n, key (16 bytes, the same for equal sets only), group_key (the same for prefixes), prefix (tokens, ascending, 8 bytes each), bitmap words of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textops.buffers(batch.column(2))
            sizes, keys, group_keys, prefixes, maps = [], [], [], [], [np.zeros((0, BITMAP_WORDS), np.int64)]
            for i, j in textops.slices(offsets, SLICE_BYTES):
                h, upto = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                tokens = ordered_tokens(h, sent.value)
                for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                    own = np.unique(tokens[a:b])
                    n = len(own)
                    prefix = own[: n - -(-PART * n // WHOLE) + 1] if n else own
                    sizes.append(n)
                    keys.append(set_key(own))
                    group_keys.append(set_key(prefix))
                    prefixes.append(prefix.tobytes())
                    maps.append(bitmap(own)[None])
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (keys, group_keys, prefixes)), *map(pa.array, np.concatenate(maps).T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "key", "group_key", "prefix", *BITMAP])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n long, key binary, group_key binary, prefix binary, " + ", ".join(f"{b} long" for b in BITMAP))


def postings_of(groups: DataFrame) -> DataFrame:
    """token, gid, n, pos: one row for each prefix token of each group (gid, n, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = textops.buffers(batch.column(2))
            count = np.diff(offsets) // 8
            row = np.repeat(np.arange(len(count)), count)
            first = np.cumsum(count) - count
            token = np.frombuffer(raw.tobytes(), np.int64)
            gid, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(0, len(token), 1 << 20):
                k = row[i : i + (1 << 20)]
                yield pa.RecordBatch.from_arrays([pa.array(token[i : i + (1 << 20)]), pa.array(gid[k]), pa.array(n[k].astype(np.int32)), pa.array((np.arange(i, i + len(k)) - first[k]).astype(np.int32))], names=["token", "gid", "n", "pos"])

    return groups.select("gid", "n", "prefix").mapInArrow(run, "token long, gid long, n int, pos int")


def oriented(pairs: DataFrame) -> DataFrame:
    """hub, salt, leaf of the pairs (a, b) of classes: the hub is the class with more pairs, and its pairs are dealt over salts."""
    ends = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select("b")).groupBy("cid").agg(F.count("*").alias("times"))
    of = lambda c, times: ends.select(F.col("cid").alias(c), F.col("times").alias(times))
    both = pairs.join(of("a", "times_a"), "a").join(of("b", "times_b"), "b")
    turned = F.col("times_a") < F.col("times_b")
    both = both.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("leaf"), F.greatest("times_a", "times_b").alias("times"))
    return both.select("hub", F.pmod(F.xxhash64("leaf"), F.floor(F.col("times") / PAIRS_PER_COPY) + 1).alias("salt"), "leaf")


def verified(turned: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, linked of pairs (hub, salt, leaf) of classes, by their whole sets. texts: cid, text of each class that stands in a pair.

    A task reads each hub's text once for a salt, then the leaves' texts, a few at a time by their bytes: memory depends on the longest two texts alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            hubs, leaves = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            data, offsets = textops.buffers(batch.column(3))
            found: list[tuple[int, int, bool]] = []
            for i, j in textops.slices(offsets, SLICE_BYTES):
                h, upto = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, x, y in zip(range(i, j), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                    other, hub, leaf = np.unique(h[x:y]), hubs[k], leaves[k]
                    if leaf is None:
                        current, own = hub, other
                        continue
                    if hub != current:
                        raise ValueError("a pair came without its hub's text")
                    common = len(np.intersect1d(own, other, True))
                    found.append((min(hub, leaf), max(hub, leaf), WHOLE * common >= PART * (len(own) + len(other) - common)))
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["a", "b", "linked"])

    hubs = turned.select("hub", "salt").distinct().join(texts, F.col("hub") == F.col("cid")).select("hub", "salt", F.lit(None).cast("long").alias("leaf"), "text")
    leaves = turned.join(texts, F.col("leaf") == F.col("cid")).select("hub", "salt", "leaf", "text")
    # nulls, the hubs, come first
    rows = hubs.unionAll(leaves).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "leaf")
    return rows.mapInArrow(run, "a long, b long, linked boolean")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _sizes_fit(x: Column, y: Column) -> Column:
    return F.least(x, y) * WHOLE >= F.greatest(x, y) * PART


def _near(n: Column, m: Column, other: str) -> Column:
    """Whether two bitmaps let the sets link: n + m - 2 * common <= (WHOLE - PART) / (WHOLE + PART) * (n + m) for linked sets."""
    apart = reduce(add, (F.bit_count(F.col(b).bitwiseXOR(F.col(b + other))) for b in BITMAP))
    return apart * (WHOLE + PART) <= (n + m) * (WHOLE - PART)


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_duplicates with th (xxhash64 of the text) and stays: whether the row has the id and text that represent its component; the smallest id, then the smallest th.

    So each component has one text with stays, which repeated rows all have, and rows with one id and unlike texts are told apart.
    """
    spark = docs.sparkSession
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    base = base.withColumn("th", F.xxhash64("text"))
    scratch = Scratch(spark)
    with arrow_rows(spark, BATCH_ROWS):
        sets = scratch.save(document_sets(base, sketch(base)), "sets")
    rows = scratch.save(sets.select("doc_id", "th", "n", "key"), "rows")
    full = sets.filter("n > 0 and doc_id is not null")
    # ids of the classes are made once, in the table that is written
    classes = full.groupBy("n", "key", "group_key").agg(F.min("doc_id").alias("low"), F.min_by("th", F.struct("doc_id", "th")).alias("th"), *(F.first(b).alias(b) for b in BITMAP))
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    # classes of one size and one prefix are a group, named by its smallest class
    groups = classes.groupBy("n", "group_key").agg(F.min("cid").alias("gid"), F.count("*").alias("members"))
    members = scratch.save(classes.join(groups.filter("members > 1"), ["n", "group_key"]).select("gid", "cid"), "members")
    prefixes = full.groupBy("n", "group_key").agg(F.first("prefix").alias("prefix"))
    postings = postings_of(prefixes.join(groups, ["n", "group_key"]))
    several = postings.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1")
    shared = scratch.save(postings.join(several, "token"), "shared")
    scratch.drop("sets")
    graph.release(docs)

    def texts_of(pairs: DataFrame) -> DataFrame:
        """cid, text of the classes in pairs: one read of the documents, of which only those texts go on."""
        wanted = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select("b")).distinct().join(classes.select("cid", F.col("low").alias("doc_id"), "th"), "cid")
        # copies of a row go after the join, which may then leave out the other texts before a shuffle
        each = base.filter("doc_id is not null").join(wanted, ["doc_id", "th"])
        return each.groupBy("doc_id", "th").agg(F.first("cid").alias("cid"), F.first("text").alias("text")).select("cid", "text")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.save(pairs, f"{name}_pairs")
        turned = scratch.save(oriented(pairs), f"{name}_turned")
        graph.release(docs)
        texts = scratch.save(texts_of(pairs), f"{name}_texts")
        graph.release(docs)
        with arrow_rows(spark, BATCH_ROWS):
            found = scratch.save(verified(turned, texts), f"{name}_tested")
        scratch.drop(f"{name}_pairs", f"{name}_turned", f"{name}_texts")
        graph.release(docs)
        return found

    # first links: within groups, along each token's list, and to its first group; a long list is dealt over salts, each with a list of its own
    salt = F.pmod(F.xxhash64("gid"), F.floor(F.col("times") / ROWS_PER_SALT) + 1)
    order = Window.partitionBy("token", "salt").orderBy("n", "gid")
    along = shared.withColumn("salt", salt).select("gid", "n", F.lag("gid").over(order).alias("g"), F.lag("n").over(order).alias("m")).filter("g is not null")
    firsts = shared.groupBy("token").agg(F.min("gid").alias("g"), F.min_by("n", "gid").alias("m"))
    chained = along.unionAll(shared.join(firsts, "token").select("gid", "n", "g", "m")).filter((F.col("g") != F.col("gid")) & _sizes_fit(F.col("n"), F.col("m")))
    chained = chained.select(*_ordered(F.col("gid"), F.col("g"))).unionAll(members.filter("gid != cid").select(*_ordered(F.col("gid"), F.col("cid")))).distinct()
    one = classes.select(F.col("cid").alias("a"), "n", *BITMAP)
    two = classes.select(F.col("cid").alias("b"), F.col("n").alias("m"), *(F.col(b).alias(f"{b}_") for b in BITMAP))
    tested = linked(chained.join(one, "a").join(two, "b").filter(_near(F.col("n"), F.col("m"), "_")).select("a", "b"), "first")
    links = tested.filter("linked").select("a", "b")
    parts = graph.components(links, scratch, "first")

    # all candidate pairs that aren't connected yet; a group has the components of its members
    label = lambda c: F.coalesce("component", c)
    member_parts = scratch.save(members.join(parts, F.col("cid") == F.col("node"), "left").select("gid", "cid", label("cid").alias("part")), "member_parts")
    several = member_parts.groupBy("gid").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    lists = shared.drop("times").join(parts, F.col("gid") == F.col("node"), "left").withColumn("part", label("gid")).join(several, "gid", "left")
    lists = lists.select("token", "gid", "n", "pos", F.col("low").isNull().alias("single"), F.coalesce("low", "part").alias("low"), F.coalesce("high", "part").alias("high"))
    lists = scratch.save(lists, "lists")
    scratch.drop("shared")
    mixed = lists.groupBy("token").agg(F.min("low").alias("lowest"), F.max("high").alias("highest"), F.count("*").alias("times")).filter("lowest < highest").select("token", F.floor(F.col("times") / ROWS_PER_BLOCK).cast("int").alias("last"))
    rest = lists.join(mixed, "token").join(classes.select(F.col("cid").alias("gid"), *BITMAP), "gid")
    rest = scratch.save(rest, "rest")
    scratch.drop("lists")
    # a long list is joined with itself block by block: two groups meet once, in the cell of their two blocks
    block = F.pmod(F.xxhash64("gid"), F.col("last") + 1).cast("int")
    rest = rest.withColumn("block", block)
    left = rest.select(*rest.columns, F.explode(F.sequence("block", "last")).alias("column"))
    other = rest.select("*", F.explode(F.sequence(F.lit(0), "block")).alias("row"))
    other = other.select("token", "row", *(F.col(c).alias(f"{c}_") for c in rest.columns if c != "token"))
    # if this is the first common token, at most so many can be common; a linked pair passes at its first one
    most = F.least(F.col("n") - F.col("pos"), F.col("n_") - F.col("pos_"))
    needed = (F.col("n") + F.col("n_")) * PART <= most * (PART + WHOLE)
    # a group of several classes has no bitmap of its own
    near = ~F.col("single") | ~F.col("single_") | _near(F.col("n"), F.col("n_"), "_")
    open_ = ~((F.col("low") == F.col("high")) & (F.col("low_") == F.col("high_")) & (F.col("low") == F.col("low_")))
    meet = (left.token == other.token) & (F.col("block") == F.col("row")) & (F.col("column") == F.col("block_")) & ((F.col("block") < F.col("block_")) | (F.col("gid") < F.col("gid_")))
    crossing = left.join(other, meet & _sizes_fit(F.col("n"), F.col("n_")) & needed & open_ & near).select(F.least("gid", "gid_").alias("gid"), F.greatest("gid", "gid_").alias("gid_")).distinct()
    first, second = members.select(F.col("gid").alias("m1"), F.col("cid").alias("c1")), members.select(F.col("gid").alias("m2"), F.col("cid").alias("c2"))
    expanded = crossing.join(first, F.col("gid") == F.col("m1"), "left").join(second, F.col("gid_") == F.col("m2"), "left").select(*_ordered(F.coalesce("c1", "gid"), F.coalesce("c2", "gid_")))
    within = member_parts.join(several.filter("low < high").select("gid"), "gid").join(classes.select("cid", "n", *BITMAP), "cid")
    twin = within.select("gid", F.col("cid").alias("cid_"), F.col("part").alias("part_"), *(F.col(b).alias(f"{b}_") for b in BITMAP))
    within = within.join(twin, "gid").filter((F.col("cid") < F.col("cid_")) & (F.col("part") != F.col("part_")) & _near(F.col("n"), F.col("n"), "_"))
    to_test = expanded.unionAll(within.select(F.col("cid").alias("a"), F.col("cid_").alias("b"))).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = linked(to_test, "rest").filter("linked").select("a", "b")
    final = graph.components(links.unionAll(more), scratch, "final")
    scratch.drop("rest")

    # of each component, the smallest id and its text
    ours = classes.select("cid", "low", "th").join(final, F.col("cid") == F.col("node"))
    heads = ours.groupBy("component").agg(F.min(F.struct("low", "th")).alias("head"))
    headed = classes.select("cid", "n", "key", "low", "th").join(ours.join(heads, "component").select("cid", "head"), "cid", "left")
    headed = headed.select("n", "key", F.coalesce("head.low", "low").alias("component_id"), F.coalesce("head.th", "th").alias("head"))
    headed = scratch.save(headed, "headed")
    scratch.drop("classes", "members", "member_parts")
    graph.release(docs)
    classed = rows.filter("n > 0 and doc_id is not null").join(headed, ["n", "key"])
    classed = classed.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "th", ((F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("head"))).alias("stays"))
    alone = rows.filter("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "th", F.lit(True).alias("stays"))
    return classed.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id reachable by links of similarity 0.8 or more.

    Null text and texts without words have an empty set, link with nothing and are their own component. Equal sets always link. Rows that repeat each give a row; rows
    with one id and unlike texts each have the links of their own text. A null id links with nothing and its component is null.
    An empty table gives no rows; other columns aren't read.
    """
    return clustered(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that represent their components, with all their columns; of rows with the same id and text, that with the least hash of its columns. Rows with a null id all stay."""
    th = "th"
    while th in docs.columns:
        th += "_"
    known = docs.filter(docs[id_col].isNotNull()).withColumn(th, F.xxhash64(F.col(text_col).cast("string")))
    stay = clustered(docs, id_col, text_col).filter("stays and doc_id is not null").select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("th").alias(th)).distinct()
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias(f"{th}_row")
    one = known.join(stay, [id_col, th], "left_semi").groupBy(id_col, th).agg(row)
    return one.select(f"{th}_row.*").unionByName(docs.filter(docs[id_col].isNull()))
