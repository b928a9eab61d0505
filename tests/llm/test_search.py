"""Resampling, decontamination and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rectpart.llm import decontamination, queries, resampling, terms, wavelet
from rectpart.operators.scan import Scratch

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string"


def words_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]


def some_texts(seed, n, vocabulary=12, most=60):
    rng = random.Random(seed)
    words = ["The", "the", "İş", "a1", "Ünder", "ünder", "x", "ﬁ", "żółć", "B", "b2", "K"][:vocabulary]
    return [(k, rng.choice(["", " ", "-", "."]).join(rng.choice(words) + rng.choice([" ", ", ", "\n", " / "]) for _ in range(rng.randrange(most)))) for k in range(n)]


ODD = [(None, "The same text, under no id at all."), (None, "The same text, under no id at all."), (7, None), (8, ""), (9, " .\x00-\t "), (2**60, "long " * 30_000 + "end"), (1, "a1 b2"), (1, "a1 b2"), (-3, "Ǆ" * 3)]


def test_terms_are_the_contracts(spark):
    import pyarrow as pa

    texts = [x for _, x in some_texts(1, 40) + ODD] + ["".join(map(chr, range(1, 0x250))), "ABC\x7f{DEF}[ghi]@`01"]
    words, before = terms.terms_of(pa.array(texts, pa.string()))
    got = [[x.decode() for x in words[a:b].to_pylist()] for a, b in zip(before.tolist(), before.tolist()[1:])]
    assert got == [words_of(x) for x in texts] == [[x.decode() for x in terms.split(t)] for t in texts]


def test_ring_gives_each_run(spark):
    words = [b"a", b"", b"bc", "ü".encode(), b"a", b"d"]
    for n in (1, 2, 3, 9):
        want = [zlib.crc32(b" ".join(words[i : j + 1])) for j in range(len(words)) for i in range(j, max(-1, j - n), -1)]
        assert resampling.ring_states(words, n) == want


def resampled(docs, target, n, buckets, least, percent, seed):
    grams = lambda t: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for w in [words_of(t)] for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    s, t = Counter(x for _, d in docs for x in grams(d)), Counter(x for d in target for x in grams(d))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, d in docs:
        g = grams(d)
        weight = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words_of(d)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = drawn[: len(drawn) * percent // 100]
    return sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in list_minus(rows, drawn)], key=repr)


def list_minus(rows, out):
    left = list(rows)
    for r in out:
        left.remove(r)
    return left


@pytest.mark.parametrize("n", [1, 3])
def test_resampling(spark, n, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 2000)
    docs, target = some_texts(2, 60) + ODD, [x for _, x in some_texts(3, 9, 4)] + [None]
    got = resampling.resample(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("i", x) for x in target], "item_id string, text string"), n=n, buckets=50, least_words=5, percent=40, seed=7)
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(docs, target, n, 50, 5, 40, 7)
    none = spark.createDataFrame([], DOCS)
    assert resampling.resample(none, none).count() == 0
    assert resampling.resample(spark.createDataFrame(docs, DOCS), none, n=n).count() == len(docs)


ITEMS = [("a", "the a1 x the İş b"), ("b", "x x"), ("b", "żółć"), ("c", ""), ("d", None), (None, "ünder the"), ("10", "the x a1 b2 ünder the x"), ("9", "İş"), ("zz", "long long long end")]


def contaminated(docs, items, window):
    out = []
    for i, d in docs:
        w, hit, names = words_of(d), set(), set()
        for name, text in items:
            q = words_of(text)
            n = min(window, len(q))
            for part in {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == part:
                        hit.update(range(k, k + n))
                        names.add(name or "")
        out.append((i, len(w), len(hit), len(names), sorted(names)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [1, 3, 10])
@pytest.mark.parametrize("block", [1 << 20, 90])
def test_decontamination(spark, window, block, monkeypatch):
    monkeypatch.setattr(decontamination, "SEGMENT_BYTES", 1500)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    docs = some_texts(4, 60) + ODD
    frame, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(ITEMS, "item_id string, text string")
    got = decontamination.decontaminate(frame, items, window)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids) for r in got.collect()), key=repr) == contaminated(docs, ITEMS, window)
    if window == 3 and block > 90:
        assert decontamination.decontaminate(frame, items.limit(0)).filter("n_hit > 0").count() == 0
        assert decontamination.decontaminate(frame.limit(0), items).count() == 0


def test_proximity(spark, tmp_path, monkeypatch):
    """Documents and items are those with a short enough stretch that holds all terms of a window; each stretch is one, and begins and ends with one of the terms."""
    monkeypatch.setattr(decontamination, "SEGMENT_BYTES", 700)
    docs, scratch = some_texts(5, 40), Scratch(spark)
    items, window, span = [("p", "a1 x the"), ("q", "İş żółć ﬁ b2"), ("r", "none of these")], 3, 6
    index = decontamination.build_index(spark.createDataFrame(docs, DOCS), scratch)
    got = {(r.doc_id, r.item_id, r.first, r.last) for r in decontamination.find(index, spark.createDataFrame(items, "item_id string, text string"), scratch, window, span).collect()}
    texts, parts = {i: words_of(d) for i, d in docs}, {i: [set(words_of(t)[k : k + window]) for k in range(max(1, len(words_of(t)) - window + 1))] for i, t in items}
    want = {(i, name) for i, w in texts.items() for name in parts for k in range(len(w)) if any(p <= set(w[k : k + span]) for p in parts[name])}
    assert {x[:2] for x in got} == want and {x[1] for x in want} == {"p", "q"}
    for i, name, first, last in got:
        assert last - first <= span
        assert any(p <= set(texts[i][first:last]) and {texts[i][first], texts[i][last - 1]} <= p for p in parts[name])


def ranking(docs, items, k):
    counted = [(i, Counter(words_of(d))) for i, d in docs]
    n, total = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for name, text in items:
        found = []
        for i, c in counted:
            m = 100 - 25 + 25 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in words_of(text) if c[w])
            if score > 0:
                found.append((score, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(name, r + 1, i, score) for r, (score, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [1 << 20, 600])
@pytest.mark.parametrize("block", [1 << 20, 90])
def test_ranked_search(spark, shard, block, monkeypatch):
    for name, x in (("SHARD_BYTES", shard), ("BLOCK_BYTES", block), ("FEWEST", 2), ("MOST", 8), ("SALTS", 3)):
        monkeypatch.setattr(wavelet, name, x)
    docs = some_texts(6, 90) + ODD + [(200 + k, "x the x") for k in range(9)]
    got = wavelet.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(ITEMS, "item_id string, text string"), 7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=repr) == ranking(docs, ITEMS, 7)


def test_empty_tables_of_a_ranked_search(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "one two")], DOCS)
    for docs, items in ((none, some), (some, none), (none, none), (spark.createDataFrame([(1, None)], DOCS), some)):
        assert wavelet.ranked(docs, items, item_col="doc_id").count() == 0


def test_tree_opens_few_nodes_and_keeps_order(monkeypatch):
    """Each list falls by impact; a search for a rare term opens a path, not the tree, if it takes nodes one by one."""
    monkeypatch.setattr(wavelet, "FEWEST", 1)
    monkeypatch.setattr(wavelet, "MOST", 1)
    rng = np.random.Generator(np.random.PCG64(1))
    doc = [np.arange(1000), rng.choice(1000, 300, replace=False), np.array([700])]
    impact = [rng.integers(1, 50, len(x)) for x in doc]
    tree = wavelet.Tree(np.cumsum([len(x) for x in doc]), np.concatenate(doc), np.concatenate(impact), 1000)
    for term in range(3):
        a, b = (tree.ends[term - 1] if term else 0), tree.ends[term]
        assert (np.diff(tree.impact[0, a:b]) <= 0).all()
    found, score = tree.search(np.array([0, 2]), np.array([1, 1000]), 1)
    assert found.tolist() == [700] and score[0] == impact[0][700] + 1000 * impact[2][0] and tree.opened <= 10
    full = np.bincount(np.concatenate(doc), np.concatenate([i * w for i, w in zip(impact, (3, 2, 5))]), 1000).astype(int)
    found, score = tree.search(np.arange(3), np.array([3, 2, 5]), 40)
    best = sorted(range(1000), key=lambda d: (-full[d], d))[:40]
    assert found.tolist() == best and score.tolist() == [full[d] for d in best]


def test_queries_use_the_contracts_values():
    assert (resampling.BUCKETS, resampling.RUN, resampling.LEAST_WORDS, resampling.PERCENT, resampling.SEED, decontamination.WINDOW, wavelet.TOP) == (10_000, 1, 20, 10, 2024, 10, 20)
    assert {"op11_resampling", "op12_decontamination", "op13_ranked_search"} <= set(queries.queries()) & set(queries.oracle_sql())


@pytest.mark.parametrize("made", ["index", "shards"])
def test_segments_have_row_groups_of_their_own(spark, monkeypatch, made):
    """So that neither writers nor readers hold more than a segment, whatever a partition's size."""
    monkeypatch.setattr(decontamination, "SEGMENT_BYTES", 500)
    monkeypatch.setattr(wavelet, "SHARD_BYTES", 500)
    docs, scratch = spark.createDataFrame([(k, f"some words of {k} " * 20) for k in range(40)], "doc_id long, text string").coalesce(1), Scratch(spark)
    table = decontamination.build_index(docs, scratch) if made == "index" else wavelet.build_shards(docs, scratch)
    groups = [pq.ParquetFile(unquote(urlparse(f).path)).metadata for f in table.inputFiles()]
    assert sum(g.num_rows for g in groups) == sum(g.num_row_groups for g in groups) > 10


@pytest.mark.parametrize("most", [1, 120])
def test_ranked_search_in_many_trees(spark, most, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_BYTES", 300)
    monkeypatch.setattr(wavelet, "TREE_SIZE", most)
    docs = some_texts(7, 90) + ODD + [(200 + k, "x the x") for k in range(9)]
    got = wavelet.ranked(spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(ITEMS, "item_id string, text string"), 7)
    assert sorted(map(tuple, got.collect()), key=repr) == ranking(docs, ITEMS, 7)


def test_shards_that_follow_each_other_are_one_tree(spark, monkeypatch):
    """Trees hold asked terms only, and their documents by id, null last, wherever they were stored."""
    monkeypatch.setattr(wavelet, "SHARD_BYTES", 12)
    docs = [(9, "a b other words"), (None, "b b"), (3, "a"), (8, "none of these"), (3, "b a a"), (1, "b")]
    table = wavelet.build_shards(spark.createDataFrame(docs, DOCS).coalesce(1), Scratch(spark)).toArrow()
    known, asked = pa.array([b"b", b"absent", b"a", b"other"], pa.large_binary()), np.array([True, True, True, False])
    planted = lambda most: list(wavelet.plant(iter(table.to_batches(max_chunksize=2)), known, asked, 6, 14, most))
    assert len(table) == 4 and len(planted(1)) == 3 and len(planted(1 << 20)) == 1
    for most in (1, 1 << 20):
        assert sum(t.sizes for t, _, _ in planted(most)).tolist() == [4, 0, 3, 0]
    tree, ids, null = planted(1 << 20)[0]
    assert [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)] == [1, 3, 3, 9, None]
    found, _ = tree.search(np.array([0]), np.array([1]), 9)
    assert sorted(found.tolist()) in ([0, 1, 3, 4], [0, 2, 3, 4])


@pytest.mark.parametrize("most", [1, 40])
def test_decontamination_in_many_joins(spark, most, monkeypatch):
    monkeypatch.setattr(decontamination, "SEGMENT_BYTES", 300)
    monkeypatch.setattr(decontamination, "JOINED", most)
    docs = some_texts(9, 60) + ODD
    got = decontamination.decontaminate(spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(ITEMS, "item_id string, text string"), 3)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids) for r in got.collect()), key=repr) == contaminated(docs, ITEMS, 3)


def test_segments_that_follow_each_other_are_joined(spark, monkeypatch):
    """With asked terms only; each document keeps its segment's number and its place there, and no phrase crosses from one to the next."""
    monkeypatch.setattr(decontamination, "SEGMENT_BYTES", 12)
    docs = [(9, "a b other words"), (None, "b b"), (3, "a"), (8, "none of these"), (3, "b a b"), (1, "b")]
    table = decontamination.build_index(spark.createDataFrame(docs, DOCS).coalesce(1), Scratch(spark)).toArrow()
    block = decontamination.Block(["i"], ["a b absent"], 2)
    joins = lambda most: list(decontamination.joined(iter(table.to_batches(max_chunksize=2)), block.terms, most))
    assert len(table) == 4 and len(joins(1)) == 3 and len(joins(1 << 20)) == 1
    one, ids, number, place = joins(1 << 20)[0]
    assert ids.to_pylist() == [9, None, 3, 3, 1] and place.tolist() == [0, 0, 1, 0, 1] and len(set(number.tolist())) == 3
    assert sorted(one.terms.to_pylist()) == [b"a", b"b"] and one.counts.sum() == 9
    hits = sorted(block.exact(one))
    assert [(int(ids[int(d)].as_py()), first - int(one.docs[d])) for _, first, _ in hits for d in [np.searchsorted(one.docs, first, "right") - 1]] == [(9, 0), (3, 1)]


@pytest.mark.parametrize("made", ["index", "shards"])
def test_little_of_a_table_is_in_the_jvm_at_once(spark, monkeypatch, made):
    """Neither rows of MBs in the index, nor thousands of whole texts in Parquet's reader."""
    reader, seen = "spark.sql.parquet.columnarReaderBatchSize", []
    before, save = spark.conf.get(reader), Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, *a, **b: (seen.append(int(spark.conf.get(reader))), save(self, *a, **b))[1])
    docs = spark.range(900, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 600), x -> hash(x, id)))").alias("text"))
    table = decontamination.build_index(docs, Scratch(spark)) if made == "index" else wavelet.build_shards(docs, Scratch(spark))
    groups = [g.row_group(k).total_byte_size for f in table.inputFiles() for g in [pq.ParquetFile(unquote(urlparse(f).path)).metadata] for k in range(g.num_row_groups)]
    assert sum(groups) > 4 << 20 and max(groups) < 1 << 20
    assert seen == [256] and 256 < int(before) == int(spark.conf.get(reader))


def test_counts_of_asked_terms_shuffle_no_index(spark):
    """Terms that no item asks for go before the shuffle, and each task adds its shards up before it."""
    shards = wavelet.build_shards(spark.createDataFrame(some_texts(8, 30), DOCS), Scratch(spark))
    counts = wavelet._document_counts(shards, pa.array([b"a1", b"absent", b"the"], pa.large_binary()))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Generate" not in plan
    assert {r.term: r.df for r in counts.collect()} == {k: sum(w in words_of(t) for _, t in some_texts(8, 30)) for k, w in ((0, "a1"), (2, "the"))}
