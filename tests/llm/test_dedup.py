"""Repeated strings and near duplicates against brute force, with edge cases."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rectpart.llm import jaccard, substrings, suffixes, textops

SCHEMA = "doc_id long, text string, kept string, row string"  # extra columns with clashing names
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_like(rng, n, vocab=400):
    return " ".join(f"w{k}" for k in rng.integers(0, vocab, n))


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    docs, base = {}, [words_like(rng, int(n)) for n in rng.integers(3, 150, 12)]
    passage = words_like(rng, 60, 5000)
    for k in range(70):
        parts = base[int(rng.integers(0, len(base)))].split(" ")
        for _ in range(int(rng.integers(0, 4))):
            parts[int(rng.integers(0, len(parts)))] = "changed"
        text = " ".join(parts)
        if k % 5 == 0:
            text = f"{text}\n{passage} é€𝄞 {text[:40]}"
        docs[k] = text
    docs |= {100: None, 101: "", 102: "  \t\n", 103: "one", 104: "ONE", 105: "x" * 49, 106: "x" * 50, 107: "x" * 51, 108: "y" * 30000, 109: "y" * 20000, 110: "a b c d", 111: "A  b\tc d"}
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "k", "r") for k, t in docs.items()], SCHEMA)


def spans_of(b, runs):
    return b"".join(b[x:y] for x, y in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(b)]))


def check_substrings(rows, docs):
    raw = {k: (t or "").encode() for k, t in docs.items()}
    want = substrings.covered_brute(raw)
    got = {r.doc_id: r for r in rows}
    assert set(got) == set(docs)
    for k, runs in want.items():
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw[k]), sum(e - s for s, e in runs), len(runs))
        assert hashlib.sha256(r.kept).digest() == hashlib.sha256(spans_of(raw[k], runs)).digest()


@pytest.mark.parametrize("batch", [2_000, 10**7])
def test_substrings(spark, monkeypatch, batch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", batch)
    docs = corpus()
    check_substrings(substrings.remove_repeats(frame(spark, docs)).collect(), docs)


def test_substrings_carry_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substrings.remove_repeats(empty).count() == 0
    docs = corpus(2)
    got = substrings.remove_repeats(frame(spark, docs), carry=True)
    assert got.count() == len(docs) and {r.k for r in got.select("row.kept").withColumnRenamed("kept", "k").collect()} == {"k"}


def test_only_stretches_with_others_of_their_anchor_are_sent():
    """Copies in any number of batches cost a hash; bytes are asked for where an anchor has different stretches."""
    keys, counts, docs = np.array([5, 5, 5, 6, 6, 6, 7]), np.full(7, 9), np.array([3, 1, 2, 4, 4, 9, 1])
    hashes = np.array([11, 11, 11, 12, 12, 13, 14], np.uint64)
    assert substrings.states(keys, counts, docs, hashes).tolist() == [1, 0, 1, 2, 2, 2, 0]


def test_anchors_do_not_recur_by_chance():
    """Prose of a few words: its grams recur in other texts, the more so the larger the table, but what is sent of it may not."""
    rng = np.random.default_rng(7)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 9, 150)]
    texts = [" ".join(words[k] for k in rng.integers(0, 150, 400)) for _ in range(200)]
    several = substrings.Batch(pa.table({"doc_id": range(200), "text": texts}), 128).several()
    assert len(several) > 10_000 and several.mean() < 0.001


def test_copies_are_told_by_whole_texts():
    """Of a text, the smallest document of the batch stays, and its repeats; the rest goes, and all go where another batch has a smaller one. Short texts can't be covered."""
    long, other, short = "a long text " * 9, "another text " * 9, "short"
    x = substrings.Texts(pa.table({"doc_id": pa.array([5, 3, 3, None, 9, 1, 2]), "text": [long, long, long, long, other, short, short]}), 4)
    assert len(x.keys) == 2 and sorted(x.least.tolist()) == [3, 9]
    assert x.copies({}).tolist() == [True, False, False, True, False, False, False]
    marks = {bucket: np.packbits(x.least[a:b] == 3).tobytes() for bucket, a, b in x.by_bucket()}
    assert x.copies(marks).tolist() == [True, True, True, True, False, False, False]


def test_substrings_batches_of_copies(spark, monkeypatch):
    """Batches with nothing but copies, beside texts that share a passage with them."""
    monkeypatch.setattr(substrings, "BATCH_BYTES", 400)
    docs = corpus(4)
    docs |= {k + 1000 * j: docs[k] for k in range(40) for j in (1, 2)} | {-7: docs[31], 5000: "before " + docs[5][:90] + " after"}
    check_substrings(substrings.remove_repeats(frame(spark, docs).repartition(5)).collect(), docs)


def test_substrings_rows_with_one_id_in_many_batches(spark, monkeypatch):
    """Rows with one id and different texts lose alike what a smaller document covers in a stretch that they share."""
    monkeypatch.setattr(substrings, "BATCH_BYTES", 300)
    rng = np.random.default_rng(5)
    base = "".join(map(chr, rng.integers(97, 123, 400)))
    docs = [(1, base[:230]), *((7, f"{k}" * 90 + base[100:400]) for k in range(4))]
    got = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), *[(7, 130)] * 4]


def test_substrings_repeated_rows_and_null_ids(spark):
    text = "z" + "q" * 80
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    assert sorted(((r.doc_id or 99), r.n_removed) for r in substrings.remove_repeats(rows).collect()) == [(1, 0), (1, 0), (2, 81), (99, 81)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=200), st.integers(1, 40))
def test_least_of_neighbours(values, n):
    a = np.array(values, np.uint64)
    if n <= len(a):
        assert substrings._least(a, n).tolist() == [int(a[i : i + n].min()) for i in range(len(a) - n + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.text("ab\x00", max_size=40)), max_size=8))
def test_suffix_order(strings):
    strings = sorted(strings, key=lambda x: x[0])
    size = np.array([len(t) for _, t in strings], np.int64)
    raw, start = "".join(t for _, t in strings).encode(), np.cumsum(size) - size
    got = suffixes.suffix_order(np.frombuffer(raw, np.uint8), start, size, np.array([k for k, _ in strings], np.int64))
    want = sorted((k, raw[p : a + n], a, p) for (k, _), a, n in zip(strings, start.tolist(), size.tolist()) for p in range(a, a + n))
    assert got.tolist() == [p for *_, p in want]


def test_resolve_takes_the_smallest_document():
    """Stretches of one anchor that share windows at different places, one of them repeated within itself."""
    rng = np.random.default_rng(3)
    base = rng.integers(97, 123, 84).astype(np.uint8)
    parts = [(7, base[:70]), (3, base[5:80]), (9, base[10:84]), (3, base[20:75]), (1, rng.integers(97, 123, 60).astype(np.uint8)), (2, np.full(60, 97, np.uint8))]
    content, counts = np.concatenate([b for _, b in parts]), np.array([len(b) - substrings.SPAN + 1 for _, b in parts])
    masks = substrings.resolve(np.zeros(len(parts), np.int64), counts, np.array([d for d, _ in parts]), content)
    first = {}
    for d, b in parts:
        for i in range(len(b) - substrings.SPAN + 1):
            w = b[i : i + substrings.SPAN].tobytes()
            first[w] = min(d, first.get(w, d))
    want = [sum((first[b[i : i + substrings.SPAN].tobytes()] < d) << i for i in range(len(b) - substrings.SPAN + 1)) for d, b in parts]
    assert masks.tolist() == want


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_brute(docs):
    sets, root = {k: shingles(t) for k, t in docs.items()}, {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in docs}


@pytest.mark.parametrize("seed", [1, 5])
def test_near_duplicates(spark, seed):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, docs)).collect()}
    assert got == components_brute(docs)


def test_near_duplicates_of_many_near_copies(spark):
    """A large group of which only some pairs link, so that later candidates count; the bitmaps never differ in more bits than the sets do in shingles."""
    rng = np.random.default_rng(8)
    base, docs = words_like(rng, 150, 10**6).split(), {}
    for k in range(120):
        own = list(base)
        for at in rng.integers(0, len(own), int(rng.integers(1, 9))):
            own[int(at)] = f"z{int(rng.integers(0, 3))}"
        docs[k] = " ".join(own)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, docs)).collect()}
    assert got == components_brute(docs)
    sets = []
    for k in range(20):
        sets.append(np.unique(jaccard.shingle_hashes(*textops.buffers(pa.array([docs[k]])))[0]))
    for a in sets:
        for b in sets:
            bits = np.unpackbits((jaccard.bitmap(a) ^ jaccard.bitmap(b)).view(np.uint8)).sum()
            assert bits <= len(np.setxor1d(a, b))


def near_copies(seed: int, n: int) -> dict[int, str]:
    rng = np.random.default_rng(seed)
    base, docs = words_like(rng, 150, 10**6).split(), {}
    for k in range(n):
        own = list(base)
        for at in rng.integers(0, len(own), int(rng.integers(1, 9))):
            own[int(at)] = f"z{int(rng.integers(0, 3))}"
        docs[k] = " ".join(own)
    return docs


def test_blocks_of_lists_and_copies_of_hubs_only_place_work(spark, monkeypatch):
    docs = near_copies(11, 60) | {k + 100: text for k, text in near_copies(12, 30).items()}
    monkeypatch.setattr(jaccard, "ROWS_PER_BLOCK", 7)
    monkeypatch.setattr(jaccard, "PAIRS_PER_COPY", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, docs)).collect()}
    assert got == components_brute(docs)


def test_pairs_are_verified_at_their_hub(spark, monkeypatch):
    """Every pair is tested once, at the class with more pairs; a hub's pairs are dealt over salts."""
    monkeypatch.setattr(jaccard, "PAIRS_PER_COPY", 10)
    docs = {k: f"a b c d e f g h i j {'x' if k % 2 else 'k'}" for k in range(40)}
    pairs = [(0, k) for k in range(1, 40)] + [(38, 39)]
    turned = jaccard.oriented(spark.createDataFrame(pairs, "a long, b long"))
    placed = [(r.hub, r.salt, r.leaf) for r in turned.collect()]
    assert {(min(h, x), max(h, x)) for h, _, x in placed} == set(pairs) and len(placed) == len(pairs)
    assert sum(h == 0 for h, _, _ in placed) == 39 and {s for h, s, _ in placed if h == 0} <= set(range(4)) and len({s for h, s, _ in placed if h == 0}) > 1
    texts = spark.createDataFrame(list(docs.items()), "cid long, text string")
    got = {(r.a, r.b): r.linked for r in jaccard.verified(turned, texts).collect()}
    # 7 shingles each, 6 in common unless equal: 6 / 8 is below 0.8
    assert got == {(a, b): docs[a] == docs[b] for a, b in pairs}
    assert jaccard.verified(turned.limit(0), texts).count() == 0


def test_near_duplicates_on_the_border(spark):
    """Sets of 9 with 8 in common link at 0.8 = 8 / 10; of 8 with 7 in common they don't."""
    rng = np.random.default_rng(4)
    w, v = words_like(rng, 13, 10**6).split(), words_like(rng, 12, 10**6).split()
    docs = {1: " ".join(w), 2: " ".join([*w[:-1], "z"]), 3: " ".join(v), 4: " ".join([*v[:-1], "z"]), 5: " ".join(w).upper()}
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame(spark, docs)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}


def test_near_duplicates_edge_cases(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (7, "a b  c"), (None, "a b c"), (8, None), (9, "")], "doc_id long, text string")
    got = sorted(((r.doc_id or 99), r.n_shingles, r.component_id or 99) for r in jaccard.near_duplicates(rows).collect())
    assert got == [(3, 1, 3), (3, 1, 3), (7, 1, 3), (8, 0, 8), (9, 0, 9), (99, 1, 99)]


def test_near_duplicates_of_one_id_with_unlike_texts(spark):
    """Each text has its own links, and each component keeps one text; copies of rows are one."""
    rng = np.random.default_rng(9)
    one, two = (words_like(rng, 40, 10**6) for _ in range(2))
    rows = spark.createDataFrame([(5, one, "a"), (5, two, "b"), (5, two, "c"), (6, one + " x", "d"), (7, "y " + two, "e"), (None, one, "f"), (8, None, "g"), (8, "", "h")], "doc_id long, text string, th string")
    got = sorted((r.doc_id or 99, r.n_shingles, r.component_id or 99) for r in jaccard.near_duplicates(rows).collect())
    assert got == [(5, 36, 5)] * 3 + [(6, 37, 5), (7, 37, 5), (8, 0, 8), (8, 0, 8), (99, 36, 99)]
    kept = jaccard.one_of_each(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id or 99, r.text or "", r.th in "bc") for r in kept.collect()) == sorted([(5, one, False), (5, two, True), (8, "", False), (8, "", False), (99, one, False)])


def test_one_of_each_of_an_empty_table(spark):
    assert jaccard.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_sketch_only_orders(spark, monkeypatch):
    """Any number of cells gives the same components, and long lists may be dealt over salts."""
    docs = corpus(3)
    for bits, salt in ((5, 3), (22, 100_000)):
        monkeypatch.setattr(jaccard, "LEAST_BITS", bits)
        monkeypatch.setattr(jaccard, "ROWS_PER_SALT", salt)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, docs)).collect()}
        assert got == components_brute(docs)


def test_words_split_at_rows():
    data = np.frombuffer(b"ab cd\tef", np.uint8)
    starts, ends, before = textops.words(data, np.array([0, 1, 1, 8]))
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [b"a", b"b", b"cd", b"ef"] and before.tolist() == [0, 1, 1, 4]
