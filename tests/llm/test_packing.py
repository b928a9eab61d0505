"""Packing and matrices: exact round trips, little padding, and the ids of the public tokenizer library."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rectpart.llm import binpack, packing, tokens

TEXTS = ["", None, "One sentence. And another!\nA line", " lead", "trail ", "a  b", "x\n\ny", "tab\tbed   nbsp", "it's <|endoftext|> here", "<|endoftext|><|endoftext|> x<|endoftext|", "<|endoftext|>", "word " * 3000, "é ñ 漢字 🙂", "q" * 5000, "\n", " ", "same", "same"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(library):
    coder = tokens.Tokens(tokens.vocabulary_path())
    for texts in (TEXTS, TEXTS[::-1], TEXTS):  # again with words in the table
        ids, n = coder.encode_many(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab .\n'1é\t", "<|endoftext|>", "<|"]), max_size=30).map("".join), min_size=1, max_size=8))
def test_ids_of_any_text(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    ids, n = tokens.tokenizer(tokens.vocabulary_path()).encode_many(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def rows_of(spark, repeat=1):
    return spark.createDataFrame([(k, t, 7, "x") for k, t in enumerate(TEXTS)] * repeat, "doc_id long, text string, start int, ids string").coalesce(2)


def check_pieces(rows, library, width=1024):
    docs, windows = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    assert set(docs) == set(range(len(TEXTS)))
    for k, text in enumerate(TEXTS):
        want = [*library(text), 0]
        assert b"".join(x for _, x, _ in sorted(docs[k])) == np.array(want, "<u4").tobytes() and {n for *_, n in docs[k]} == {len(want)}
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= width


@pytest.mark.parametrize("width", [64, 1024])
def test_packing_loses_nothing(spark, library, width):
    check_pieces(packing.pack_documents(rows_of(spark), width=width).collect(), library, width)


def test_matrices_lose_nothing(spark, library):
    made = binpack.pack_matrices(rows_of(spark)).cache()
    check_pieces(binpack.segments(made).collect(), library)
    for m in made.collect():
        places, ids = np.frombuffer(m.positions, "<u4"), np.frombuffer(m.ids, "<u4")
        assert len(ids) == m.n_rows * m.width == m.cu_seqlens[-1] and m.cu_seqlens[0] == 0
        for a, b in zip(m.cu_seqlens, m.cu_seqlens[1:]):
            assert places[a:b].tolist() in (list(range(b - a)), [0] * (b - a)) and a // m.width == (b - 1) // m.width


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none).count() == 0 and binpack.pack_matrices(none).count() == 0


def test_null_ids_stay_null(spark, library):
    """A null id doesn't turn the others into doubles: ids over 2^53 keep their digits."""
    rows = [(None, "no id"), (2**53 + 1, "a large id"), (None, "q " * 3000), (-(2**60) - 1, "a small one"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted((str(k), len(library(t)) + 1) for k, t in rows)
    for pieces in (packing.pack_documents(docs), binpack.segments(binpack.pack_matrices(docs))):
        assert pieces.schema["doc_id"].dataType.simpleString() == "bigint"
        got = pieces.collect()
        assert sorted((str(r.doc_id), r.doc_tokens) for r in got if r.start == 0) == want
        assert sum(r.length for r in got) == sum(n for _, n in want)


def test_write_matrices(spark, tmp_path):
    binpack.write_matrices(binpack.pack_matrices(rows_of(spark)), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() >= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.sampled_from([0.0, 2.0, 5.0])), min_size=1, max_size=9))
def test_windows_are_the_cheapest(steps):
    width, ends, penalty = 20, np.cumsum([0, *(a for a, _ in steps)]), np.array([0.0, *(p for _, p in steps)])
    cuts = packing.windows(ends, penalty, width)
    cost = lambda c: sum(width - (b - a) + penalty[np.searchsorted(ends, b)] for a, b in zip(c, c[1:]))
    best = [0.0]
    for j in range(1, len(ends)):
        best.append(min(best[i] + width - (ends[j] - ends[i]) + penalty[j] for i in range(j) if ends[j] - ends[i] <= width))
    assert cuts[0] == 0 and cuts[-1] == ends[-1] and np.isclose(cost(cuts), best[-1])


def test_padding_is_small():
    rng = np.random.default_rng(1)
    sizes = rng.integers(5, 2500, 800)
    ids, ends = np.zeros(sizes.sum(), np.uint32), np.cumsum(sizes)
    sentence = rng.random(len(ids)) < 0.04
    bounds = packing.cut_run(ids, ends, sentence, 1024)
    n = np.diff(bounds)
    assert n.max() <= 1024 and bounds[-1] == len(ids)
    assert sum(1024 - x for x in n if x & (x - 1)) < 0.01 * len(ids)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 33), min_size=1, max_size=60))
def test_best_fit_decreasing(lengths):
    width, x = 33, np.array(lengths)
    row, offset, n = binpack.best_fit_decreasing(x, width)
    rooms, want = [], [0] * len(x)  # the definition: the fullest row that still has room
    for k in np.argsort(-x, kind="stable"):
        fits = [r for r in range(len(rooms)) if rooms[r] >= x[k]]
        r = min(fits, key=lambda r: rooms[r]) if fits else len(rooms)
        if not fits:
            rooms.append(width)
        rooms[r] -= x[k]
        want[k] = r
    assert n == len(rooms) and sorted(np.bincount(row, x)) == sorted(np.bincount(want, x))
    for r in range(n):
        mine = sorted((o, s) for o, s, q in zip(offset.tolist(), lengths, row.tolist()) if q == r)
        assert all(a + s == b for (a, s), (b, _) in zip(mine, mine[1:])) and mine[0][0] == 0
