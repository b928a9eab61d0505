"""Every operator and every stage on the same awkward tables: nulls in any column, repeated rows and ids, empty texts, no rows, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rectpart.llm import binpack, decontamination, html, jaccard, langid, maxscore, mixing, packing, quality, resampling, substrings, textops, toxicity, wavelet

PROSE = "The first line of this text says a thing or two, as lines of prose do, and it ends well.\nThe second line is another one with enough words to be kept by all rules, and it ends, too.\n"
ROWS = [(1, PROSE + "One.", "en", "a", 9), (1, PROSE + "One.", "en", "a", 9), (1, "Wholly unlike words, which are no copy of the others, stand under the same id here, in one long line of prose that ends as it should do.", "en", "a", None),
        (2, PROSE + "Two.", None, None, 1), (None, PROSE + "Null.", "de", "b", 2), (None, PROSE + "Null.", "de", "b", 2), (None, None, None, None, None), (3, None, "en", "a", 0), (4, "", "de", "b", 0), (5, " \t\n", "de", None, 3),
        (2**60, "x" * 3000 + " " + " ".join(f"word{k}" for k in range(3000)) + ".", "de", "b", 1), (-7, "Ein Satz mit Wörtern, ähnlich wie die anderen, aber nicht gleich, steht hier für sich allein und endet mit einem Punkt.", "de", "b", 5)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use or return.
CLASHING = ["th", "score", "row", "key", "n", "size", "copies", "component_id", "stays", "ids", "start", "kept", "_q", "batch", "salt", "vector", "rank", "cid", "stay", "toxic", "y", "k", "h", "grams", "bucket", "weight", "segment", "doc", "docs", "sizes", "terms", "items", "item", "first", "id"]


def ids_of(frame, name="doc_id"):
    return sorted(str(r[0]) for r in frame.select(name).collect())


def docs_of(spark, rows, clash):
    docs = spark.createDataFrame(rows, DOCS)
    return docs.withColumns({c: F.lit("!") for c in CLASHING}) if clash else docs


def labels_of(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (-7, 0), (2**60, 0), (None, 1), (1, 1)], "doc_id long, toxic int")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score_documents(d, toxicity.train(d, labels_of(s))),
    "packing": lambda s, d: packing.pack_documents(d).filter("start = 0"),
    "language": lambda s, d: langid.predict_languages(d, langid.train(d)),
    "substrings": lambda s, d: substrings.remove_repeats(d),
    "substrings carry": lambda s, d: substrings.remove_repeats(d, carry=True).select("row.doc_id"),
    "jaccard": lambda s, d: jaccard.near_duplicates(d),
    "quality": lambda s, d: quality.judged(d),
    "mixing": lambda s, d: mixing.copies_of(d),
    "mixing carry": lambda s, d: mixing.copies_of(d, carry=True).select("row.doc_id"),
    "matrices": lambda s, d: binpack.segments(binpack.pack_matrices(d)).filter("start = 0"),
    "resampling": lambda s, d: resampling.resample(d, d),
    "decontamination": lambda s, d: decontamination.decontaminate(d, d, item_col="doc_id"),
    "main text": lambda s, d: html.extract_pages(d.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"})).select(F.col("page_id").alias("doc_id")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_a_row_for_each_row(spark, name):
    """Every row counts once, with and without clashing columns; no rows give none."""
    for clash in (False, True):
        assert ids_of(OPERATORS[name](spark, docs_of(spark, ROWS, clash))) == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](spark, docs_of(spark, [], True)).count() == 0


def test_search_of_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [9.0, 9.0]), (50, None), (100, [None, 1.0]), (150, [float("inf")]), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (200, [])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumns({c: F.lit("!") for c in ("id", "v", "shard", "block", "score", "rank")})
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in maxscore.top_k(df, df.filter("vec_id % 50 = 0")).collect()]
    assert sorted(x[1:] for x in got if x[0] == 200) == [(1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 2, 0)]
    assert {x[0] for x in got} == {0, 200} and all((x[2], x[3]) in {(1, 5), (2, 5), (200, 0)} for x in got if x[0] == 0)


def test_ranking_of_awkward_rows(spark):
    """With and without clashing columns, the same rows."""
    found = [sorted(map(str, wavelet.ranked(d, d, 5, item_col="doc_id").collect())) for d in (docs_of(spark, ROWS, False), docs_of(spark, ROWS, True))]
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("clash", [False, True])
def test_stages(spark, tmp_path, clash):
    """Each stage on the awkward rows: columns stay, clean documents stay, unlike texts under one id stay, rows without an id stay."""
    docs = docs_of(spark, ROWS, clash)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for part, rows in (("some", ROWS), ("none", [])):
            out = stage(spark, docs_of(spark, rows, clash), str(tmp_path))
            out.write.parquet(f"{tmp_path}/{k}{part}")
            out = spark.read.parquet(f"{tmp_path}/{k}{part}")
            assert name == "packing" or out.columns == docs.columns
            assert part == "some" or out.count() == 0
            if part == "some" and name == "near_duplicates":
                kept = sorted(str(r.doc_id) for r in out.collect())
                assert kept == sorted(["1", "1", "3", "4", "5", "-7", str(2**60), "None", "None", "None"])
            if part == "some" and name == "repeated_passages":
                assert out.count() == len(ROWS)


def test_ties_between_rows_that_differ_elsewhere(spark):
    """Rows with one id and text but other columns: the same one stays, and the same copies are taken, however the rows are dealt."""
    rows = [(1, PROSE, x, s, k) for k, (x, s) in enumerate([("en", "a"), ("de", "a"), (None, "a"), ("fr", "a"), ("it", "a")])] + [(2, "Other words stand here, and none of them is above.", "en", "a", 1)]
    kept = [sorted(map(str, jaccard.one_of_each(spark.createDataFrame(part, DOCS).repartition(n)).collect())) for part, n in ((rows, 1), (rows[::-1], 4))]
    assert kept[0] == kept[1] and len(kept[0]) == 2
    taken = [sorted((r.copies, *r.row) for r in mixing.copies_of(spark.createDataFrame(part, DOCS).repartition(n).fillna("none"), carry=True).collect()) for part, n in ((rows, 1), (rows[::-1], 4))]
    assert taken[0] == taken[1]


def test_least_hashed_is_the_same_with_and_without_the_bound(spark):
    many = spark.range(5000).selectExpr("id k", "id % 3 y")
    want = sorted(many.withColumn("h", F.shiftrightunsigned(F.xxhash64("k"), 1)).collect(), key=lambda r: r.h)[:40]
    assert [r.k for r in textops.least_hashed(many, "k", 40)] == [r.k for r in want]
    assert [r.k for r in textops.least_hashed(many.unionAll(many), "k", 40)] == [r.k for r in want]
    same = spark.range(5000).selectExpr("id % 7 k")  # the bound leaves too few distinct rows
    assert len(textops.least_hashed(same, "k", 40)) == 7
