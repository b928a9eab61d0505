"""The pipeline's stages on a small corpus: each does its work on all that its predecessor kept."""

import numpy as np
import pytest

import corpus_pipeline
from rectpart.llm import queries, substrings
from tests.llm.test_dedup import components_brute, spans_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    line = lambda: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(12)) + "."
    texts = {k: "\n".join(line() for _ in range(int(rng.integers(3, 9)))) for k in range(40)}
    shared = line() + " " + line()
    texts |= {k: texts[k] + "\n" + shared for k in (3, 9, 20)}
    texts |= {100: texts[1], 101: texts[2] + " extra", 102: "too short", 103: None, 104: "Home | About | News\n" * 20, 105: texts[5] + "\nAll rights reserved."}
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(k, t, "en", f"s{k % 4}", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    states = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        states.append([r.asDict() for r in docs.collect()])
    quality, unique, cut, mixed, packed = states
    kept = {r["doc_id"]: r["text"] for r in quality}
    assert set(kept) == set(range(40)) | {100, 101, 105} and "rights" not in kept[105]
    groups = components_brute(kept)
    assert {r["doc_id"]: r["text"] for r in unique} == {k: t for k, t in kept.items() if groups[k][1] == k}
    raw = {r["doc_id"]: r["text"].encode() for r in unique}
    want = {k: spans_of(raw[k], runs).decode() for k, runs in substrings.covered_brute(raw).items()}
    assert {r["doc_id"]: r["text"] for r in cut} == want and all(r["n_chars"] == len(r["text"]) for r in cut)
    times = {r["doc_id"]: 0 for r in cut}
    for r in mixed:
        times[r["doc_id"]] += 1
        assert r["text"] == want[r["doc_id"]]
    assert max(times.values()) <= 3 and len(mixed) == sum(times.values())
    starts = {k: sum(p["start"] == 0 for p in packed if p["doc_id"] == k) for k in times}
    assert starts == times


def test_run_is_the_registered_query(spark, folder):
    assert queries.queries()["pipeline"](spark, folder).count() > 0


def test_rows_without_an_id_reach_the_last_stage(spark, folder, tmp_path):
    """A null id beside others: the document is packed, with its id null, and the other ids are whole."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 20")
    lone = docs.filter("doc_id = 7").selectExpr("CAST(NULL AS BIGINT) doc_id", "'This text without an id is long enough for all of the rules, since it has more than twenty words, which end with a full stop.' text", "lang", "source", "n_chars")
    docs.unionByName(lone).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.schema["doc_id"].dataType.simpleString() == "bigint"
    ids = {r.doc_id for r in out.collect()}  # the mix leaves some documents out
    assert None in ids and len(ids) > 5 and ids <= {None, *range(20)}


def test_every_operator_has_a_query():
    names = queries.queries()
    assert "pipeline" in names and {n[2:].split("_")[0] for n in names if n.startswith("op")} == {str(k) for k in range(1, 14)}
