"""The stages on awkward rows, empty tables and names that clash."""

import pytest

from helpers import DOCS, awkward, frame, prose, widened

import random

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cases")
    bench = spark.createDataFrame([(1, "no id"), (2, None), (3, "")], "item_id long, text string")
    bench.write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def good(rng):
    return ". ".join(prose(rng, 12, 5000).capitalize() for _ in range(8))


def test_stages_take_awkward_rows_and_clashing_names(spark, folder):
    docs = widened(awkward(spark))
    kept = {name: stage(spark, docs, folder) for name, stage in pipeline.STAGES[:-1]}
    assert all(df.columns == docs.columns for df in kept.values())
    assert {name: df.count() for name, df in kept.items()} == {"quality rules": 0, "line dedup": 10, "n-gram Jaccard join": 8, "benchmark decontamination": 9}
    assert pipeline.STAGES[-1][1](spark, docs, folder).groupBy("doc_id", "piece").count().agg({"count": "sum"}).first()[0] >= 10


def test_stages_take_empty_tables(spark, folder):
    none = awkward(spark).limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_near_duplicates_go_by_row_and_not_by_id(spark, folder):
    """One doc_id on two texts, rows without doc_id, and rows that are repeated."""
    rng = random.Random(61)
    a, b, c, d = (good(rng) for _ in range(4))
    rows = [(5, a, "en", "x", 1), (7, a + " tail", "en", "x", 1), (7, b, "en", "x", 1), (None, c, "en", "x", 1), (None, c, "en", "x", 1), (None, c + " tail", "en", "y", 1), (9, d, "en", "x", 1), (9, d, "en", "x", 1), (9, None, "en", "x", 1), (9, None, "en", "x", 1)]
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), folder).collect()
    texts = [r.text for r in kept]
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id == 5) == [(5, a)]
    assert texts.count(b) == 1 and texts.count(a + " tail") == 0 and texts.count(d) == 1 and texts.count(None) == 2
    assert sum(t in (c, c + " tail") for t in texts) == 1 and len(kept) == 6


def test_leaks_go_by_row(spark, folder):
    docs = frame(spark, ["there is no id here", "nothing", None]).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars")
    assert sorted(str(r.text) for r in pipeline.decontamination(spark, docs, folder).collect()) == ["None", "nothing"]


def test_run_equals_the_stages(spark, folder, tmp_path):
    rng = random.Random(62)
    texts = [good(rng) for _ in range(60)] + ["short", None]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, texts[3])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(60)) - {3}
