import random

import pytest

from helpers import DOCS, prose
from test_packing import check, whole_ids

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(31)
    sentence = lambda: ". ".join(prose(rng, 12, 5000).capitalize() for _ in range(rng.randrange(10, 30)))
    rows = [[i, sentence(), "en", f"s{i % 9}", 0] for i in range(420)]
    items = [prose(rng, 20, 9000) for _ in range(3)]
    for i in range(10):
        rows[i][1] = rows[i][1].replace(" ", "### | ")  # symbols
        rows[10 + i][1] = "too short"
        rows[20 + i][1] += "\n" + items[i % 3]  # leaks
        rows[40 + i][1] = rows[30 + i][1] + " tail"  # near copies
    for i in range(50, 140):
        rows[i][1] = "all rights reserved by all\n" + rows[i][1]
    spark.createDataFrame([tuple(r) for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    good = set(range(20, 420))
    assert set(kept["quality rules"]) == good == set(kept["line dedup"])
    assert not any("all rights" in t for t in kept["line dedup"].values()) and kept["line dedup"][60] == rows[60][1].split("\n")[1]
    assert set(kept["n-gram Jaccard join"]) == good - set(range(40, 50))
    last = kept["benchmark decontamination"]
    assert set(last) == good - set(range(40, 50)) - set(range(20, 30))
    packed = pipeline.run(spark, str(tmp_path)).collect()
    check(packed)
    assert {r.doc_id for r in packed} == set(last) and sum(r.length for r in packed) == sum(map(len, whole_ids(last.values())))
