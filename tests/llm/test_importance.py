import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, frame, prose, widened

from chronoscape.llm.importance import _rows, crc32, csr_blocks, drawn, ranked, resample


def brute(texts, target, share=(10, 100), min_words=20, ngram=1, buckets=10_000, seed="2024"):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [zlib.crc32(" ".join(ws[i : i + m]).encode()) % buckets for m in range(1, ngram + 1) for i in range(len(ws) - m + 1)], len(ws)

    s, t = np.zeros(buckets), np.zeros(buckets)
    for x in texts.values():
        np.add.at(s, features(x)[0], 1)
    for x in target:
        np.add.at(t, features(x)[0], 1)
    out, fit = {}, []
    for k, x in texts.items():
        fs, n = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in fs)
        h = int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:8], 16)
        out[k] = [len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None]
        if n >= min_words:
            fit.append((-out[k][2], k))
    for place, (_, k) in enumerate(sorted(fit)[: share[0] * len(fit) // share[1]], 1):
        out[k][3] = place
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in df.collect()}


@pytest.mark.parametrize("ngram", [1, 3])
def test_equals_brute_force(spark, ngram):
    rng = random.Random(3)
    texts = {i: prose(rng, rng.choice([0, 3, 25, 80]), 60).replace("w1", "É-Wé").replace("w2", "A9\x00z") for i in range(150)}
    texts[200] = texts[201] = "the same words again and again " * 10
    target = [prose(rng, 40, 30) for _ in range(5)] + [None, ""]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert result(resample(docs, aim, ngram=ngram)) == brute(texts, [t for t in target if t], ngram=ngram)
    assert result(resample(docs, aim, share=(1, 2), min_words=1, buckets=17, seed="x")) == brute(texts, [t for t in target if t], (1, 2), 1, 1, 17, "x")


@pytest.mark.parametrize("ngram", [1, 2, 3])
def test_long_texts_are_cut_between_words(ngram):
    rng = random.Random(5)
    texts = [prose(rng, 900) + " " * 300 + "x" * 1000 + " " + prose(rng, 50), "y" * 700, "a b", None, prose(rng, 400, 10)]
    column = pa.array(texts)
    whole, cut = list(_rows(column, ngram, 1000, 1 << 20)), list(_rows(column, ngram, 1000, 100))
    assert len(whole) == 1 and len(cut) > 1
    base, got = 0, []
    for w, row, at, n in cut:
        got += [(int(r) + base, int(b), int(c)) for r, b, c in zip(row, at, n)]
        base += len(w)
    assert got == [tuple(map(int, x)) for x in zip(*whole[0][1:])]
    assert list(np.concatenate([w for w, *_ in cut])) == list(whole[0][0])


def test_crc_of_slices():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    starts = np.array([0, 5, 5, 100, 0, 4999])
    ends = np.array([3, 5, 69, 1100, 5000, 5000])
    assert [int(x) for x in crc32(data, starts, ends)] == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


def test_blocks_hold_every_row_in_order(spark):
    rng = random.Random(9)
    docs = frame(spark, [prose(rng, rng.randrange(60)) for _ in range(120)]).coalesce(1)
    blocks = csr_blocks(docs, entries=300, piece=500).collect()
    assert len(blocks) > 5 and [i for b in blocks for i in b.doc_id] == list(range(120))
    for b in blocks:
        ptr, count = np.frombuffer(b.indptr, "<i8"), np.frombuffer(b.counts, "<i8")
        assert len(ptr) == len(b.doc_id) + 1 and ptr[-1] == len(count) == len(b.indices) // 4
        assert [int(count[i:j].sum()) for i, j in zip(ptr, ptr[1:])] == list(b.n_features)


def test_ranks_are_gapless_over_parts(spark):
    from pyspark.sql import functions as F

    scored = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(7).alias("score"), (F.col("id") % 3 > 0).alias("fit"), F.col("id").alias("row"))
    assert [r.doc_id for r in ranked(scored).where("fit").orderBy("rank").collect()] == [i for i in range(5000) if i % 3]


def test_draws_what_looks_like_the_target(spark):
    rng = random.Random(2)
    docs = frame(spark, [prose(rng, 50, 300) if i % 10 else " ".join(f"t{rng.randrange(40)}" for _ in range(50)) for i in range(400)])
    aim = spark.createDataFrame([(" ".join(f"t{rng.randrange(40)}" for _ in range(200)),)], "text string")
    got = [r.doc_id for r in drawn(docs, aim).collect()]
    assert len(got) == 40 and all(i % 10 == 0 for i in got)


def test_awkward_rows(spark):
    docs = awkward(spark)
    aim = spark.createDataFrame([("one lorem",), (None,)], "text string")
    rows = resample(docs, aim, min_words=1, share=(1, 1)).collect()
    assert len(rows) == docs.count()
    assert {(r.n_features, r.weight) for r in rows if r.doc_id in (1, 2, 3)} == {(0, 0)}
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 8))
    assert result(resample(widened(docs), aim)) == result(resample(docs, aim))
    assert resample(docs.limit(0), aim).count() == 0
    assert resample(docs, aim.limit(0)).count() == docs.count()
