import hashlib
import random

import numpy as np
import pytest

from helpers import awkward, frame, widened

suffix_dedup = pytest.importorskip("chronoscape.llm.suffix_dedup")


def brute(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    count = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
    out = []
    for d, r in enumerate(raws):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(b for b, g in zip(r, gone) if not g)
        out.append((d, len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def text(rng, n):
    return "".join(rng.choice("abcdeé \n") for _ in range(n))


def corpus(rng):
    shared = [text(rng, n) for n in (150, 190, 200, 210, 400, 1500)]
    texts = [text(rng, rng.randrange(0, 900)) for _ in range(30)]
    for _ in range(40):
        parts = [text(rng, rng.randrange(0, 300))]
        for _ in range(rng.randrange(1, 4)):
            s = rng.choice(shared)
            a = rng.randrange(0, max(1, len(s) // 3))
            parts += [s[a : len(s) - rng.randrange(0, len(s) // 3)], text(rng, rng.randrange(0, 120))]
        texts.append("".join(parts))
    return texts + ["a" * 700, "xyz" * 200, "q" + "a" * 250, texts[3], texts[40], texts[40] + "!", "", None, "ab" * 99, text(rng, 199)]


@pytest.mark.parametrize("seed,bucket", [(41, 4_096), (42, 2), (45, 6)])
def test_equals_brute_force(spark, seed, bucket):
    texts = corpus(random.Random(seed))
    docs = frame(spark, texts).repartition(3)
    got = suffix_dedup.remove_repeats(docs, suffix_dedup.repeated_spans(docs, bucket_rows=bucket)).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute(texts)


def test_long_texts_are_taken_in_parts(monkeypatch):
    rng = np.random.default_rng(43)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = suffix_dedup.anchors_of(data, np.array([0, len(data)]))[0]
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    parts = [at + b for b, o, d in suffix_dedup.parts_of(np.array([0, len(data)]), data) for at in [suffix_dedup.anchors_of(d, o)[0]]]
    assert set(np.concatenate(parts)) == set(whole)


def test_an_anchor_of_two_parts_counts_once(spark, monkeypatch):
    rng = random.Random(44)
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    texts = [text(rng, 6000), text(rng, 3000), text(rng, 500)]
    texts.append(texts[0][2000:2900] + text(rng, 2500))
    docs = frame(spark, texts)
    seen = suffix_dedup.anchors(docs).select("doc_id", "pos").collect()
    assert len(seen) == len(set(seen))
    got = suffix_dedup.remove_repeats(docs, suffix_dedup.repeated_spans(docs)).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute(texts)


def test_awkward_rows(spark):
    docs = widened(awkward(spark))
    got = suffix_dedup.remove_repeats(docs, suffix_dedup.repeated_spans(docs)).collect()
    assert len(got) == 10 and all(r.n_removed == r.n_bytes for r in got if r.doc_id in (4, 7)) and all(r.n_removed == 0 for r in got if r.doc_id not in (4, 7))
    none = docs.limit(0)
    assert suffix_dedup.remove_repeats(none, suffix_dedup.repeated_spans(none)).count() == 0


def test_a_common_passage_is_not_split_to_single_places(spark, monkeypatch):
    """Runs of places that all contexts of a bucket share are settled whole, so rows stay few at every width."""
    rng = random.Random(46)
    common = text(rng, 500)
    texts = [text(rng, rng.randrange(160, 300)) + common + text(rng, rng.randrange(160, 300)) for _ in range(60)]
    rows, split = [], suffix_dedup.split

    def counted(contexts, width):
        got = split(contexts, width)
        rows.append((contexts.count(), got.count()))
        return got

    monkeypatch.setattr(suffix_dedup, "split", counted)
    docs = frame(spark, texts)
    got = suffix_dedup.remove_repeats(docs, suffix_dedup.repeated_spans(docs, bucket_rows=10)).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute(texts)
    assert len(rows) > 4 and max(made for _, made in rows) <= 3 * rows[0][0]


def test_texts_without_repeats_are_not_shuffled(spark):
    rng = random.Random(46)
    alone = [text(rng, 600) for _ in range(300)]
    both = alone[0][:450] + alone[1][:450]
    texts = [*alone, both, both + "!", None, ""]
    docs = frame(spark, texts).repartition(3)
    found = suffix_dedup.repeated_spans(docs, most_bytes=0)
    base = docs.select(*suffix_dedup.text_key())
    kept = suffix_dedup.may_hold(base, "text_hash", found, "text_hash").where("may_hold")
    assert found.count() <= kept.count() < 100
    got = suffix_dedup.remove_repeats(docs, found, most_bytes=0).drop("kept")
    assert "_bits#" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == brute(texts)


@pytest.mark.parametrize("most", [15, 26])
def test_no_key_is_missed(spark, most):
    ids = spark.range(60_000).selectExpr("xxhash64(id) as h", "id")
    marked = suffix_dedup.may_hold(ids, "h", ids.where("id % 20 = 0"), "h", most)
    assert marked.where("id % 20 = 0 and not may_hold").isEmpty() and marked.count() == 60_000
    assert marked.where("id % 20 > 0 and may_hold").count() < (10_000 if most == 26 else 57_000)
