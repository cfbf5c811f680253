import random

import numpy as np
import pytest
from helpers import widened

from chronoscape.llm import hard_negatives as hn
from chronoscape.llm.common import materialize

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, low=80, k=5, every=100):
    kept = []
    for vec_id, e, label in rows:
        if vec_id is None or label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        kept.append((vec_id, [int(np.floor(256 * float(np.float32(x)))) for x in e], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, (a, q, la) in enumerate(kept):
        if a % every:
            continue
        score = [sum(x * y for x, y in zip(q, s)) for _, s, _ in kept]
        order = sorted((j for j in range(len(kept)) if j != i), key=lambda j: (-score[j], kept[j][0]))
        for p in [j for j in order if kept[j][2] == la][:k]:
            good = [j for j in order if kept[j][2] != la and low * score[p] <= 100 * score[j] <= 100 * score[p]][:k]
            out += [(a, kept[p][0], n, kept[j][0], score[p], score[j]) for n, j in enumerate(good, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in hn.hard_negatives(df, **options).collect())


def clustered(seed, n=1500, dim=8, clusters=12, ties=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    v = centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim)) * 0.15
    if ties:
        v = np.round(v * 2) / 2
    return [(int(i), [float(x) for x in np.float32(row)], int(rng.integers(4))) for i, row in enumerate(v)]


@pytest.mark.parametrize("ties", [False, True])
def test_equals_brute_force(spark, monkeypatch, ties):
    monkeypatch.setattr(hn, "PER_PIVOT", 4)
    rows = clustered(1, ties=ties)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, every=10)
    assert len(want) > 500 and mined(df, anchor_every=10) == want


def test_parts_and_slices_change_nothing(spark, monkeypatch):
    rows = clustered(2, n=600)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, every=10, k=3)
    monkeypatch.setattr(hn, "PER_PIVOT", 15)
    monkeypatch.setattr(hn, "ANCHORS", 5)
    monkeypatch.setattr(hn, "ROWS", 50)
    assert mined(df, anchor_every=10, positives_k=3, negatives_k=3) == want


def test_bounds_rule_rows_out(spark, monkeypatch):
    """Where vectors form clusters, groups get a part of the rows only."""
    monkeypatch.setattr(hn, "PER_PIVOT", 10)
    rng = np.random.default_rng(4)
    centres = np.eye(12) * 3
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=12) * 0.02], int(i % 3)) for i in range(2400)]
    base = materialize(hn.prepare(spark.createDataFrame(rows, SCHEMA), anchor_every=10), "t")
    space = hn.fit_space(base)
    assert len(space.pivots) == 24
    reach = hn.reach_by_label(hn.placed(base, space), space, 5).collect()
    least = np.array([np.frombuffer(r.least, "<f8") for r in sorted(reach, key=lambda r: r.label)])
    v = base.select("label", "vec").collect()
    score = space.augment(np.array([r.vec for r in v]), False) @ space.pivots.T
    sent = score >= least[[r.label for r in v]]
    assert sent.mean() < 0.25 < 0.99 < sent.any(1).mean() + 0.5
    want = [r for r in brute(rows, every=10)]
    assert mined(spark.createDataFrame(rows, SCHEMA), anchor_every=10) == want


def test_awkward_rows(spark):
    rng = random.Random(7)
    vec = lambda n=4: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(i, vec(), i % 3) for i in range(300)]
    rows += [(None, vec(), 1), (1000, None, 1), (1100, vec(), None), (1200, [1.0, None, 0.0, 0.0], 1), (1300, [float("nan")] * 4, 1), (1400, [float("inf")] * 4, 2)]
    rows += [(1500, vec(2), 1), (1600, [], 2), (1700, vec(7), 0), (1900, [0.0] * 4, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df) == brute(rows)
    assert mined(widened(df)) == brute(rows)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id % 100 > 0")) == []
    assert mined(spark.createDataFrame([(0, [], 1), (1, [], 1), (2, [], 2)], SCHEMA)) == brute([(0, [], 1), (1, [], 1), (2, [], 2)])


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0], 1)] * 2 + [(3, [1.0, 0.0], 2)] * 3 + [(5, [0.5, 0.5], 1)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_large_components_stay_whole(spark):
    rows = [(i, [float(10**5 + i), 3e38 if i == 7 else 1.0], i % 2) for i in range(20)]
    got = mined(spark.createDataFrame(rows, SCHEMA))
    assert got and all(80 * p <= 100 * n <= 100 * p for *_, p, n in got)
