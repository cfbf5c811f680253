import random
import re

import pytest

from helpers import awkward, frame, prose, widened

near = pytest.importorskip("chronoscape.llm.near_duplicates")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 75 * (len(a) + len(sets[j]) - n):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in enumerate(sets)}


def varied(rng, text, n):
    w = text.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], ["new" + str(rng.randrange(99))], [w[i], "more"]])
    return " ".join(w)


def corpus(rng):
    common = prose(rng, 25)
    texts = [prose(rng, rng.randrange(0, 80)) for _ in range(80)] + [f"{prose(rng, 20)} {common} {prose(rng, 20)}" for _ in range(60)]
    for base in [prose(rng, rng.randrange(6, 120)) for _ in range(15)]:
        texts += [varied(rng, base, rng.randrange(5)) for _ in range(rng.randrange(2, 12))]
    seed = prose(rng, 200)  # a chain of texts, each near the one before only
    for _ in range(30):
        texts.append(seed)
        seed = varied(rng, seed, 3)
    texts += [" ".join(prose(rng, 60).split()[:n]) for n in (1, 2, 4, 5, 5, 6)] + ["a b", "A  b\n", "a b c", "", " ", None] + texts[:10]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,options", [(21, {}), (22, {"local_df": 1, "heavy": 50})])
def test_equals_brute_force(spark, seed, options):
    texts = corpus(random.Random(seed))
    got = {tuple(r) for r in near.near_duplicates(frame(spark, texts).repartition(5), **options).collect()}
    assert got == brute(texts)


def test_equal_prefixes_with_different_members(spark, monkeypatch):
    monkeypatch.setattr(near, "order_prefix", lambda s, token, df: (s[:1], 0))  # groups of many members that do not link
    texts = ["a b c d e " + prose(random.Random(k), 3) for k in range(6)] * 2
    got = {tuple(r) for r in near.near_duplicates(frame(spark, texts)).collect()}
    assert {r[0] for r in got} == set(range(12)) and all(r[2] == r[0] % 6 for r in got)


def test_histograms_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(24)
    ruled_out = 0
    for _ in range(400):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, int(rng.integers(0, n + 1))).astype(np.uint64))))
        may = near.may_link(near.histogram(a), len(a), near.histogram(b), len(b)) if len(b) else False
        assert may or not near.linked(a, b)
        ruled_out += not may
    assert ruled_out > 100


def test_keep_first_and_awkward_rows(spark):
    docs = widened(awkward(spark))
    got = near.near_duplicates(docs).collect()
    assert len(got) == 10 and {r.component_id for r in got if r.doc_id == 4} == {4} and next(r for r in got if r.doc_id == 5).n_shingles == 1
    texts = corpus(random.Random(23))
    kept = {r.doc_id for r in near.keep_first(frame(spark, texts)).collect()}
    assert kept == {c for *_, c in brute(texts)}
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_what_tells_of_a_list_is_written_once(spark, monkeypatch):
    """In the first row of each list only: a list's sums in all of its rows took most of that table."""
    rng, kept = random.Random(91), {}
    base = [prose(rng, 60, 5000) for _ in range(20)]
    texts = [f"{b} end{i}" for b in base for i in range(6)]
    write = near.materialize
    monkeypatch.setattr(near, "materialize", lambda df, name: kept.setdefault(name, write(df, name)) if name == "near-shared" else write(df, name))
    monkeypatch.setattr(near, "drop_table", lambda *tables: None)
    got = near.near_duplicates(frame(spark, texts), local_df=1000).collect()  # no shingle is known as frequent
    assert all(r.component_id == r.doc_id // 6 * 6 for r in got)
    rows = kept["near-shared"].collect()
    assert len(rows) > len({r.token for r in rows}) > 0
    assert sum(r.n is not None for r in rows) == len({r.token for r in rows})
