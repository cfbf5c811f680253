import random
import re

import numpy as np
import pytest

from helpers import DOCS, awkward, frame, prose, widened

quality = pytest.importorskip("chronoscape.llm.quality")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + d for i, x in enumerate(tri) if tri.count(x) > 1 for d in range(3)}
    lines = t.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_counts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", "é", " ", "\n", "\t", "#", "|", "x y z ", "\x1c", "\xa0"]) for _ in range(rng.randrange(120))) for _ in range(60)] + [None, "", "a a a a", "\n\n", "x\nx\n x\nx "]
    got = quality.text_stats(frame(spark, texts)).collect()
    for r in got:
        assert tuple(r)[1:6] == brute(texts[r.doc_id]), texts[r.doc_id]


def rows(rng, n, bad):
    out = []
    for i in range(n):
        t = ". ".join(prose(rng, 12, 3000).capitalize() for _ in range(rng.randrange(8, 40)))
        if i < bad:
            t = re.sub(r" ", "### | ", t) if i % 2 else t.upper().replace(" ", "!! ")
        out.append((i, t, "en", f"s{i % 2}", 0))
    return out


def test_planted_outliers_go_and_clean_rows_stay(spark):
    found = quality.quality_rules(spark.createDataFrame(rows(random.Random(5), 600, 80), DOCS)).collect()
    assert {r.doc_id for r in found if not r.kept} == set(range(80))


def test_fit_equals_numpy():
    x = np.random.default_rng(6).normal(size=(50, quality.P))
    mean, inv, det = quality._invert(np.array([50.0]), x.sum(0)[None], np.array([[(x[:, i] * x[:, j]).sum() for i, j in quality.PAIRS]]))
    cov = np.cov(x.T, bias=True) + quality.RIDGE * np.eye(quality.P)
    assert np.allclose(mean[0], x.mean(0)) and np.isclose(det[0], np.linalg.slogdet(cov)[1])
    full = np.zeros((quality.P,) * 2)
    for k, (i, j) in enumerate(quality.PAIRS):
        full[i, j] = full[j, i] = inv[0, k] / (1 if i == j else 2)
    assert np.allclose(full, np.linalg.inv(cov))


def test_chi2_quantiles():
    for x in (1.0, 7.5, 40.0):  # even degrees have a closed form
        assert np.isclose(quality.chi2_cdf(x, 6), 1 - np.exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2))
    assert np.isclose(quality.chi2_quantile(0.95, 2), -2 * np.log(0.05))


def test_limits_are_quantiles_of_f():
    # F(2, d) has a closed form: P(F > f) = (1 + 2 f / d) ** (-d / 2)
    for d in (3.0, 10.0, 400.0):
        for f in (0.5, 3.0, 40.0):
            assert np.isclose(quality._beta_tail(f, 2, d), (1 + 2 * f / d) ** (-d / 2), rtol=1e-8)
    assert np.isclose(quality.distance_limit(1e6, 1e-7), quality.chi2_quantile(1 - 1e-7, quality.P), rtol=1e-3)
    assert quality.distance_limit(20, 1e-7) > 3 * quality.distance_limit(1000, 1e-7)


def fast_mcd(x, h=0.75, starts=30, seed=0):
    """Plain FAST-MCD: the least log determinant found, its centre and covariance."""
    rng, best = np.random.default_rng(seed), None
    k = int(np.ceil(h * len(x)))
    for _ in range(starts):
        i = rng.choice(len(x), min(len(x), 5 * quality.P), replace=False)
        last = np.inf
        for _ in range(50):
            mean, cov = x[i].mean(0), np.cov(x[i].T, bias=True) + quality.RIDGE * np.eye(quality.P)
            det = np.linalg.slogdet(cov)[1]
            if det >= last - 1e-12:
                break
            last = det
            i = np.argsort(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean), kind="stable")[:k]
        if best is None or last < best[0]:
            best = (last, mean, cov)
    return best


def test_verdicts_equal_plain_fast_mcd(spark):
    """Each group against a search without Spark, buckets or early stopping, on rows with planted junk."""
    docs = spark.createDataFrame(rows(random.Random(7), 500, 60), DOCS).unionByName(spark.createDataFrame([(1000 + r[0], *r[1:3], "small", 0) for r in rows(random.Random(8), 24, 3)], DOCS))
    found = quality.quality_rules(docs).toPandas()
    names = " ".join(quality.STATS).split()
    found["group"] = found["lang"] + found["source"]
    for _, g in found[~found["base_failed"]].groupby("group"):
        n, wc, sym, _, _, lines, upper, punct = (g[c].to_numpy(float) for c in names)
        x = np.stack([np.log(wc / n), np.sqrt((sym + punct) / wc), np.sqrt(upper / wc), np.log(n / lines)], 1)
        _, mean, cov = fast_mcd(x)
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        d = d / (np.sort(d)[int(np.ceil(0.75 * len(d))) - 1] / quality.chi2_quantile(0.75, quality.P))
        want = d <= quality.distance_limit(0.75 * len(d), 1e-7)
        assert (want == g["kept"].to_numpy()).all()
        close = d < np.quantile(d, 0.75)
        assert np.median(np.abs(np.log(g["distance"].to_numpy()[close] / d[close]))) < 0.15


def test_the_covariance_decides(spark):
    """Two features that go together: a row that breaks the bond goes, one that lies further out along it stays."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        t = rng.normal()
        rows.append([i, "en", "a", t])
    data = []
    for i, lang, source, t in rows:
        size = np.exp(1.6 + 0.05 * t)
        data.append((i, lang, source, 1000, int(1000 * size), 0, 0, 0, int(round(np.exp(3 + 0.5 * t + 0.05 * rng.normal()))), 120 + int(rng.integers(-9, 9)), 150 + int(rng.integers(-9, 9)), False))
    along, across = list(data[0]), list(data[1])
    along[0], along[4], along[8] = 400, int(1000 * np.exp(1.6 + 0.05 * 3.6)), int(round(np.exp(3 + 0.5 * 3.6)))
    across[0], across[4], across[8] = 401, int(1000 * np.exp(1.6 + 0.05 * 2.5)), int(round(np.exp(3 - 0.5 * 2.5)))
    stats = spark.createDataFrame([*data, tuple(along), tuple(across)], "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_punct long, base_failed boolean")
    stats.write.mode("overwrite").format("noop").save()
    kept = {r.doc_id: r.kept for r in quality.mcd_outliers(stats).collect()}
    assert kept[400] and not kept[401] and sum(not k for k in kept.values()) <= 3


def test_keep_good_goes_by_rows(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows(random.Random(10), 120, 12)], DOCS + ", __gone long, row long")
    docs = docs.withColumn("doc_id", docs.doc_id % 3)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 108


def test_awkward_rows(spark):
    got = quality.digest(quality.quality_rules(widened(awkward(spark)), steps=2)).collect()
    assert len(got) == 10 and all(r.base_failed and not r.kept for r in got)
    assert quality.quality_rules(awkward(spark).limit(0), steps=1).count() == 0
