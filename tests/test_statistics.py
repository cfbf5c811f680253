import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoscape.functions import stats


def frame(spark, **columns):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(columns))


def lrt(spark, a, b, la, lb):
    got = frame(spark, a=a, b=b).select(stats.likelihood_ratio(F.col("a"), F.col("b"), F.lit(float(la)), F.lit(float(lb))).alias("q"))
    return got.toPandas()["q"].to_numpy()


def test_equal_looks_identity(spark):
    rng = np.random.default_rng(1)
    a, b = rng.gamma(4, 1, 50), rng.gamma(4, 1, 50)
    looks = 4.4
    want = 2 * looks * (2 * np.log((a + b) / 2) - np.log(a) - np.log(b)) / (1 + (2 / looks - 1 / (2 * looks)) / 6)
    assert np.allclose(lrt(spark, a, b, looks, looks), np.maximum(want, 0), rtol=1e-9)


@pytest.mark.parametrize("n1,n2", [(1, 1), (3, 3), (1, 5)])
@pytest.mark.parametrize("alpha", [0.05, 0.01])
def test_false_alarm_rate(spark, n1, n2, alpha):
    rng = np.random.default_rng(7)
    looks, size = 4.4, 200_000
    side = lambda n: rng.gamma(looks * n, 1 / (looks * n), size)
    q = sum(lrt(spark, side(n1), side(n2), looks * n1, looks * n2) for _ in range(2))
    rate = (q > stats.chi2_threshold(alpha, 2)).mean()
    assert abs(rate / alpha - 1) < 0.08


def test_power_with_four_images(spark):
    rng = np.random.default_rng(8)
    side = lambda m: rng.gamma(4.4 * 4, m / (4.4 * 4), 50_000)
    q = sum(lrt(spark, side(1), side(10**0.5), 17.6, 17.6) for _ in range(2))
    assert (q > stats.chi2_threshold(0.01, 2)).mean() > 0.95


def test_thresholds():
    assert stats.chi2_threshold(1e-6, 2) == pytest.approx(27.631, abs=1e-3)
    assert stats.chi2_threshold(0.05, 1) == pytest.approx(3.8414588, abs=1e-6)
    for alpha in (0, 1, -1, 2):
        with pytest.raises(ValueError):
            stats.chi2_threshold(alpha, 2)


def test_quantile_of_f():
    assert stats.log_ratio_iqr(1) == pytest.approx(2 * math.log(3), abs=1e-9)  # F(2, 2) has its upper quartile at 3
    rng = np.random.default_rng(9)
    x = np.log(rng.gamma(4.4, 1, 400_000) / rng.gamma(4.4, 1, 400_000))
    assert stats.log_ratio_iqr(4.4) == pytest.approx(np.subtract(*np.percentile(x, [75, 25])), rel=0.01)


@pytest.mark.parametrize("looks", [1.0, 4.4, 30.0])
def test_looks_are_recovered(spark, looks):
    rng = np.random.default_rng(10)
    x = np.log(rng.gamma(looks, 1, 100_000) / rng.gamma(looks, 1, 100_000))
    x[:10] = [np.nan, np.inf] * 5
    assert stats.estimate_looks(frame(spark, log_ratio=x)) == pytest.approx(looks, rel=0.05)
    x[: len(x) // 20] += 2  # real changes make the estimate lower, never higher
    assert stats.estimate_looks(frame(spark, log_ratio=x)) < looks * 1.02


def test_looks_bounds_and_too_few(spark):
    assert stats.looks_from_iqr(0.0) == 200 and stats.looks_from_iqr(50.0) == 0.5
    with pytest.raises(ValueError):
        stats.estimate_looks(frame(spark, log_ratio=np.zeros(50)))


def test_stored_numbers(spark):
    df = frame(spark, stat=[0.0, 12.345, 1e6, 12.345], db=[0.0, 2.5, 999.0, -1.005])
    got = df.select(stats.encode_statistic(F.col("stat"), F.col("db")).alias("s"), stats.encode_db(F.col("db")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1234, 250), (32000, 30000), (-1234, -100)]
    coded = spark.createDataFrame([(1234,), (-1234,), (-32768,)], "s smallint")
    value, up, ok = stats.decode(F.col("s"))
    assert [tuple(r) for r in coded.select(value, up, ok).collect()] == [(12.34, True, True), (12.34, False, True), (327.68, False, False)]


def test_rounding_is_that_of_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    n = np.arange(1, 40_001, 2)
    x = np.concatenate([(n * 997 + 40_000_000) / 800, -n / 800, [0.0, 0.49999999999999994e-4, 12345.6789]])  # means of eight prices
    frame_of = frame(spark, i=np.arange(len(x)), x=x)
    got = frame_of.select("i", stats.rounded(F.col("x"), 4).alias("got"), F.round("x", 4).alias("spark")).toPandas().sort_values("i")
    want = duckdb.connect().execute("SELECT round(v, 4) AS r FROM (SELECT unnest(?::DOUBLE[]) AS v)", [x.tolist()]).fetchnumpy()["r"]
    assert (got["got"].to_numpy() == want).all() and (got["spark"].to_numpy() != want).any()
