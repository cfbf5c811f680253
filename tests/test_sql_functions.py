import random

import pytest
from pyspark.sql import functions as F

from chronoscape.functions import sql, stats


def test_functions_equal_the_columns(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([tuple(rng.uniform(0.01, 9) for _ in range(2)) + tuple(rng.choice([1.0, 4.4, 20.0]) for _ in range(2)) for _ in range(200)], "a double, b double, l double, m double")
    stat, db = stats.likelihood_ratio(F.col("a"), F.col("b"), F.col("l"), F.col("m")), stats.decibels(F.col("a"), F.col("b"))
    df = df.select("*", stat.alias("stat"), db.alias("db")).select("*", stats.encode_statistic(F.col("stat"), F.col("db")).alias("signed"), stats.encode_db(F.col("db")).alias("stored"))
    df.createOrReplaceTempView("samples_of_functions")
    for _ in range(2):  # registered anew without harm
        sql.register(spark)
    got = spark.sql("SELECT stat, likelihood_ratio(a, b, l, m) AS s, db, decibels(a, b) AS d, signed, encode_statistic(stat, db) AS x, stored, encode_db(db) AS y, decode_statistic(signed) AS z FROM samples_of_functions").collect()
    assert len(got) == 200
    for r in got:
        assert r.s == pytest.approx(r.stat, abs=1e-12) and r.d == pytest.approx(r.db) and (r.x, r.y) == (r.signed, r.stored) and r.z == abs(r.signed) / 100
    assert spark.sql(f"SELECT decode_statistic(CAST({stats.NODATA} AS SMALLINT)) AS v").first().v is None


def test_patches_as_a_view(spark):
    spark.createDataFrame([(0, 0, 1), (1, 1, 2), (5, 5, 3)], "row int, col int, v int").createOrReplaceTempView("pixels_of_patches")
    sql.create_patches(spark, "pixels_of_patches", "patches_of_pixels")
    assert [tuple(r) for r in spark.sql("SELECT count(*), sum(v) FROM patches_of_pixels GROUP BY label ORDER BY 1").collect()] == [(1, 3), (2, 3)]
