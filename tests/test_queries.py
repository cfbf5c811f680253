"""Every query with SQL gives the same rows in DuckDB."""

import glob
import math
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
plans = pytest.importorskip("chronoscape.plans.queries")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    one = lambda x: round(float(x), 6) if isinstance(x, float) and not math.isnan(x) else None if x is None or x != x else int(x) if hasattr(x, "__index__") else str(x)
    return sorted((tuple(map(one, r)) for r in pdf.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got, want = plans.queries()[name](spark, SF).toPandas(), con.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_a_price_is_no_missing_value(spark, tmp_path):
    """Pixels of q54 whose mean price was 77,777 in a band were taken for missing ones."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (77777.0::DOUBLE AS l_extendedprice) FROM '{SF}/lineitem.parquet' WHERE l_partkey % 3 = 0 UNION ALL FROM '{SF}/lineitem.parquet' WHERE l_partkey % 3 > 0) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got, want = plans.queries()["q54_unusable_pixels"](spark, str(tmp_path)).toPandas(), con.execute(plans.oracle_sql()["q54_unusable_pixels"]).df()
    assert rows(got) == rows(want) and (want.vv == 77777).any() and (want.vh == 77777).any()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
