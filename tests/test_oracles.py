"""Every registered query of the storage engine against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from blockloom import catalog

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no driver tables here")


def plain(df):
    def text(x):
        if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)):
            return "null"
        return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got, want = catalog.queries()[name](spark, D).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_files_with_quantized_keeps_every_part(spark, duck):
    """No part of a brand with a quantised part is left out, whatever its key."""
    got = catalog.queries()["files_with_quantized"](spark, D).groupBy("p_brand").count().collect()
    want = dict(duck.execute("SELECT p_brand, count(*) FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size % 35 NOT IN (0, 1, 30, 28)) GROUP BY 1").fetchall())
    assert {r["p_brand"]: r["count"] for r in got} == want
