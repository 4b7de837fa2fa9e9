"""Every engine query with SQL gives what DuckDB gives on the smallest tables."""

import os

import pytest

from tracewell.plans.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer part events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    import pandas as pd

    show = lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(int(v)) if hasattr(v, "dtype") and v.dtype.kind in "iub" else str(v)
    df = df[sorted(df.columns)].astype(object)
    return sorted("|".join(show(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    mine, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, duck, name):
    assert len(QUERIES[name](spark, DATA).collect()) > 0
