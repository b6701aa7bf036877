"""Every query with SQL gives DuckDB's rows on the smallest fixtures."""

import glob
import os

import duckdb
import pytest

from tests.conftest import DATA
from tickforge.plans import catalog

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    want = duck.execute(catalog.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    keys = [c for c in columns if want[c].dtype.kind in "iOb"] + [c for c in columns if want[c].dtype.kind not in "iOb"]
    got, want = (x[columns].sort_values(keys).reset_index(drop=True) for x in (got, want))
    for c in columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[~same].head(), want[~same].head())


def test_every_query_without_sql_runs(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLE)):
        assert catalog.QUERIES[name](spark, FOLDER).count() > 0, name
