"""Every query of the library against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tesspan import queries

SF = "/root/testdata/sf0.001"
#: A few groups of the catalogue; all of them run on the larger tables outside the tests.
FACTORS = {"factors_alpha001_to_alpha012", "factors_alpha025_to_alpha036", "factors_gtja_001_to_012"}
NAMES = [n for n in queries.QUERIES if not n.startswith("factors_") or n in FACTORS]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda x: "-" if x is None or x is pd.NA or x is pd.NaT or x != x else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLES:
        assert len(got)
        return
    want = duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
