"""Every query that has SQL against DuckDB on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from sylva.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t[:-8]} as select * from '{DATA}/{t}'")
    return c


def frame(df):
    cols = sorted(df.columns)
    out = df[cols].copy()
    for c in cols:
        out[c] = out[c].map(lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v))
    return out.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = frame(QUERIES[name](spark, DATA).toPandas()), frame(duck.execute(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(want) > 0
    pd.testing.assert_frame_equal(got, want)
