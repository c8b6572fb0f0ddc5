"""Every registered query with SQL gives the rows that DuckDB does; those without give rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from catalume.queries import ORACLE_SQL, QUERIES

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def _value(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    return f"{float(v):.12g}" if isinstance(v, int | float) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(_value, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns)
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
