"""Each operator that SQL can express gives the rows that DuckDB does."""

from __future__ import annotations

import duckdb
import pytest

from catalume.llm.queries import ORACLE, QUERIES
from tests.conftest import SMALL
from tests.test_oracle import rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)
