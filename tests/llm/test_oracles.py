"""The operators' queries equal their DuckDB SQL on the smallest tables."""

import os

import pytest

from millrace.llm import registry
from tests.test_queries import SF, TABLES, normal

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    got = got.toPandas()
    assert normal(got) == normal(want[got.columns])
