"""Every query with SQL equals DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

from millrace.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def normal(df: pd.DataFrame) -> list[tuple]:
    one = lambda x: None if x is None or (not hasattr(x, "__len__") and pd.isna(x)) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted((tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if not sql:
        assert len(got) > 0
        return
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_filters_reach_the_scan(spark):
    plan = registry.queries()["tpch_q10"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in plan
    assert "TakeOrderedAndProject" in plan
