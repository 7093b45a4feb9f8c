"""Every registered query against its SQL twin, and the shape of every plan."""

import os

import duckdb
import pytest

from corpusweave.queries import registry
from tools.check import TABLES, compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry()))
def test_query(spark, tables, name):
    query = registry()[name]
    df = query.build(spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan, "row-at-a-time Python"
    assert query.sql, "no SQL twin"
    result = compare(df, tables.sql(query.sql))
    assert result.startswith("ok") and "EMPTY" not in result, result
