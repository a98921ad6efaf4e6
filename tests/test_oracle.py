"""Every query with SQL gives the same rows in another engine on the same tables, without
cross joins or Python in its plan."""

import re

import duckdb
import pytest

import __spark_entry__ as driver
from ledgerline import schemas
from ledgerline.plans.oracle import ORACLE
from ledgerline.plans.queries import QUERIES


@pytest.fixture(scope="module")
def engine(folder):
    connection = duckdb.connect()
    for name in schemas.STAR:
        connection.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, engine, folder, name):
    result = QUERIES[name](spark, folder)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoopJoin|EvalPython|InPandas", plan)
    expected = engine.sql(ORACLE[name])
    columns = sorted(result.columns)
    assert columns == sorted(expected.columns)
    picked = [expected.columns.index(c) for c in columns]
    wanted = [tuple(row[i] for i in picked) for row in expected.fetchall()]
    found = [tuple(row[c] for c in columns) for row in result.collect()]
    assert ordered(found) == ordered(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_others_give_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_flagship(spark):
    assert driver.entry(spark).count() == 5
