"""Every query of the feeds against its SQL oracle on the smallest tables. The training-data queries have their own
tests in tests/llm."""

import os

import duckdb
import pytest

import __spark_entry__ as entrypoint
from feedlake.plans.registry import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from read_parquet('{SF_DIR}/{name}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)


def test_feed_queries_are_registered():
    queries, sql = entrypoint.queries(), entrypoint.oracle_sql()
    assert queries.items() >= QUERIES.items() and sql.items() >= SQL.items()
    assert set(sql) <= set(queries)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    got = sorted(tuple(str(row[c]) for c in columns) for row in result.collect())
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(str(row[i]) for i in order) for row in cursor.fetchall())
    assert got == want
