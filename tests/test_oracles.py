"""Every registered query beside its SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracles import TABLES, compare  # noqa: E402

from trailmark.plans import ORACLES, QUERIES, load_all  # noqa: E402

load_all()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert compare(rows, df.columns, result.fetchall(), columns) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
