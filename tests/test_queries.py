"""Every registered query against its SQL twin."""

import pytest

from compare import compare, connect
from loomcast.suite import load

QUERIES = load()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf, name):
    q = QUERIES[name]
    ok, msg = compare(spark, duck, name, q.run, q.sql, sf)
    assert ok, msg


def test_contract(spark):
    import __spark_entry__ as e

    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs) and set(QUERIES) <= set(qs) and len(QUERIES) > 150
    assert len([n for n in QUERIES if n not in sql]) <= 3
    df = e.entry(spark)
    assert df.count() == 5 and "action" in df.columns
