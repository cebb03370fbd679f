"""Every registered query against its SQL, value by value."""

import pytest
from compare import connect, differences

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert not {t for _, t in df.dtypes} & {"int", "smallint", "date", "float"}
    if name in SQL:
        assert differences(df, SQL[name], con) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import importlib

    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns == ["category", "revenue", "profit", "margin_pct", "revenue_share_pct"]
    # the training-data queries come on top where their subpackage is there
    assert set(entry.queries()) >= set(QUERIES) and SQL.items() <= entry.oracle_sql().items()
