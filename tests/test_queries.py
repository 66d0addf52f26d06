"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import os

import duckdb
import pytest

from trialweave import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def normal(rows):
    return sorted(repr([round(x, 5) + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(n)] for n in names) for r in got.fetchall()]
    assert normal(df.select(*names).collect()) == normal(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
