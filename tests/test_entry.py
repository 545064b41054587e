import os

import pytest

import __spark_entry__ as entry
from archivum.plans import registry

DATA = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    order = sorted(columns)
    want = sorted(str([str(r[columns.index(c)]) for c in order]) for r in cursor.fetchall())
    found = registry.queries()[name](spark, DATA)
    assert sorted(found.columns) == order
    assert sorted(str([str(r[c]) for c in order]) for r in found.collect()) == want
