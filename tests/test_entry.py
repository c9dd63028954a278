import os

import pytest

import __spark_entry__ as entry
from docmill.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_registered_queries_equal_their_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    plain = lambda v: "-" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    for name, sql in registry.ORACLE.items():
        got, want = registry.QUERIES[name](spark, DATA), db.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        columns = sorted(got.columns)
        rows = lambda found, order: sorted(tuple(plain(r[order.index(c)]) for c in columns) for r in found)  # noqa: E731, B023
        assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
