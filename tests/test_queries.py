"""Every change-event query against its SQL, at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry
from sluiceway.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    expected = rows(want.columns, want.fetchall())
    assert got == expected


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "scheme", "target", "state", "source", "event_type", "payload", "source_checkpoint"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
