"""Every registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from togglelog.plans.queries import QUERIES

SF_DIR = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12)
    return a == b and type(a) is type(b)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() <= entry_points.oracle_sql().keys() <= entry_points.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, str(SF_DIR))
    got = comparable(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = comparable(columns, found.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(same, a, b)), (a, b)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
