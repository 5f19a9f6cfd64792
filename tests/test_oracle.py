"""Every registered query against its SQL on DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import canonical, of_frame
from hubtrace.plans.testdata import TABLES

SF = "/root/testdata/sf0.01"
QUERIES, SQL = {**entry.CORRELATIONS, **entry.PREPARATION}, entry.oracle.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    mine = of_frame(QUERIES[name](spark, SF))
    found = duck.execute(SQL[name])
    theirs = canonical([c[0] for c in found.description], found.fetchall())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == [
        "ids_project_number", "n_incidents", "first_incident", "last_incident",
    ]
    assert out.count() == 150
