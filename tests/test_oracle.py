"""Each query against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from sluice import queries as core
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    found = duck.execute(core.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.QUERIES) <= set(entry.queries())
