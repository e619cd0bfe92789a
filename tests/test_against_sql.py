"""Every registered query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from netloom.plans import queries as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = {k: q for k, q in entry.queries().items() if k in registry.names()}, entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def plain(rows):
    def cell(v):
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


def test_all_have_sql():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, data, name):
    frame = QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    result = duck.execute(SQL[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    want = plain([[row[found.index(c)] for c in columns] for row in result.fetchall()])
    assert plain(frame.select(columns).collect()) == want
