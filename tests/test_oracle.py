"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

from helixframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def norm(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(norm, value))
    if isinstance(value, float) or hasattr(value, "is_finite"):
        return f"{float(value):.7g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in SQL:
        assert rows
        return
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(tuple(norm(r[c]) for c in order) for r in rows)
    want = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in result.fetchall())
    assert got == want


def test_sql_keys_are_queries():
    assert set(SQL) <= set(QUERIES)
