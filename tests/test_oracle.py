"""Every bound query against its SQL in DuckDB, as multisets of rows."""

import duckdb
import pytest

from rollcall.plans import catalog_functions, catalog_views
from rollcall.plans.catalog import ORACLE, QUERIES

assert catalog_views and catalog_functions  # add to the catalogue
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    if isinstance(v, dict):
        v = list(v.values())
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE:  # its rows are checked by a test of its own; here it has to run
        assert columns
        return
    cur = duck.execute(ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLE) <= set(entry.queries())
