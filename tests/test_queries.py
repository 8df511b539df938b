"""Every query against its SQL on the smallest tables, and the queries without SQL for their shape."""

import math
import os

import duckdb
import pytest

from crawlweave.plans import catalogue

from .conftest import DATA

catalogue.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return None if v is None else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, DATA)
    data = got.collect()
    if name not in catalogue.SQL:
        assert data
        return
    want = db.execute(catalogue.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, data) == rows(names, want.fetchall())


def test_contract():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
