"""Every registered query of the engine against its DuckDB text, on the smallest tables."""

import os

import duckdb
import pytest

from quarry import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    rows = [tuple(shown(v) for v in r) for r in got.select(*names).collect()]
    if name not in queries.ORACLES:
        assert rows
        return
    cur = duck.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    want = [tuple(shown(dict(zip(cols, r, strict=True))[c]) for c in names) for r in cur.fetchall()]
    key = lambda r: tuple("" if v is None else v for v in r)
    assert sorted(rows, key=key) == sorted(want, key=key)
