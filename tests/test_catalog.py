"""Registered queries against their SQL, over the smallest tables."""

import os

import pytest

from tidelog import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def plain(v):
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    cursor = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})")
    expected = [tuple(plain(v) for v in r) for r in cursor.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))
