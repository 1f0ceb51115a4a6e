"""The thin queries: registered names, whole tables, and SQL where there is some."""

import os

import pytest

from tidelog.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_one_query_an_operator():
    assert [int(name[2:].split("_")[0]) for name in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_like_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    rows = sorted(repr(plain(r)) for r in df.select(*columns).collect())
    cursor = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})")
    assert rows == sorted(repr(plain(r)) for r in cursor.fetchall())


@pytest.mark.parametrize(("name", "table"), [("op2_personal_data", "documents"), ("op3_token_files", "documents"), ("op7_main_text", "pages"), ("op8_toxicity", "documents"), ("op9_fingerprints", "documents")])
def test_a_row_for_each_row(spark, name, table):
    key = "page_id" if table == "pages" else "doc_id"
    rows = queries.QUERIES[name](spark, SF).select(key).collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
