"""Each query that SQL can express against DuckDB."""

import duckdb
import pytest

from corpusforge.llm.queries import oracle_sql, queries

TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries()[name](spark, sf)
    columns = sorted(df.columns)
    plain = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    answer = con.execute(oracle_sql()[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_keeps_every_row(spark, sf, name):
    assert queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
