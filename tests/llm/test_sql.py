"""The queries that SQL can express give the same rows in DuckDB; all of them give a row per row of their table."""

import duckdb
import pytest

from pagemill.llm.queries import QUERIES, SQL

SOURCE = {"op4": "pages", "op7": "embeddings", "op11": "(SELECT DISTINCT conv_id FROM conversations)"}  # a row per row of documents else
OWN_ROWS = {"op13"}


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, duck, tables, name):
    df = QUERIES[name](spark, tables)
    rows = df.collect()
    if name.split("_")[0] not in OWN_ROWS:
        assert len(rows) == duck.execute(f"SELECT count(*) FROM {SOURCE.get(name.split('_')[0], 'documents')}").fetchone()[0]
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall()), key=str)
        assert sorted((tuple(r) for r in rows), key=str) == want
