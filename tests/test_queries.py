"""Every named query that has a SQL text gives the same rows in DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from pagemill.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value) if isinstance(value, datetime.date) else value


def canonical(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, tables, name):
    df = QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [[row[names.index(c)] for c in columns] for row in result.fetchall()]
    assert canonical([r[c] for c in columns] for r in df.collect()) == canonical(want)


ROWS_ONLY = sorted(set(QUERIES) - set(SQL))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, tables, name):
    assert QUERIES[name](spark, tables).limit(1).count() == 1


def test_repository_names_no_local_folder():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "pagemill")
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f), encoding="utf-8").read()
                assert "localCheckpoint" not in text and "/root/" not in text
