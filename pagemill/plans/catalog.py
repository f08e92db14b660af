"""Registry of named queries: each takes (spark, folder of tables) and may have an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows that are about to become pages, dealt to as many tasks as a shuffle has: rendering and parsing are bound by
    CPU, and these tables come in one piece. A choice of the queries' own input; operators take pages as they come."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def big(column: Column | str, name: str) -> Column:
    return F.col(column).cast("bigint").alias(name) if isinstance(column, str) else column.cast("bigint").alias(name)
