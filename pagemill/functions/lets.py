"""A let-binding for column expressions, and a way to build big expressions once per session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    The optimizer may inline a projected column into the lambda of a later one, which would evaluate it once per array
    element. Binding it as a lambda variable rules that out and keeps every page-level operator linear."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_of(df: DataFrame, keep: list, array: Column | str, required: str) -> DataFrame:
    """One row per entry of a computed array of structs, next to the ``keep`` columns.

    The outer generator with a test afterwards gives the same rows as the inner one. For the inner one the optimizer
    infers a filter on the array's size and pushes it below the projection that computes the array, which would then be
    computed twice more for every page."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(required).isNotNull())


def opened(df: DataFrame, keep: list, struct: str) -> DataFrame:
    """The fields of a computed struct as columns, next to ``keep``.

    A filter or join on such a field would otherwise be pushed below the projection that computes the struct, and the
    page would be worked through again for it. No filter passes a generator's own columns."""
    return df.select(*keep, F.inline_outer(F.array(struct)))


def built_once(make: Callable[..., Column]) -> Callable[..., Column]:
    """Cache for functions from column *names* to an expression: a page-level expression is thousands of calls to the
    JVM, and the result only depends on the names."""
    cache: dict[tuple, Column] = {}

    @wraps(make)
    def get(*names: str) -> Column:
        context = SparkContext._active_spark_context
        key = (id(context), *names)
        if key not in cache:
            cache[key] = make(*names)
        return cache[key]

    return get
