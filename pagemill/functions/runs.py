"""Runs of equal keys in a sorted array: grouping inside a row that is linear in the array after one sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.lets import let


def per_run(rows: Column, key: str, build: Callable[[Column, Column], Column]) -> Column:
    """``build(first, run)`` of every run of equal ``key`` of an array sorted by it, in that order; keys aren't NULL.

    A run's end is the next run's start, so two lists of starts are zipped: one binding less than looking them up, which
    counts where page expressions are deep (the analyzer resolves a nested lambda per pass)."""

    def cut(r: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(r)),
            lambda i: (i < F.size(r)) & ((i == 0) | (F.get(r, i - 1)[key] != F.get(r, i)[key])))
        ends = F.slice(F.concat(starts, F.array(F.size(r))), F.lit(2), F.size(r) + 1)
        return F.zip_with(starts, ends, lambda at, until: build(F.get(r, at), F.slice(r, at + 1, until - at)))

    return let(rows, cut)
