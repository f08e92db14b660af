"""Connected components of a graph given as edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import saved


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b), bigint: one row (node, component) for each node of an edge between different nodes, with the
    smallest node that can be reached. Repeated, reversed and self edges are fine; an empty table gives none.

    Every round hangs nodes under smaller neighbours, so that a hub keeps one row per neighbour and no group is ever
    gathered: the smallest neighbour is a partial aggregate, and the join with it is split by the engine where a hub is
    hot. Rounds end when no edge changes, after about log(n) of them; each is written to the shared folder."""
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small, "a")
        now = saved(linked.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct(), "edges")
        was, mark = mark, _mark(now)
        if was == mark:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of the edges: equal for equal sets."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 24))).first())
