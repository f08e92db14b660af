"""What the model calls of a run cost, and how their answers are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as tx

PRICE_IN, PRICE_OUT = 0.30, 1.20  # fixed values: dollars per million tokens


def usage_cost(calls: DataFrame, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> DataFrame:
    """``calls(stage, tokens_in, tokens_out)`` to calls, tokens and dollars per stage plus a total, which adds the
    *rounded* stage amounts. A call without reported usage still counts."""
    staged = calls.groupBy("stage").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"),
        F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out"),
    ).withColumn("usd", F.round((F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6, 4))
    # a handful of stages: the second pass is over a table that is already aggregated
    total = staged.agg(
        F.lit("total").alias("stage"), F.sum("calls").alias("calls"), F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("usd"), 4).alias("usd"),
    )
    return staged.unionByName(total)


def json_answers(answers: DataFrame) -> DataFrame:
    """``answers(..., text)`` with ``json``: the answer's JSON value without thinking, fences and chatter; NULL when
    there is none, so the caller can ask again."""
    return answers.withColumn("json", tx.first_json(F.col("text")))
