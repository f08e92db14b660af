"""Growing archives: the batch functions on a stream of stored pages, with checkpoints to resume from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.functions import urls
from pagemill.operators import recipes as rc
from pagemill.operators.quality import is_filled


def page_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of fetched pages. The batch size bounds a batch's work, not the result."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_per_url(pages: DataFrame, seen_at: str, within: str) -> DataFrame:
    """One row per normalised URL across batches. State is dropped once the watermark has passed, so it stays bounded."""
    return (
        pages.withColumn("norm_url", urls.normalise(F.col("url")))
        .withWatermark(seen_at, within)
        .dropDuplicatesWithinWatermark(["norm_url"])
    )


def apply_recipe_stream(
    pages: DataFrame, recipes: DataFrame, out: str, checkpoint: str, text_patterns: bool = True
) -> StreamingQuery:
    """Records of every new page as Parquet; the file sink and the checkpoint give each page exactly once."""
    records = rc.value_rows(rc.apply_recipes(pages, recipes, text_patterns))
    return (
        records.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def fill_rate_drift(values: DataFrame, seen_at: str, window: str, late: str) -> DataFrame:
    """Fill rate per field and window of the pages' time; rows later than ``late`` are dropped by the watermark."""
    return (
        values.withWatermark(seen_at, late)
        .groupBy(F.window(seen_at, window), "field")
        .agg(F.avg(is_filled().cast("double")).alias("fill_rate"), F.count(F.lit(1)).alias("pages"))
    )


def drifted(rates: DataFrame, validated: DataFrame, drop: float = 0.2) -> DataFrame:
    """Windows in which a field is filled clearly less often than when it was validated. ``validated(field, rate)``."""
    return rates.join(validated, "field").where(F.col("fill_rate") < F.col("rate") - drop)
