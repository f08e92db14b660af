"""Writing what a run produced. All sinks are distributed writes; none collects rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators.quality import fill_rates

BUCKETS = 64
PUBLICATION_COLUMNS = (
    "url", "list_title", "title", "date", "authors", "summary", "pdf", "doi", "topics", "schema_type", "via", "kind",
    "kind_confidence",
)  # fixed values


def write_archive(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pages by host bucket. The rebalance hint cuts a bucket by its size, so one huge host is written by many tasks."""
    host = F.pmod(F.xxhash64(urls.site(F.col("url"))), F.lit(BUCKETS)).cast("int")
    pages.withColumn("host_bucket", host).hint("rebalance", "host_bucket").write.mode(mode).partitionBy("host_bucket").parquet(path)


def _text(column: Column) -> Column:
    return F.array_join(column, "; ")


def csv_items(wide: DataFrame, fields: list[str], list_fields: tuple[str, ...] = (), confidences: DataFrame | None = None) -> DataFrame:
    """``url``, the plan's fields as text (lists joined by ``; ``, missing ones empty) and one confidence per field.
    ``confidences(url, field, confidence)`` may be absent."""
    columns = [F.coalesce(_text(F.col(f)) if f in list_fields else F.col(f), F.lit("")).alias(f) for f in fields]
    out = wide.select("url", *columns)
    if confidences is None:
        return out.select("*", *[F.lit(None).cast("double").alias(f"{f}_confidence") for f in fields])
    scores = confidences.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("field", "confidence"))).alias("c"))
    return out.join(scores, "url", "left").select(
        "url", *fields, *[F.col("c")[f].alias(f"{f}_confidence") for f in fields])


def publication_rows(facts: DataFrame) -> DataFrame:
    """The fixed publication columns, lists as text."""
    return facts.select(*[
        _text(F.col(c)).alias(c) if c in ("authors", "topics") else F.col(c) for c in PUBLICATION_COLUMNS
    ])


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV files with a header each. Spreadsheet programs look for a byte-order mark, which goes before the first
    column's name."""
    first = rows.columns[0]
    marked = rows.withColumnRenamed(first, "\ufeff" + first)
    marked.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def run_summary(values: DataFrame, status: DataFrame) -> DataFrame:
    """One row per field: its status and how many items have it."""
    return fill_rates(values).join(status, "field", "left")


def changed_recipes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Recipes to save: new or changed ones. A recipe that existed keeps its first validation date and build cost."""
    before = old.select("site", "prompt", F.col("validated_on").alias("old_on"), F.col("build_cost").alias("old_cost"),
                        F.to_json("selectors").alias("old_selectors"), F.to_json("coverage_checked").alias("old_checked"),
                        F.col("listing").alias("old_listing"))
    joined = new.join(before, ["site", "prompt"], "left")
    changed = (
        F.col("old_selectors").isNull() | (F.to_json("selectors") != F.col("old_selectors")) | F.col("old_listing").isNull()
        | ~F.to_json("coverage_checked").eqNullSafe(F.col("old_checked"))
    )
    kept = joined.where(changed).withColumn("validated_on", F.coalesce("old_on", "validated_on")).withColumn(
        "build_cost", F.coalesce("old_cost", "build_cost"))
    return kept.select(*new.columns)


def crawl_report(found: dict[str, DataFrame]) -> DataFrame:
    """One row per site: answer, sections and the top places, as nested columns."""
    sections = found["sections"].groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("holds", "url"))).alias("sections"))
    top = found["top"].groupBy("site").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "url", "depth", "role", "holds", "hub", "items", "score", "prio", "linked_from"))).alias("top"))
    return found["answer"].withColumnRenamed("url", "answer").join(sections, "site", "left").join(top, "site", "left")
