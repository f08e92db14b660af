"""Verdicts, coverage and field status: plain relational work over (url, field, ...) tables.

Top-n per field uses ``row_number() <= n``, for which Spark keeps only n rows per key before it shuffles, so a field
that holds most of the rows does not end up whole in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ("correct", "wrong", "missed", "absent", "uncertain")
NEGATIVE = ("wrong", "missed")
RECHECK_DAYS, SAMPLE_PAGES, MAP_PAGES, SPOT_CHECKS = 30, 4, 2, 10


def _tallies() -> list[Column]:
    return [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]


def verdict_tally(verdicts: DataFrame) -> DataFrame:
    """``verdicts(field, verdict, ...)`` to one row per field with a count per verdict."""
    return verdicts.groupBy("field").agg(*_tallies())


def precision_recall(verdicts: DataFrame) -> DataFrame:
    """Per field and over all fields: precision = correct / found, recall = correct / (found + missed)."""
    total = F.grouping("field") == 1
    counted = verdicts.rollup("field").agg(total.alias("is_total"), *_tallies())
    found = F.col("correct") + F.col("wrong")
    return counted.select(
        F.when(F.col("is_total"), F.lit("ALL FIELDS")).otherwise(F.col("field")).alias("field"),
        *VERDICTS[:4],
        F.round(F.try_divide(F.col("correct"), found), 4).alias("precision"),
        F.round(F.try_divide(F.col("correct"), found + F.col("missed")), 4).alias("recall"),
    )


def passes() -> Column:
    """Graded well enough to be trusted everywhere. Disputed pages ("uncertain") do not count."""
    c, w, m = F.col("correct"), F.col("wrong"), F.col("missed")
    n = c + w + m + F.col("absent")
    return (c > 0) & (4 * m <= n) & ((w == 0) | ((4 * c >= 3 * n) & (4 * w <= n)))


def field_status(tally: DataFrame) -> DataFrame:
    only_absent = (F.col("absent") > 0) & (F.col("correct") + F.col("wrong") + F.col("missed") == 0)
    status = F.when(passes(), "validated").when(only_absent, "absent").otherwise("unreliable")
    return tally.withColumn("status", status)


def validated_selectors(selectors: DataFrame, status: DataFrame) -> DataFrame:
    """A blank instead of a wrong value: only validated fields keep their selectors."""
    return selectors.join(status.where("status = 'validated'").select("field"), "field", "left_semi")


def missing_fields(plan_fields: DataFrame, selectors: DataFrame) -> DataFrame:
    """Plan fields nothing was saved for: the only ones a re-check has to map again."""
    return plan_fields.join(selectors.select("field").distinct(), "field", "left_anti")


def mixed_fields(verdicts: DataFrame) -> DataFrame:
    tally = verdict_tally(verdicts)
    return tally.where((F.col("correct") > 0) & (F.col("wrong") + F.col("missed") > 0)).select("field")


def pages_to_regrade(verdicts: DataFrame) -> DataFrame:
    """Pages behind the negative verdicts of fields with mixed verdicts."""
    negative = verdicts.where(F.col("verdict").isin(*NEGATIVE))
    return negative.join(mixed_fields(verdicts), "field", "left_semi").select("url").distinct()


def second_opinion(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first(url, field, verdict)`` revised by a second grading of the disputed pages: on fields with mixed verdicts
    a verdict stands where both agree and is "uncertain" where they differ. Other fields keep the first verdict."""
    mixed = mixed_fields(first).withColumn("mixed", F.lit(True))
    pages = pages_to_regrade(first).withColumn("regraded", F.lit(True))
    again = second.select("url", "field", F.col("verdict").alias("verdict2"))
    joined = first.join(mixed, "field", "left").join(pages, "url", "left").join(again, ["url", "field"], "left")
    differs = F.col("mixed") & F.col("regraded") & (F.col("verdict2") != F.col("verdict"))
    kept = F.when(F.coalesce(differs, F.lit(False)), "uncertain").otherwise(F.col("verdict"))
    return joined.select("url", "field", kept.alias("verdict"))


def graded_values(values: DataFrame, verdicts: DataFrame) -> DataFrame:
    return values.join(verdicts, ["url", "field"])


def failure_examples(graded: DataFrame, order: str, at_most: int = 2) -> DataFrame:
    """The first few negative verdicts per field, with the value that was judged."""
    w = Window.partitionBy("field").orderBy(order, "url")
    bad = graded.where(F.col("verdict").isin(*NEGATIVE))
    return bad.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= at_most)


def worst_pages(verdicts: DataFrame, sample: DataFrame, at_most: int = 2) -> DataFrame:
    """Pages with most negative verdicts first, topped up with sample pages in order. ``sample(url, list_pos)``."""
    bad = verdicts.where(F.col("verdict").isin(*NEGATIVE)).groupBy("url").agg(F.count(F.lit(1)).alias("n_bad"))
    ranked = sample.join(bad, "url", "left").withColumn("n_bad", F.coalesce("n_bad", F.lit(0)))
    return ranked.orderBy(F.desc("n_bad"), "list_pos").limit(at_most)


def is_filled() -> Column:
    return (F.coalesce(F.col("value"), F.lit("")) != "") | (F.coalesce(F.size("items"), F.lit(0)) > 0)


def fill_rates(values: DataFrame) -> DataFrame:
    """``values(field, value, items)`` to filled / total per field."""
    return values.groupBy("field").agg(F.count_if(is_filled()).alias("filled"), F.count(F.lit(1)).alias("total"))


def coverage_gaps(values: DataFrame, with_selector: DataFrame | None = None) -> DataFrame:
    """Fields empty on a fifth of the pages or more: they probably have a second form somewhere. Integers only, so
    exactly a fifth counts. ``with_selector(field)``: the fields that have a selector at all; others are not asked for."""
    if with_selector is not None:
        values = values.join(with_selector.select("field").distinct(), "field", "left_semi")
    counted = values.groupBy("field").agg(F.count_if(~is_filled()).alias("empty"), F.count(F.lit(1)).alias("total"))
    return counted.where(5 * F.col("empty") >= F.col("total"))


def due_for_check(gaps: DataFrame, checked: DataFrame, today: Column) -> DataFrame:
    """Gaps not looked at within the last days. ``checked(field, checked_on)``."""
    remembered = gaps.join(checked, "field", "left")
    recent = F.coalesce(F.datediff(today, "checked_on") < RECHECK_DAYS, F.lit(False))
    return remembered.where(~recent).drop("checked_on")


def probe_pages(values: DataFrame, sample: DataFrame, at_most: int = 2) -> DataFrame:
    """Per field the first empty pages outside the validation sample; only when there are none, those inside it."""
    marked = values.where(~is_filled()).join(
        sample.select("url").withColumn("in_sample", F.lit(True)), "url", "left"
    ).withColumn("in_sample", F.coalesce("in_sample", F.lit(False)))
    w = Window.partitionBy("field", "in_sample").orderBy("list_pos")
    first = marked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= at_most)
    outside = first.where("not in_sample").select("field").distinct()
    inside = first.where("in_sample").join(outside, "field", "left_anti")
    return first.where("not in_sample").unionByName(inside).select("field", "url", "list_pos", "in_sample")


def accept_fallbacks(candidates: DataFrame, tally: DataFrame) -> DataFrame:
    """A further form is kept when its probe pages graded right at least once and never wrong."""
    return candidates.join(tally.where("correct > 0 and wrong = 0").select("field"), "field", "left_semi")


def repaired_selectors(old: DataFrame, new: DataFrame, tally: DataFrame) -> DataFrame:
    """``old(field, selectors)``, ``new(field, selector)``: a selector that gave wrong values is replaced, one that
    was right but missed pages gets the new one as fallback. Fields without a new selector stay."""
    empty = F.array().cast("array<string>")
    joined = old.join(new, "field", "full").join(tally.select("field", "wrong"), "field", "left")
    before = F.coalesce("selectors", empty)
    merged = (
        F.when(F.col("selector").isNull(), before)
        .when((F.coalesce("wrong", F.lit(0)) > 0) | (F.size(before) == 0), F.array("selector"))
        .otherwise(F.array_distinct(F.concat(before, F.array("selector"))))
    )
    return joined.select("field", merged.alias("selectors"))


def with_confidence(values: DataFrame, scores: DataFrame) -> DataFrame:
    """``scores(url, field, p)``: one confidence per filled value, three digits."""
    return values.join(scores, ["url", "field"], "left").withColumn(
        "confidence", F.when(is_filled(), F.round("p", 3))
    ).drop("p")


def validation_sample(listed: DataFrame, by: str, at_most: int = SAMPLE_PAGES) -> DataFrame:
    """The first pages of each listing."""
    w = Window.partitionBy(by).orderBy("list_pos")
    return listed.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= at_most).drop("rn")


def spot_check_sample(records: DataFrame, at_most: int = SPOT_CHECKS, seed: int = 0) -> DataFrame:
    """A fixed pseudo-random choice of records: the smallest seeded hashes of their URLs."""
    return records.orderBy(F.xxhash64(F.lit(seed), "url"), "url").limit(at_most)
