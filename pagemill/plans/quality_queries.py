"""Verdicts and coverage: documents stand for values, their source for the field, their labels for the verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import quality as ql
from pagemill.operators.outline import most_common
from pagemill.plans.catalog import big, query, table

_VERDICT = (
    "CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'wrong' WHEN toxic = 1 THEN 'missed' ELSE 'absent' END"
)
_V = f"WITH v AS (SELECT source AS field, 'doc-' || doc_id AS url, doc_id, {_VERDICT} AS verdict FROM documents JOIN labels USING (doc_id))"
_COUNTS = ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ql.VERDICTS)
_T = f"{_V}, t AS (SELECT field, {_COUNTS} FROM v GROUP BY 1)"


def verdicts(spark, folder):
    joined = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id")
    return joined.select(
        F.col("source").alias("field"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("url"), "doc_id",
        F.expr(_VERDICT).alias("verdict"))


@query("verdict_tally", f"{_T} SELECT * FROM t")
def verdict_tally(spark, folder):
    return ql.verdict_tally(verdicts(spark, folder))


@query(
    "precision_recall",
    f"{_V}, r AS (SELECT CASE WHEN grouping(field) = 1 THEN 'ALL FIELDS' ELSE field END AS field, {_COUNTS} FROM v GROUP BY ROLLUP (field)) "
    "SELECT field, correct, wrong, missed, absent, round(correct / nullif(correct + wrong, 0)::DOUBLE, 4) AS precision, "
    "round(correct / nullif(correct + wrong + missed, 0)::DOUBLE, 4) AS recall FROM r",
)
def precision_recall(spark, folder):
    return ql.precision_recall(verdicts(spark, folder))


_PASS = (
    "correct > 0 AND 4 * missed <= correct + wrong + missed + absent AND (wrong = 0 OR (4 * correct >= 3 * (correct + wrong + missed + absent) "
    "AND 4 * wrong <= correct + wrong + missed + absent))"
)
_STATUS = f"CASE WHEN {_PASS} THEN 'validated' WHEN absent > 0 AND correct + wrong + missed = 0 THEN 'absent' ELSE 'unreliable' END"


@query("field_status", f"{_T} SELECT field, {_STATUS} AS status FROM t")
def field_status(spark, folder):
    return ql.field_status(ql.verdict_tally(verdicts(spark, folder))).select("field", "status")


@query("validated_values", f"{_T} SELECT doc_id, field FROM v WHERE field IN (SELECT field FROM t WHERE {_PASS})")
def validated_values(spark, folder):
    """Only values of validated fields are delivered: a blank instead of a wrong value."""
    v = verdicts(spark, folder)
    return ql.validated_selectors(v, ql.field_status(ql.verdict_tally(v))).select("doc_id", "field")


_SECOND = "CASE WHEN doc_id % 2 = 0 THEN verdict ELSE 'correct' END"
_MIXED = "(SELECT field FROM t WHERE correct > 0 AND wrong + missed > 0)"


@query(
    "second_opinion",
    f"{_T} SELECT url, field, CASE WHEN verdict IN ('wrong', 'missed') AND field IN {_MIXED} AND {_SECOND} <> verdict THEN 'uncertain' ELSE verdict END AS verdict FROM v",
)
def second_opinion(spark, folder):
    first = verdicts(spark, folder)
    second = first.withColumn("verdict", F.expr(_SECOND))
    return ql.second_opinion(first.drop("doc_id"), second.drop("doc_id"))


@query("pages_to_regrade", f"{_T} SELECT DISTINCT url FROM v WHERE verdict IN ('wrong', 'missed') AND field IN {_MIXED}")
def pages_to_regrade(spark, folder):
    return ql.pages_to_regrade(verdicts(spark, folder))


@query(
    "failure_examples",
    f"{_V}, r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY doc_id) AS rn FROM v WHERE verdict IN ('wrong', 'missed')) SELECT field, url, verdict, rn FROM r WHERE rn <= 2",
)
def failure_examples(spark, folder):
    rows = ql.failure_examples(verdicts(spark, folder), "doc_id")
    return rows.select("field", "url", "verdict", big("rn", "rn"))


@query(
    "worst_pages",
    f"{_V}, s AS (SELECT doc_id // 10 AS list_pos, 'page-' || (doc_id // 10) AS url, verdict FROM v), "
    "n AS (SELECT url, list_pos, count(*) FILTER (verdict IN ('wrong', 'missed')) AS n_bad FROM s GROUP BY 1, 2) "
    "SELECT url, list_pos, n_bad FROM n ORDER BY n_bad DESC, list_pos LIMIT 2",
)
def worst_pages(spark, folder):
    v = verdicts(spark, folder).withColumn("list_pos", F.floor(F.col("doc_id") / 10))
    v = v.withColumn("url", F.concat(F.lit("page-"), F.col("list_pos").cast("string")))
    return ql.worst_pages(v, v.select("url", "list_pos").distinct()).select("url", "list_pos", "n_bad")


_VALUES = (
    "WITH v AS (SELECT d.doc_id AS list_pos, 'doc-' || d.doc_id AS url, source AS field, l.doc_id IS NOT NULL AS filled "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)


def values(spark, folder):
    """A document without a label is a page whose field came out empty."""
    labelled = table(spark, folder, "labels").select("doc_id", F.lit("x").alias("value"))
    return table(spark, folder, "documents").select("doc_id", "source").join(labelled, "doc_id", "left").select(
        F.col("doc_id").alias("list_pos"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("field"), "value", F.lit(None).cast("array<string>").alias("items"))


@query("coverage_gaps", f"{_VALUES} SELECT field, count(*) FILTER (NOT filled) AS empty, count(*) AS total FROM v GROUP BY 1 HAVING 5 * count(*) FILTER (NOT filled) >= count(*)")
def coverage_gaps(spark, folder):
    return ql.coverage_gaps(values(spark, folder))


@query(
    "due_checks",
    f"{_VALUES}, g AS (SELECT field, count(*) FILTER (NOT filled) AS empty, count(*) AS total FROM v GROUP BY 1 HAVING 5 * count(*) FILTER (NOT filled) >= count(*)), "
    "c AS (SELECT source AS field, DATE '2026-01-01' + CAST(max(doc_id) % 60 AS INTEGER) AS checked_on FROM documents GROUP BY 1 HAVING max(doc_id) % 3 > 0) "
    "SELECT field, empty, total FROM g LEFT JOIN c USING (field) WHERE checked_on IS NULL OR DATE '2026-02-15' - checked_on >= 30",
)
def due_checks(spark, folder):
    """Gaps whose field was not looked at during the last thirty days."""
    last = table(spark, folder, "documents").groupBy(F.col("source").alias("field")).agg(F.max("doc_id").alias("m"))
    checked = last.where("m % 3 > 0").select("field", F.expr("date_add(DATE'2026-01-01', cast(m % 60 as int))").alias("checked_on"))
    return ql.due_for_check(ql.coverage_gaps(values(spark, folder)), checked, F.lit("2026-02-15").cast("date"))


@query(
    "probe_pages",
    f"{_VALUES}, e AS (SELECT *, list_pos % 2 = 0 OR field < 's' AS in_sample FROM v WHERE NOT filled), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY field, in_sample ORDER BY list_pos) AS rn FROM e) "
    "SELECT field, url, list_pos, in_sample FROM r WHERE rn <= 2 AND (NOT in_sample OR field NOT IN (SELECT field FROM e WHERE NOT in_sample))",
)
def probe_pages(spark, folder):
    v = values(spark, folder)
    return ql.probe_pages(v, v.where("list_pos % 2 = 0 or field < 's'").select("url"))


@query(
    "accepted_fallbacks",
    f"{_T}, c AS (SELECT DISTINCT source AS field, 'sel-' || lang AS selector FROM documents) "
    "SELECT field, selector FROM c WHERE field IN (SELECT field FROM t WHERE correct > 0 AND wrong = 0)",
)
def accepted_fallbacks(spark, folder):
    found = table(spark, folder, "documents").select(F.col("source").alias("field"), F.concat(F.lit("sel-"), "lang").alias("selector")).distinct()
    return ql.accept_fallbacks(found, ql.verdict_tally(verdicts(spark, folder)))


_REPAIR = (
    f"{_T}, o AS (SELECT source AS field, string_agg(DISTINCT lang, '|' ORDER BY lang) AS old FROM documents WHERE doc_id % 7 > 0 GROUP BY 1), "
    "n AS (SELECT source AS field, CASE WHEN max(doc_id) % 2 = 0 THEN min(lang) ELSE 'new' END AS fresh FROM documents WHERE doc_id % 5 > 0 GROUP BY 1) "
    "SELECT field, CASE WHEN fresh IS NULL THEN coalesce(old, '') WHEN coalesce(wrong, 0) > 0 OR old IS NULL THEN fresh "
    "WHEN list_contains(string_split(old, '|'), fresh) THEN old ELSE old || '|' || fresh END AS selectors "
    "FROM o FULL JOIN n USING (field) LEFT JOIN t USING (field)"
)


@query("repaired_selectors", _REPAIR)
def repaired_selectors(spark, folder):
    d = table(spark, folder, "documents").withColumnRenamed("source", "field")
    old = d.where("doc_id % 7 > 0").groupBy("field").agg(F.array_sort(F.collect_set("lang")).alias("selectors"))
    new = d.where("doc_id % 5 > 0").groupBy("field").agg(
        F.when(F.max("doc_id") % 2 == 0, F.min("lang")).otherwise(F.lit("new")).alias("selector"))
    merged = ql.repaired_selectors(old, new, ql.verdict_tally(verdicts(spark, folder)))
    return merged.withColumn("selectors", F.array_join("selectors", "|"))


@query("missing_fields", "SELECT DISTINCT source AS field FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def missing_fields(spark, folder):
    """Plan fields no saved selector covers."""
    fields = table(spark, folder, "documents").select(F.col("source").alias("field"), "doc_id")
    saved = fields.join(table(spark, folder, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return ql.missing_fields(fields.select("field").distinct(), saved)


@query(
    "value_confidence",
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 3 > 0 THEN round(d.n_chars % 1000 / 1000.0::DOUBLE, 3) END AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def value_confidence(spark, folder):
    scores = table(spark, folder, "documents").where("doc_id % 3 > 0").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("field"),
        (F.col("n_chars") % 1000 / F.lit(1000.0)).alias("p"))
    return ql.with_confidence(values(spark, folder), scores).select(F.col("list_pos").alias("doc_id"), "confidence")


@query(
    "mode_selector",
    "WITH c AS (SELECT event_type AS field, props AS selector, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) "
    "SELECT field, selector, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1",
)
def mode_selector(spark, folder):
    events = table(spark, folder, "events").select(F.col("event_type").alias("field"), F.col("props").alias("selector"), "event_id")
    return most_common(events, ["field"], "selector", "event_id")


@query(
    "validation_sample",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 4",
)
def validation_sample(spark, folder):
    listed = table(spark, folder, "orders").select("o_custkey", F.col("o_orderkey").alias("list_pos"))
    return ql.validation_sample(listed, "o_custkey").select("o_custkey", F.col("list_pos").alias("o_orderkey"))


@query("spot_check_sample")
def spot_check_sample(spark, folder):
    """Ten records by seeded hash: the same ten in every run."""
    return ql.spot_check_sample(values(spark, folder).select("url", "field", "value"))
