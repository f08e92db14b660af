"""Text operators over documents, conversations and sentences written from orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions import urls
from pagemill.operators import ledger
from pagemill.plans.catalog import big, query, table


@query(
    "text_clean",
    "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x{000B}\\x{0085}\\p{Z}]+', ' ', 'g'))) AS digest FROM documents",
)
def text_clean(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(tx.clean(F.col("text"))).alias("digest"))


@query(
    "text_slug",
    "SELECT doc_id, left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug FROM documents",
)
def text_slug(spark, folder):
    return table(spark, folder, "documents").select("doc_id", urls.slug(F.col("text")).alias("slug"))


def written_dates(spark, folder):
    """Order dates in the forms pages use."""
    d = F.col("o_orderdate")
    shown = (
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("Open - no closing date"))
        .when(F.col("o_orderkey") % 6 == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm"))
        .when(F.col("o_orderkey") % 6 == 1, F.date_format(d, "yyyy/MM/dd"))
        .when(F.col("o_orderkey") % 6 == 2, F.concat(F.lit("on "), F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMMM yyyy")))
        .when(F.col("o_orderkey") % 6 == 3, F.date_format(d, "MMM d, yyyy"))
        .when(F.col("o_orderkey") % 6 == 4, F.date_format(d, "dd-MMM-yyyy"))
        .otherwise(F.date_format(d, "MMMM. d yyyy"))
    )
    return table(spark, folder, "orders").withColumn("shown", shown)


@query(
    "iso_dates",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'Open - no closing date' "
    "ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
)
def iso_dates(spark, folder):
    return written_dates(spark, folder).select("o_orderkey", tx.to_iso(F.col("shown")).alias("iso"))


@query(
    "date_mentions",
    "SELECT o_orderkey, CAST(3 AS BIGINT) AS mentions, strftime(o_orderdate, '%-d %b %Y') AS first_mention, "
    "strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
)
def date_mentions(spark, folder):
    d = F.col("o_orderdate")
    text = F.concat(
        F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" opened "), F.date_format(d, "d MMM yyyy"),
        F.lit(", due "), F.date_format(d, "MMMM d, yyyy"), F.lit("; filed "), F.date_format(d, "yyyy-MM-dd"), F.lit(" x17 1 2 3000."),
    )
    return table(spark, folder, "orders").select(
        "o_orderkey", big(tx.date_mentions(text), "mentions"), tx.first_date_mention(text).alias("first_mention"),
        tx.timestamp_to_date(F.date_format(d, "  yyyy-MM-dd'T'HH:mm:ss")).alias("day"),
    )


@query(
    "doi_numbers",
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '10.' || (1000 + c_custkey % 9000) || '/cust.' || c_custkey END AS doi FROM customer",
)
def doi_numbers(spark, folder):
    key = F.col("c_custkey").cast("string")
    number = F.concat(F.lit("10."), (1000 + F.col("c_custkey") % 9000).cast("string"), F.lit("/cust."), key)
    text = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("see 10.12/"), key)).otherwise(
        F.concat(F.lit("https://doi.org/"), number, F.lit(").,")))
    return table(spark, folder, "customer").select("c_custkey", tx.doi(text).alias("doi"))


@query(
    "result_totals",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey + 5000000 "
    "WHEN 2 THEN greatest(o_orderkey, 77) ELSE NULL END AS total FROM orders",
)
def result_totals(spark, folder):
    key, k = F.col("o_orderkey"), F.col("o_orderkey") % 4
    n = key.cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("99999999 items here. Showing 1-20 of "), n, F.lit(" results today")))
        .when(k == 1, F.concat(F.lit("Filter: 99999999 reports "), F.format_string("%,d", key + 5000000), F.lit(" results found")))
        .when(k == 2, F.concat(F.lit("77 documents and "), n, F.lit(" Publications")))
        .otherwise(F.concat(n, F.lit(" other things")))
    )
    return table(spark, folder, "orders").select("o_orderkey", tx.result_total(text).alias("total"))


_LABELS = (
    ("Next", True, False), ("Next ›", True, False), ("Next page →", True, False), ("»", True, False), ("Load more", True, False),
    ("Older posts", True, False), ("About", False, False), ("", False, False), ("Next steps", False, False),
    ("View all publications", False, True), ("See all", False, True), ("Full archive", False, True), ("All reports", False, True),
    ("Overall", False, False), ("More results ›", True, False), ("show more", True, False),
)


def _label_case(i: int) -> str:
    quoted = (lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower())
    return "CASE o_orderkey % 16 " + " ".join(f"WHEN {k} THEN {quoted(row[i])}" for k, row in enumerate(_LABELS)) + " END"


@query("paging_labels", f"SELECT o_orderkey, {_label_case(0)} AS label, {_label_case(1)} AS is_next, {_label_case(2)} AS is_view_all FROM orders")
def paging_labels(spark, folder):
    labels = F.array(*[F.lit(row[0]) for row in _LABELS])
    rows = table(spark, folder, "orders").select("o_orderkey", F.get(labels, (F.col("o_orderkey") % 16).cast("int")).alias("label"))
    return rows.select(
        "*", tx.is_next_label(F.col("label")).alias("is_next"), tx.is_view_all_label(F.col("label")).alias("is_view_all"))


@query(
    "person_names",
    "SELECT c_custkey, c_custkey % 5 IN (0, 3) AS is_name, "
    "CAST(CASE WHEN c_custkey % 5 = 4 THEN 1 ELSE 2 END AS BIGINT) AS n_people FROM customer",
)
def person_names(spark, folder):
    segment = F.initcap("c_mktsegment")
    k = F.col("c_custkey") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("Ann "), segment)).when(k == 1, F.concat(F.lit("@"), segment, F.lit(" x")))
        .when(k == 2, F.concat(F.lit("See More "), segment)).when(k == 3, F.concat(F.lit("Éva de "), segment)).otherwise(segment)
    )
    people = F.when(k == 4, F.concat(segment, F.lit(" (Berlin, DE)"))).otherwise(
        F.concat(F.lit("A "), segment, F.lit(" (Paris, FR), B "), segment, F.lit(" (Rome, IT)")))
    return table(spark, folder, "customer").select(
        "c_custkey", tx.is_person_name(text).alias("is_name"),
        big(F.size(tx.distinct_filled(tx.split_people(people), 20)), "n_people"),
    )


@query(
    "label_keys",
    "SELECT c_custkey, regexp_replace(lower(c_mktsegment), 's$', '') AS key, TRUE AS same FROM customer",
)
def label_keys(spark, folder):
    raw = F.concat(F.lit("  "), F.initcap("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.lit(" : ")).otherwise(F.lit(":")))
    plural = F.concat(F.regexp_replace(F.col("c_mktsegment"), "S$", ""), F.lit("S"))
    return table(spark, folder, "customer").select(
        "c_custkey", tx.label_key(raw).alias("key"), (tx.label_key(raw) == tx.label_key(plural)).alias("same"))


@query(
    "stable_classes",
    "SELECT p_partkey, lower(p_type) || '.' || 'item-box' AS classes, p_name AS text FROM part",
)
def stable_classes(spark, folder):
    css = F.array(F.lower("p_type"), F.concat(F.lit("brand-"), F.col("p_size").cast("string")), F.lit("item-box"), F.lit("late"))
    text = F.concat(F.col("p_type"), F.lit(": "), F.col("p_name"))
    return table(spark, folder, "part").select(
        "p_partkey", F.array_join(tx.stable_classes(css), ".").alias("classes"),
        tx.drop_leading_label(text, F.col("p_type")).alias("text"),
    )


@query(
    "model_answers",
    "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE '{\"turn\": ' || turn || ', \"len\": [' || length(text) || ']}' END AS json FROM conversations",
)
def model_answers(spark, folder):
    """Answers with thinking, fences and chatter around their JSON; the chatter is the conversation itself."""
    body = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit(', "len": ['), F.length("text").cast("string"), F.lit("]}"))
    plain = F.regexp_replace("text", r"[\[\]{}]", "")
    answer = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("<think>{}</think> no json "), plain)).otherwise(
        F.concat(F.lit("<think>[1]\n"), plain, F.lit("</think> Sure:\n```json\n"), body, F.lit("\n```")))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", answer.alias("text"))
    return ledger.json_answers(rows).select("conv_id", "turn", "json")


@query(
    "usage_cost",
    "WITH s AS (SELECT role AS stage, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS tokens_in, "
    "CAST(sum(CASE WHEN turn % 5 = 0 THEN 0 ELSE turn * 100 END) AS BIGINT) AS tokens_out FROM conversations GROUP BY role), "
    "r AS (SELECT *, round((tokens_in * 0.30::DOUBLE + tokens_out * 1.20::DOUBLE) / 1e6, 4) AS usd FROM s) "
    "SELECT * FROM r UNION ALL SELECT 'total', CAST(sum(calls) AS BIGINT), CAST(sum(tokens_in) AS BIGINT), "
    "CAST(sum(tokens_out) AS BIGINT), round(sum(usd), 4) FROM r",
)
def usage_cost(spark, folder):
    calls = table(spark, folder, "conversations").select(
        F.col("role").alias("stage"), F.length("text").alias("tokens_in"),
        F.when(F.col("turn") % 5 == 0, F.lit(None)).otherwise(F.col("turn") * 100).alias("tokens_out"),
    )
    return ledger.usage_cost(calls)


@query(
    "target_definitions",
    "SELECT n_nationkey, n_name || ': orders from ' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE "
    "' Not: a' || n_nationkey || '; b; c; d.' END AS definition FROM nation",
)
def target_definitions(spark, folder):
    others = F.when(F.col("n_nationkey") % 3 != 0, F.array(
        F.concat(F.lit("a"), F.col("n_nationkey").cast("string")), *[F.lit(c) for c in "bcdef"]))
    plan = F.struct(F.col("n_name").alias("target"), F.concat(F.lit("orders from "), "n_name").alias("description"), others.alias("confusables"))
    return table(spark, folder, "nation").withColumn("plan", plan).select(
        "n_nationkey", tx.target_definition(F.col("plan")).alias("definition"))
