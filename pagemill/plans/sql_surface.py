"""The library in SQL: scalar functions for URLs, texts and labels, and a table function from pages to elements.

The scalars are SQL functions, so the optimizer puts their bodies into the plan like any other expression; no Python
runs. Their patterns are those of :mod:`pagemill.functions`, and tests hold both forms against each other. The table
function parses Arrow batches of pages where they are: ``SELECT * FROM page_elements(TABLE(pages))`` shuffles nothing.
With ``PARTITION BY`` the engine first moves whole pages by that key, which only a query that needs its pages together
should ask for."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions import urls
from pagemill.operators.dom import build
from pagemill.plans.catalog import query, table
from pagemill.plans.url_queries import sql_folder, sql_norm, sql_path, sql_site

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _text(value: str) -> str:
    if "'" in value:
        raise ValueError("patterns with a quote don't fit a raw literal")
    return f"r'{value}'"


_SECOND_LEVELS = ", ".join(_text(x) for x in urls.COUNTRY_SECOND_LEVELS)
_MONTHS = ", ".join(_text(m) for m in tx.MONTHS)
_SEGMENTS = "split(regexp_replace(path, '^/+|/+$', ''), '/')"


def _numeric(pattern: str) -> str:
    parts = ", ".join(f"regexp_extract(s, {_text(pattern)}, {g})" for g in (1, 2, 3))
    return f"CASE WHEN s RLIKE {_text(pattern)} THEN concat_ws('-', {parts}) END"


def _named(pattern: str, day: int, month: int) -> str:
    p = _text(pattern)
    number = f"pagemill_month(regexp_extract(s, {p}, {month}))"
    return (f"CASE WHEN s RLIKE {p} AND {number} IS NOT NULL THEN concat_ws('-', regexp_extract(s, {p}, 3), "
            f"lpad(CAST({number} AS STRING), 2, '0'), lpad(regexp_extract(s, {p}, {day}), 2, '0')) END")


# name, parameters, type, body; a function may use those before it. The first ones are parts of others.
SCALARS = (
    ("pagemill_url_part", "url STRING, i INT", "STRING", f"regexp_extract(url, {_text(urls._PARTS)}, i)"),
    ("pagemill_url_joined", "s STRING, n STRING, p STRING", "STRING",
     "concat(CASE WHEN s = '' THEN '' ELSE concat(lower(s), ':') END, CASE WHEN n = '' THEN '' ELSE concat('//', lower(n)) END, "
     "CASE WHEN p = '' AND n = '' THEN '/' WHEN n = '' OR startswith(p, '/') THEN p ELSE concat('/', p) END)"),
    ("pagemill_registrable", "p ARRAY<STRING>", "STRING",
     f"CASE WHEN size(p) >= 3 AND length(element_at(p, -1)) = 2 AND coalesce(get(p, size(p) - 2) IN ({_SECOND_LEVELS}), FALSE) "
     "THEN array_join(slice(p, -3, 3), '.') WHEN size(p) >= 2 THEN array_join(slice(p, -2, 2), '.') ELSE array_join(p, '.') END"),
    ("pagemill_folder", "s ARRAY<STRING>", "STRING",
     r"concat('/', array_join(transform(slice(s, 1, size(s) - 1), x -> concat(CASE WHEN x RLIKE r'(?U)^\d+$' THEN '*' ELSE x END, '/')), ''))"),
    ("pagemill_section", "segment STRING", "STRING", "CASE WHEN segment = '' THEN '' ELSE concat('/', segment, '/') END"),
    ("pagemill_month", "name STRING", "BIGINT", f"nullif(array_position(array({_MONTHS}), lower(substring(name, 1, 3))), 0)"),
    ("pagemill_date_of", "s STRING", "STRING",
     f"coalesce({_numeric(tx.YEAR_MONTH_DAY)}, {_numeric(tx.YEAR_MONTH_DAY_SLASHED)}, {_named(tx.DAY_MONTH_YEAR, 1, 2)}, "
     f"{_named(tx.MONTH_DAY_YEAR, 2, 1)}, substring(s, 1, 40))"),
    ("url_normalised", "url STRING", "STRING", "pagemill_url_joined(pagemill_url_part(url, 1), pagemill_url_part(url, 2), pagemill_url_part(url, 3))"),
    ("url_site", "url STRING", "STRING", r"pagemill_registrable(split(split_part(lower(pagemill_url_part(url, 2)), ':', 1), r'\.'))"),
    ("url_folder", "path STRING", "STRING", f"pagemill_folder({_SEGMENTS})"),
    ("url_section", "url STRING", "STRING", "pagemill_section(split_part(regexp_replace(pagemill_url_part(url, 3), '^/+|/+$', ''), '/', 1))"),
    ("url_reads_like_item", "url STRING", "BOOLEAN",
     r"regexp_extract(regexp_replace(pagemill_url_part(url, 3), '/+$', ''), '([^/]*)$', 1) RLIKE r'-.*-|\d{4,}'"),
    ("text_slug", "value STRING", "STRING", "substring(regexp_replace(regexp_replace(lower(value), '[^a-z0-9]+', '-'), '^-+|-+$', ''), 1, 60)"),
    ("text_clean", "value STRING", "STRING", r"trim(regexp_replace(coalesce(value, ''), r'(?U)\s+', ' '))"),
    ("text_iso_date", "value STRING", "STRING", "pagemill_date_of(text_clean(value))"),
    ("label_key", "label STRING", "STRING", f"regexp_replace(lower(regexp_replace(text_clean(label), {_text(tx.LABEL_END)}, '')), {_text(tx.LABEL_PLURAL)}, '')"),
)

ELEMENTS = "url string, pre int, parent int, last int, tag string, attrs map<string,string>, own_text string"


@F.arrow_udtf(returnType=ELEMENTS)
class PageElements:
    """One row per element of every page, in document order: its place, its last descendant's, tag, attributes and the
    text strings directly in it. Pages come with ``url`` and ``html`` and may have any other columns. A NULL or empty page
    is its document element alone; repeated pages give their elements each."""

    def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
        trees = build(pages.column("html"))
        for url, tree in zip(pages.column("url"), trees, strict=True):
            nodes, strings = tree["nodes"].values, tree["strings"].values
            own: dict[int, list[str]] = {}
            for node, kind, text in zip(strings.field("node").to_pylist(), strings.field("kind").to_pylist(), strings.field("text").to_pylist(), strict=True):
                if kind == "t":
                    own.setdefault(node, []).append(text)
            columns = [nodes.field(f) for f in ("pre", "parent", "last", "tag", "attrs")]
            texts = pa.array([" ".join("".join(own.get(i, ())).split()) for i in range(len(nodes))], pa.string())
            yield pa.Table.from_arrays([pa.array([url.as_py()] * len(nodes), pa.string()), *columns, texts],
                                       names=["url", "pre", "parent", "last", "tag", "attrs", "own_text"])


def register_functions(spark: SparkSession) -> None:
    """All functions of this module as temporary functions of the session."""
    for name, parameters, returns, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    spark.udtf.register("page_elements", PageElements)


@query(
    "sql_functions",
    f"SELECT page_id, {sql_norm('url')} AS norm_url, {sql_site('url')} AS site, {sql_folder(sql_path('url'))} AS folder, "
    "trim(left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60)) AS slug FROM pages",
)
def sql_functions(spark, folder):
    register_functions(spark)
    return spark.sql("SELECT page_id, url_normalised(url) AS norm_url, url_site(url) AS site, url_folder(parse_url(url, 'PATH')) AS folder, "
                     "text_slug(url) AS slug FROM {pages}", pages=table(spark, folder, "pages"))


@query(
    "sql_elements",
    "WITH t AS (SELECT url, unnest(regexp_extract_all(lower(html), '<(a|p|li|h1|h2|nav|footer)[\\s>]', 1)) AS tag FROM pages) "
    "SELECT tag, count(*) AS elements, count(DISTINCT url) AS pages FROM t GROUP BY 1",
)
def sql_elements(spark, folder):
    """The table function over all pages, counted in SQL; the pages stay where they were read."""
    register_functions(spark)
    table(spark, folder, "pages").select("url", "html").createOrReplaceTempView("pagemill_pages")
    return spark.sql("SELECT tag, count(*) AS elements, count(DISTINCT url) AS pages FROM page_elements(TABLE(pagemill_pages)) "
                     "WHERE tag IN ('a', 'p', 'li', 'h1', 'h2', 'nav', 'footer') GROUP BY tag")
