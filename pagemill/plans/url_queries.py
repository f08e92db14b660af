"""URL operators over the stored pages' addresses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators import crawl as cr
from pagemill.operators import redirects as rd
from pagemill.plans.catalog import big, query, table

# SQL pieces shared by the texts below; ``{u}`` is the URL expression
SCHEME = "regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
NETLOC = "regexp_extract({u}, '^[^:]+://([^/?#]*)', 1)"
PATH = "regexp_extract({u}, '^[^:]+://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def sql_path(u: str) -> str:
    return PATH.format(u=u)


def sql_norm(u: str) -> str:
    path = sql_path(u)
    return (
        f"lower({SCHEME.format(u=u)}) || '://' || lower({NETLOC.format(u=u)}) || "
        f"CASE WHEN {path} = '' THEN '/' ELSE {path} END"
    )


def sql_site(u: str) -> str:
    labels = f"string_split(split_part(lower({NETLOC.format(u=u)}), ':', 1), '.')"
    return (
        f"CASE WHEN len({labels}) >= 3 AND len({labels}[-1]) = 2 AND {labels}[-2] IN "
        f"('co','com','org','gov','ac','net','edu') THEN array_to_string({labels}[-3:], '.') "
        f"ELSE array_to_string({labels}[-2:], '.') END"
    )


def sql_folder(path: str) -> str:
    parts = f"string_split(trim({path}, '/'), '/')"
    return (
        f"'/' || array_to_string(list_transform({parts}[:len({parts}) - 1], "
        "lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '*' ELSE s END || '/'), '')"
    )


@query("url_norm", f"SELECT page_id, {sql_norm('url')} AS norm_url FROM pages")
def url_norm(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.normalise(F.col("url")).alias("norm_url"))


@query("url_site", f"SELECT page_id, {sql_site('url')} AS site FROM pages")
def url_site(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.site(F.col("url")).alias("site"))


@query("url_pattern", f"SELECT page_id, {sql_folder(sql_path('url'))} AS pattern FROM pages")
def url_pattern(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.folder_pattern(urls.path(F.col("url"))).alias("pattern"))


@query(
    "url_section",
    f"SELECT page_id, CASE WHEN trim({sql_path('url')}, '/') = '' THEN '' "
    f"ELSE '/' || split_part(trim({sql_path('url')}, '/'), '/', 1) || '/' END AS section FROM pages",
)
def url_section(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.first_section(F.col("url")).alias("section"))


@query(
    "url_shape",
    "SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS shape, "
    "CAST(regexp_extract_all(url, '[0-9]+')[-1] AS BIGINT) AS last_number, "
    f"CAST(len(string_split(trim({sql_path('url')}, '/'), '/')) AS BIGINT) AS depth FROM pages",
)
def url_shape(spark, folder):
    u = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", urls.digit_shape(u).alias("shape"), urls.last_number(u).alias("last_number"),
        big(urls.path_depth(u), "depth"),
    )


_DERIVED = """
SELECT o_orderkey, 'https://www.shop.co.uk' || CASE o_orderkey % 8
  WHEN 0 THEN '/files/Order-' || o_orderkey || '.PDF' WHEN 1 THEN '/orders/page/' || o_orderkey || '/'
  WHEN 2 THEN '/a-long-order-slug' WHEN 3 THEN '/cdn-cgi/x' || o_orderkey WHEN 4 THEN '/about-us'
  WHEN 5 THEN '/orders/' || (10000 + o_orderkey) WHEN 6 THEN '/feed.rss' ELSE '' END AS url FROM orders
"""


def derived_urls(spark, folder):
    """Addresses of many kinds made from the order keys."""
    table(spark, folder, "orders").createOrReplaceTempView("pagemill_orders")
    return spark.sql(_DERIVED.replace("FROM orders", "FROM pagemill_orders"))


@query(
    "url_kinds",
    f"WITH d AS ({_DERIVED}), p AS (SELECT *, {sql_path('url')} AS path FROM d) "
    "SELECT o_orderkey, url, "
    "regexp_matches(lower(path), '\\.(pdf|jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|pptx?|mp[34]|csv|xml|rss|ics)$') "
    "OR contains(url, '/cdn-cgi/') AS is_document, lower(path) LIKE '%.pdf' AS is_pdf, "
    "regexp_matches(path, '/(page|p|pg)/[0-9]+/?$') AS is_page_number, "
    "regexp_matches(string_split(rtrim(path, '/'), '/')[-1], '-.*-|[0-9]{4,}') AS slug_like, "
    f"{sql_site('url')} AS site FROM p",
)
def url_kinds(spark, folder):
    u = F.col("url")
    return derived_urls(spark, folder).select(
        "o_orderkey", "url", urls.is_document(u).alias("is_document"), urls.is_pdf(u).alias("is_pdf"),
        urls.is_page_number(u).alias("is_page_number"), urls.looks_like_slug(u).alias("slug_like"),
        urls.site(u).alias("site"),
    )


def _probe_sql() -> str:
    q, path = QUERY.format(u="url"), sql_path("url")
    head, frag = "regexp_replace(url, '[?#].*$', '')", "regexp_extract(url, '(#.*)$', 1)"

    def keyed(key: str, n: int) -> str:
        merged = (
            f"CASE WHEN regexp_matches({q}, '(^|&){key}=[^&]') THEN regexp_replace({q}, '(^|&){key}=[^&]*', '\\1{key}={n}') "
            f"WHEN {q} = '' THEN '{key}={n}' ELSE {q} || '&{key}={n}' END"
        )
        return f"{head} || '?' || {merged} || {frag}"

    rows = [("?page={}", 0, keyed("page", 7)), ("?page={}", -1, keyed("page", 6)), ("?paged={}", 0, keyed("paged", 7)),
            ("?p={}", 0, keyed("p", 7)), ("?pg={}", 0, keyed("pg", 7)),
            ("/page/{}/", 0, f"rtrim({head}, '/') || '/page/7/' || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END || {frag}")]
    del path
    return " UNION ALL ".join(
        f"SELECT page_id, '{shape}' AS shape, CAST({off} AS BIGINT) AS \"offset\", {u} AS url FROM pages" for shape, off, u in rows
    )


@query("page_candidates", _probe_sql())
def page_candidates(spark, folder):
    rows = table(spark, folder, "pages").select("page_id", F.inline(urls.page_candidates(F.col("url"), F.lit(7))))
    return rows.select("page_id", "shape", big("offset", "offset"), "url")


@query(
    "guessed_urls",
    "WITH g AS (SELECT DISTINCT regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || '/' || "
    "left(trim(regexp_replace(lower(r_name), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS url FROM pages CROSS JOIN region), "
    f"k AS (SELECT DISTINCT rtrim({sql_norm('url')}, '/') AS url FROM pages) SELECT url FROM g WHERE url NOT IN (SELECT url FROM k)",
)
def guessed_urls(spark, folder):
    """Root + slug of every listing name (here the region names: a fixed handful), minus the known pages."""
    names = table(spark, folder, "region").agg(F.collect_list("r_name").alias("names"))
    pages = table(spark, folder, "pages")
    plans = pages.select(urls.root(F.col("url")).alias("root")).distinct().select(
        F.col("root").alias("site"), "root", names.scalar().alias("names"))
    return cr.guessed_addresses(plans, pages.select(urls.normalise(F.col("url")).alias("url"))).select("url")


@query(
    "canonical_urls",
    "WITH n AS (SELECT c_custkey AS k, c_custkey // 7 AS g, 'https://www.moved.org/c/' || c_custkey AS url FROM customer), "
    "c AS (SELECT *, lead(url) OVER (PARTITION BY g ORDER BY k) AS next, last_value(url) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, "
    "count(*) OVER (PARTITION BY g) AS n, min(url) OVER (PARTITION BY g) AS least FROM n) "
    "SELECT url, CASE WHEN g % 5 = 4 THEN least ELSE last END AS canonical FROM c WHERE next IS NOT NULL OR (g % 5 = 4 AND n > 1)",
)
def canonical_urls(spark, folder):
    """Chains of one to six redirects, and every fifth one a circle; some addresses are also stored as themselves."""
    keys = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.col("c_custkey") / 7).alias("g"))
    url = F.concat(F.lit("https://WWW.moved.org/c/"), F.col("k").cast("string"))
    group = Window.partitionBy("g").orderBy("k")
    first = F.first("k").over(group)
    to = F.coalesce(F.lead("k").over(group), F.when(F.col("g") % 5 == 4, first))
    moved = keys.select(url.alias("url"), F.concat(F.lit("https://www.moved.org/c/"), to.cast("string"), F.lit("#top")).alias("final_url"))
    fetches = moved.unionByName(keys.where("k % 3 = 0").select(url.alias("url"), url.alias("final_url")))
    return rd.canonical_addresses(rd.redirect_edges(fetches)).select("url", "canonical")
