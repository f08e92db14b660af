"""Paging through listings rendered from the orders of each customer; the SQL reads the orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.operators import facts as fc
from pagemill.operators import listing as ls
from pagemill.plans import rendered as rd
from pagemill.plans.catalog import big, query, table

_N = rd.PER_PAGE
# a site without controls is probed: its second page must bring three new entries
_ORDERS = (
    f"WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, "
    f"count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), "
    f"w AS (SELECT *, (pos - 1) // {_N} + 1 AS page_no, o_custkey % 4 = 3 AND n < {_N + 3} AS single FROM o)"
)


def _walk(spark, folder):
    listings, pages = rd.order_listings(spark, folder)
    return ls.walk_listings(listings, ls.listing_pages(pages))


@query(
    "walk_items",
    f"{_ORDERS} SELECT o_custkey AS listing_id, pos AS list_pos, page_no, 'https://www.shop' || o_custkey || '.org/orders/order-no-' || o_orderkey AS url, "
    f"'Order number ' || o_orderkey || ' of customer ' || o_custkey AS title FROM w WHERE pos <= 100 AND (page_no = 1 OR NOT single)",
)
def walk_items(spark, folder):
    return _walk(spark, folder)[0]


@query(
    "walk_info",
    f"{_ORDERS}, s AS (SELECT o_custkey, max(page_no) AS pages, max(n) AS n, bool_or(single) AS single FROM w GROUP BY 1) "
    "SELECT o_custkey AS listing_id, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 2 THEN 'view-all -> ' ELSE '' END || "
    "CASE WHEN pages = 1 OR single THEN 'single-page' WHEN o_custkey % 4 = 3 THEN 'probe' ELSE 'next-link' END AS mode, "
    "'/orders/' AS item_pattern, CASE WHEN single THEN 1 ELSE pages END AS pages_fetched, "
    "CASE WHEN pages = 1 THEN NULL WHEN o_custkey % 4 = 1 THEN pages END AS pager_pages, least(n, 4) AS total_results_est FROM s",
)
def walk_info(spark, folder):
    info = _walk(spark, folder)[1]
    return info.select(
        "listing_id", "mode", "item_pattern", "pages_fetched",
        F.when(F.col("listing_id") % 4 == 1, F.col("total_pages_est")).alias("pager_pages"), "total_results_est")


@query(
    "pager_links",
    f"{_ORDERS} SELECT DISTINCT o_custkey, page_no, CASE WHEN page_no * {_N} >= n THEN NULL WHEN o_custkey % 4 = 0 THEN '?p=' || (page_no + 1) "
    f"WHEN o_custkey % 4 = 1 THEN '?page=' || page_no WHEN o_custkey % 4 = 2 THEN '?start=' || (page_no * {_N}) END AS following FROM w",
)
def pager_links(spark, folder):
    """The next page each listing page points to."""
    _, pages = rd.order_listings(spark, folder)
    rows = ls.listing_pages(pages).where("gpath = '/orders/'")
    number = F.regexp_extract("url", r"(\d+)$", 1).try_cast("int")
    key = F.regexp_extract("url", r"//www\.shop(\d+)", 1).cast("bigint")
    page_no = (
        F.when(~F.col("url").contains("?"), 1).when(key % 4 == 1, number + 1)
        .when(key % 4 == 2, (number / _N).cast("int") + 1).otherwise(number)
    )
    return rows.select(
        key.alias("o_custkey"), big(page_no, "page_no"),
        F.regexp_extract(ls.next_url(F.col("pager"), page_no), r"(\?.*)$", 1).alias("following"))


@query(
    "grown_lists",
    f"{_ORDERS}, m AS (SELECT * FROM w WHERE o_custkey % 4 = 3 AND page_no > 1) SELECT 'https://www.shop' || o_custkey || '.org/list/' AS hub, count(*) AS n_new FROM m GROUP BY 1",
)
def grown_lists(spark, folder):
    """A list read before and after its "load more" was exhausted (here: all its pages in one)."""
    _, pages = rd.order_listings(spark, folder)
    plain = pages.where(F.col("url").rlike(r"/list/(\?paged=\d+)?$"))
    hub = F.regexp_replace("url", r"\?.*$", "")
    grown = plain.groupBy(hub.alias("url")).agg(F.array_join(F.array_sort(F.collect_list("html")), "\n").alias("html"))
    first = ls.listing_pages(plain.where(~F.col("url").contains("?")))
    out = ls.grown_items(first, ls.listing_pages(grown)).where(F.size("new") > 0)
    return out.select(F.col("url").alias("hub"), big(F.size("new"), "n_new"))


@query(
    "listed_facts",
    "WITH o AS (SELECT c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS list_pos, c_nationkey FROM customer) "
    "SELECT c_nationkey AS listing_id, list_pos, 'Customer ' || c_custkey AS list_title, c_name AS title FROM o WHERE c_custkey % 4 > 0",
)
def listed_facts(spark, folder):
    """Listing entries with the facts of the pages that were stored for them, in the listing's order."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    listed = table(spark, folder, "customer").select(
        F.col("c_nationkey").cast("int").alias("listing_id"), F.row_number().over(w).cast("bigint").alias("list_pos"),
        F.format_string("https://www.people.org/p/%d", "c_custkey").alias("url"),
        F.format_string("Customer %d", "c_custkey").alias("list_title"))
    stored = rd.customer_pages(spark, folder).where("c_custkey % 4 > 0")
    return fc.listed_facts(listed, fc.publication_facts(stored)).select("listing_id", "list_pos", "list_title", "title")
