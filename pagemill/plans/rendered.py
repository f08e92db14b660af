"""Pages rendered from the given tables, row by row, so that extraction can be checked against the table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.plans.catalog import dealt, table
from pagemill.plans.text_queries import written_dates

_PART_A = (
    '<!DOCTYPE html><html><head><title>%1$s | shop</title><meta name="viewport" content="width=1">'
    '<meta name="keywords" content="%2$s, %3$s"><script type="application/ld+json">{"@type": "Product", "name": "%1$s"}'
    '</script><style>p{}</style></head><body><header><nav><a href="/">Home</a><a href="/part/">Parts</a></nav></header>'
    '<main><article><h1 class="title big2">%1$s</h1>\n<div class="facts">\n <strong>Brand</strong>: %2$s '
    '<strong>Type:</strong> %3$s </div><dl><dt>Weight:</dt><dd>1</dd><dt>Size:</dt><dd><span>%4$d</span></dd></dl>'
    '<table><tr><th>Price</th><td>$%5$.2f</td></tr></table><!-- price --><a href="/files/part-%6$d.pdf">Download sheet</a>'
    '<div class="more"><p><a href="/part/%7$d">Another part with a long title</a></p><time>01 April 2026</time></div>'
    '</article></main><footer>&copy; shop <strong>Brand</strong>: none</footer></body></html>'
)
_PART_B = (
    '<html><head><meta property="og:site_name" content="shop"><script type="application/ld+json">{"@graph": [{"@type": '
    '"BreadcrumbList", "name": "Home"}, {"@type": "Product", "name": "%1$s"}]}</script></head><body>'
    '<div id="cookie-bar">Brand: cookies</div><div class="item"><div class="facts"><b>Makes</b> %2$s <b>Kind:</b> %3$s</div>'
    '<dl><dt>Width:</dt><dd>%4$d</dd></dl><p>Cost: $%5$.2f per unit,\nplus shipping.</p>'
    '<p class="links"><a href="#top">up</a> <a href="sheet-%6$d.html?download=1">Sheet</a></p><ul class="tags"><li>%2$s</li><li>%3$s</li></ul>'
    '<aside>Kind: none</aside></div></body></html>'
)


def part_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Item pages in two layouts of the same site; the second needs every field's fallback."""
    args = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice", "p_partkey", F.col("p_partkey") + 1]
    html = F.when(F.col("p_partkey") % 2 == 0, F.format_string(_PART_A, *args)).otherwise(F.format_string(_PART_B, *args))
    return dealt(table(spark, folder, "part")).select(
        "p_partkey", F.format_string("https://www.parts.org/part/%d", "p_partkey").alias("url"), html.alias("html"),
        F.lit("parts").alias("recipe"), F.lit("/part/").alias("item_pattern"),
    )


PART_SELECTORS = [
    ("title", "text", ["article > h1.title", "ld:name"]),
    ("brand", "text", ["kv:div.facts || Brand", "kv:div.facts || Make"]),
    ("kind", "text", ["kv:div.facts || Type", "kv:div.facts || Kind"]),
    ("size", "number", ["dl > dd || Size:", "dl > dd || Width:"]),
    ("price", "money", ["main > article > table > tr > td || Price", r"re:(?i)cost:\s*(\$[\d.]+)"]),
    ("sheet", "url", ["article > a", "div.item > p.links"]),
    ("tags", "list", ["meta:keywords", "div.item > ul.tags"]),
]

_ORDER = (
    '<html><body><div role="navigation">Date: 1 Jan 1900</div><main><h1>Order %1$d</h1><dl><dt>Date</dt><dd>%2$s</dd>'
    '<dt>Priority:</dt><dd>%3$s</dd><dt>Total</dt><dd>£%4$.2f</dd><dt>Status</dt><dd>%5$s</dd></dl>%6$s</main></body></html>'
)


def order_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their date in several written forms and their parts as a list."""
    lines = (
        table(spark, folder, "lineitem").groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    )
    items = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<li>Part "), x["l_partkey"].cast("string"), F.lit("</li>"))), "\n")
    listed = F.when(F.col("lines").isNotNull(), F.concat(F.lit('<ul class="parts">'), items, F.lit("</ul>"))).otherwise(F.lit(""))
    orders = written_dates(spark, folder).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    orders = dealt(orders)
    html = F.format_string(_ORDER, "o_orderkey", "shown", "o_orderpriority", "o_totalprice", "o_orderstatus", listed)
    url = F.format_string("https://www.shop%d.org/orders/order-no-%d", "o_custkey", "o_orderkey")
    return orders.select(
        "o_orderkey", url.alias("url"), html.alias("html"), F.lit("orders").alias("recipe"), F.lit("/orders/").alias("item_pattern"),
    )


ORDER_SELECTORS = [
    ("placed", "date", ["main > dl > dd || Date"]),
    ("priority", "text", ["kv:main > dl || priority"]),
    ("total", "money", ["main > dl > dd || Total:"]),
    ("status", "text", ["main > dl > dd || Status", "meta:status"]),
    ("parts", "list", ["main > ul.parts"]),
    ("buyer", "people", ["main > p.buyer", "meta:buyer"]),
]


def selector_rows(spark: SparkSession, recipe: str, selectors) -> DataFrame:
    rows = [
        (recipe, pos, name, kind, prio, selector)
        for pos, (name, kind, many) in enumerate(selectors) for prio, selector in enumerate(many)
    ]
    return spark.createDataFrame(rows, "recipe string, field_pos int, field string, type string, prio int, selector string")


_FACTS = (
    '<html><head><meta name="Citation_Title" content="%1$s"><meta name="citation_author" content="Ann %2$s">'
    '<meta name="citation_author" content="Bob %2$s"><meta name="citation_author" content="Ann %2$s">'
    '<meta name="citation_publication_date" content="%3$s"><meta name="citation_pdf_url" content="https://www.people.org/f/%4$d.pdf">'
    '<meta name="citation_doi" content="doi:10.5555/c.%4$d)."><meta name="description" content="Customer of %2$s">'
    '<meta name="keywords" content="%2$s, vip , %2$s"><meta property="og:type" content="profile"></head><body><h1>x</h1></body></html>',
    '<html><head><title>no</title><script type="application/ld+json">{"@context": "s", "@graph": [{"@type": "WebSite", "name": '
    '"no"}, {"@type": "Report", "headline": "%1$s", "author": [{"name": "Ann %2$s"}, "Bob %2$s"], "datePublished": '
    '"%3$sT10:00:00", "description": "Customer of %2$s", "keywords": ["%2$s", "vip"]}]}</script></head><body>'
    '<a href="../f/%4$d.pdf">pdf</a><a href="https://doi.org/10.5555/c.%4$d">doi</a></body></html>',
    '<html><head><title>%1$s - people</title><meta name="og:description" content="Customer of %2$s"></head><body>'
    '<h1>%1$s</h1><time datetime="%3$s">then</time><div class="the-authors"><a>See More</a><a>Ann %2$s</a><a>@ann</a>'
    '<span><a>Bob %2$s</a></span></div><a href="/f/%4$d.pdf">pdf</a><a href="https://doi.org/10.5555/c.%4$d">doi</a>'
    '<script type="application/ld+json">{not json</script></body></html>',
)


def customer_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Publication-like pages: citation tags, structured data only, or nothing but the page."""
    day = F.date_format(F.date_add(F.lit("1992-01-01"), F.col("c_nationkey").cast("int")), "yyyy-MM-dd")
    args = ["c_name", F.initcap("c_mktsegment"), day, "c_custkey"]
    forms = [F.format_string(form, *args) for form in _FACTS]
    html = F.when(F.col("c_custkey") % 3 == 0, forms[0]).when(F.col("c_custkey") % 3 == 1, forms[1]).otherwise(forms[2])
    return dealt(table(spark, folder, "customer")).select(
        "c_custkey", F.format_string("https://www.people.org/p/%d", "c_custkey").alias("url"), html.alias("html"))


PER_PAGE = 4


def order_listings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One site per customer with a paged listing of its orders, by ``c_custkey % 4``: rel=next links; a numbered,
    zero-based pager; a landing page with a "view all" link to an archive with "Next" labels; no control at all.
    Returns (listings, pages)."""
    by_customer = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey").withColumn(
        "at", F.row_number().over(by_customer) - 1)
    entry = F.format_string(
        '<li><a href="/orders/order-no-%1$d">Order number %1$d of customer %2$d</a></li>', "o_orderkey", "o_custkey")
    per_page = orders.groupBy("o_custkey", F.floor(F.col("at") / PER_PAGE).cast("int").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("at", entry.alias("html")))).alias("entries"), F.count(F.lit(1)).alias("n"))
    counts = orders.groupBy("o_custkey").agg(F.ceil(F.count(F.lit(1)) / PER_PAGE).cast("int").alias("n_pages"))
    pages = dealt(per_page.join(counts, "o_custkey"))
    form, last = F.col("o_custkey") % 4, F.col("k") == F.col("n_pages") - 1
    site = F.format_string("https://www.shop%d.org", "o_custkey")
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n_pages")), lambda i: F.format_string(
        '<a href="?page=%1$d">%2$s</a>', i - 1, F.when(i % 2 == 0, F.concat(F.lit("Page "), i.cast("string"))).otherwise(i.cast("string")))), " ")
    control = (
        F.when((form == 0) & ~last, F.format_string('<link rel="prev next" href="?p=%d">', F.col("k") + 2))
        .when((form == 1) & (F.col("n_pages") > 1), F.concat(F.lit('<div class="pager">'), numbers, F.lit("</div>")))
        .when((form == 2) & ~last, F.format_string('<a href="/archive/?start=%d">Next ›</a>', (F.col("k") + 1) * PER_PAGE))
        .otherwise(F.lit(""))
    )
    address = (
        F.when(form == 2, F.concat(site, F.lit("/archive/"), F.when(F.col("k") > 0, F.format_string("?start=%d", F.col("k") * PER_PAGE)).otherwise(F.lit(""))))
        .otherwise(F.concat(site, F.lit("/list/"), F.when(F.col("k") > 0, F.when(
            form == 0, F.format_string("?p=%d", F.col("k") + 1)).when(form == 1, F.format_string("?page=%d", F.col("k")))
            .otherwise(F.format_string("?paged=%d", F.col("k") + 1))).otherwise(F.lit(""))))
    )
    nav = F.lit('<nav><a href="/about/">About</a><a href="/list/">Orders</a></nav>')
    total = F.format_string("<p>Showing a page of %d items</p>", "n")
    body = F.concat(nav, F.lit("<main>"), total, F.lit("<ul>"), F.array_join(F.transform("entries", lambda e: e["html"]), ""), F.lit("</ul>"), control, F.lit("</main>"))
    landing = counts.where(form == 2).select(
        F.concat(site, F.lit("/list/")).alias("url"),
        F.concat(nav, F.lit('<main><p>Some of our orders</p><a href="/archive/">View all orders</a></main>')).alias("html"))
    listings = counts.select(
        F.col("o_custkey").alias("listing_id"), F.concat(site, F.lit("/list/")).alias("hub"), F.lit(100).alias("max_items"))
    return listings, pages.select(address.alias("url"), body.alias("html")).unionByName(landing)


LIST_RANGE = 25_000  # keys per list page; a nation has every 25th


def site_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One site per nation: start page, about page, a list of its suppliers with their own pages, and a list of its
    customers. Every page carries the menu. Returns (starts, pages)."""
    nations = table(spark, folder, "nation")
    site = F.format_string("https://www.nation%d.org", "n_nationkey")
    menu = ('<nav><a href="/">Home</a><a href="/about/">About us</a><a href="/suppliers/">Suppliers</a>'
            '<a href="/customers/">Customers</a></nav><main>')
    filler = "<p>" + "Plain words about this place and the people in it. " * 32 + "</p></main>"

    def list_page(rows: DataFrame, nation: str, key: str, name: str, section: str) -> DataFrame:
        entry = F.format_string('<li><a href="/%3$s/the-entry-%1$d/">Details about %2$s</a></li>', key, name, F.lit(section))
        # pages of a list are ranges of keys, about a thousand entries each: no ranking over a whole nation is needed
        lists = rows.groupBy(F.col(nation).alias("n_nationkey"), F.floor(F.col(key) / LIST_RANGE).cast("int").alias("k")).agg(
            F.array_sort(F.collect_list(F.struct(key, entry.alias("html")))).alias("entries"))
        return dealt(lists).select(
            F.concat(site, F.lit(f"/{section}/"), F.when(F.col("k") > 0, F.concat(F.lit("page/"), (F.col("k") + 1).cast("string"), F.lit("/"))).otherwise(F.lit(""))).alias("url"),
            F.concat(F.lit(f"<title>All {section}</title>" + menu + f"<h1>{section}</h1><ul>"), F.array_join(F.transform("entries", lambda e: e["html"]), ""), F.lit("</ul>" + filler)).alias("html"),
        )

    def item_pages(rows: DataFrame, nation: str, key: str, name: str, section: str) -> DataFrame:
        return dealt(rows.select(nation, key, name)).select(
            F.format_string(f"https://www.nation%d.org/{section}/the-entry-%d/", nation, key).alias("url"),
            F.concat(F.lit("<title>"), name, F.lit("</title>" + menu + "<h1>"), name, F.lit("</h1>" + filler)).alias("html"))

    suppliers, customers = table(spark, folder, "supplier"), table(spark, folder, "customer")
    fixed = nations.select(F.posexplode(F.array(F.concat(site, F.lit("/")), F.concat(site, F.lit("/about/")))).alias("i", "url"), "n_name").select(
        "url", F.concat(F.lit("<title>"), "n_name", F.lit("</title>" + menu + "<h1>Welcome</h1>" + filler)).alias("html"))
    pages = fixed
    for rows, nation, key, name, section in (
        (suppliers, "s_nationkey", "s_suppkey", "s_name", "suppliers"), (customers, "c_nationkey", "c_custkey", "c_name", "customers"),
    ):
        pages = pages.unionByName(list_page(rows, nation, key, name, section)).unionByName(item_pages(rows, nation, key, name, section))
    starts = nations.select(F.format_string("nation%d.org", "n_nationkey").alias("site"), F.concat(site, F.lit("/")).alias("url"))
    return starts, pages
