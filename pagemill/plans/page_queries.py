"""Page operators over the stored pages: anchors, links, titles, statistics, the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators import crawl as cr
from pagemill.operators import graph as gr
from pagemill.operators import links as lk
from pagemill.operators import scoring as sc
from pagemill.plans.catalog import big, dealt, query, table
from pagemill.plans.url_queries import NETLOC, SCHEME, sql_norm, sql_path, sql_site

_ROOT = f"{SCHEME.format(u='url')} || '://' || {NETLOC.format(u='url')}"
# every link of these pages is root-relative: <a href="/word">text</a>
_ANCHORS = (
    "SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href, "
    "unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) AS text, "
    "generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) AS i FROM pages"
)
_ENTITIES = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


def _plain(x: str) -> str:
    return f"trim(regexp_replace({_ENTITIES.format(x=x)}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


_LINKS = (
    f"WITH a AS ({_ANCHORS}), l AS (SELECT page_id, i, {sql_norm('url')} AS src, lower({_ROOT}) || href AS dst, "
    f"left({_plain('text')}, 120) AS text, {sql_site('url')} AS site FROM a), "
    "k AS (SELECT * FROM l WHERE dst <> src), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY page_id, dst ORDER BY length(text) DESC, i DESC) AS rn FROM k)"
)


@query("page_anchors", f"WITH a AS ({_ANCHORS}) SELECT page_id, {_ROOT} || href AS url, {_plain('text')} AS text FROM a")
def page_anchors(spark, folder):
    return lk.page_anchors(dealt(table(spark, folder, "pages"))).select("page_id", "url", "text")


@query("page_links", f"{_LINKS} SELECT page_id, src, dst, text, site FROM b WHERE rn = 1")
def page_links(spark, folder):
    return lk.page_links(lk.parse_pages(dealt(table(spark, folder, "pages")))).select("page_id", "src", "dst", "text", "site")


_TITLE, _H1 = (f"regexp_extract(html, '(?s)<{t}>(.*?)</{t}>', 1)" for t in ("title", "h1"))


@query("page_titles", f"SELECT page_id, left({_plain(_TITLE)}, 150) AS title, left({_plain(_H1)}, 150) AS h1 FROM pages")
def page_titles(spark, folder):
    return lk.parse_pages(dealt(table(spark, folder, "pages"))).select("page_id", "title", "h1")


@query(
    "page_stats",
    f"{_LINKS}, n AS (SELECT page_id, count(*) AS n_links FROM b WHERE rn = 1 GROUP BY 1) "
    "SELECT page_id, coalesce(n_links, 0) AS n_links, CAST(0 AS BIGINT) AS kids, CAST(0 AS BIGINT) AS pdfs, FALSE AS paged, '' AS gpath "
    "FROM pages LEFT JOIN n USING (page_id)",
)
def page_stats(spark, folder):
    p = lk.parse_pages(dealt(table(spark, folder, "pages")))
    return p.select("page_id", big(F.size("links"), "n_links"), big("kids", "kids"), big("pdfs", "pdfs"), "paged", "gpath")


@query("page_states")
def page_states(spark, folder):
    """Pages as a scoring model would read them, and whether they look like empty shells."""
    p = lk.parse_pages(dealt(table(spark, folder, "pages")))
    return p.select("page_id", sc.page_state(F.col("url")).alias("state"), gr.is_thin().alias("thin"))


@query("site_page_counts", f"SELECT {sql_site('url')} AS site, count(*) AS pages FROM pages GROUP BY 1")
def site_page_counts(spark, folder):
    return table(spark, folder, "pages").groupBy(urls.site(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("pages"))


def _links(spark, folder):
    return lk.page_links(lk.parse_pages(dealt(table(spark, folder, "pages"))))


@query("site_inlinks", f"{_LINKS} SELECT site, dst, count(DISTINCT src) AS inlinks FROM b WHERE rn = 1 GROUP BY 1, 2")
def site_inlinks(spark, folder):
    return gr.inlinks(_links(spark, folder))


@query(
    "site_prominence",
    f"{_LINKS}, n AS (SELECT site, dst, count(DISTINCT src) AS inlinks FROM b WHERE rn = 1 GROUP BY 1, 2), "
    f"p AS (SELECT {sql_site('url')} AS site, count(*) AS places FROM pages GROUP BY 1) "
    "SELECT site, dst, round(least(1.0::DOUBLE, inlinks / places::DOUBLE), 3) AS linked_from FROM n JOIN p USING (site)",
)
def site_prominence(spark, folder):
    counted = gr.inlinks(_links(spark, folder))
    return counted.join(site_page_counts(spark, folder), "site").select(
        "site", "dst", gr.linked_from(F.col("inlinks"), F.col("pages")).alias("linked_from"))


@query(
    "known_under",
    f"WITH u AS (SELECT DISTINCT regexp_extract({sql_norm('url')}, '^(.*?[^/:]/[^/]*)', 1) AS url FROM pages), "
    f"k AS (SELECT DISTINCT {sql_norm('url')} AS known FROM pages) "
    "SELECT url, count(known) AS under FROM u LEFT JOIN k ON starts_with(known, url) AND known <> url GROUP BY 1",
)
def known_under(spark, folder):
    known = table(spark, folder, "pages").select(urls.normalise(F.col("url")).alias("url")).distinct()
    probes = known.select(F.regexp_extract("url", "^(.*?[^/:]/[^/]*)", 1).alias("url")).distinct()
    return gr.count_under(probes, known)


_RULES = (
    f"WITH h AS (SELECT DISTINCT lower({NETLOC.format(u='url')}) AS host FROM pages), "
    "r AS (SELECT host, ord, allow, prefix FROM h CROSS JOIN (VALUES (1, TRUE, '/en/7'), (2, FALSE, '/en/'), (3, FALSE, '/fr/8')) v(ord, allow, prefix)), "
    f"m AS (SELECT page_id, allow, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS rn FROM pages JOIN r "
    f"ON host = lower({NETLOC.format(u='url')}) AND starts_with({sql_path('url')}, prefix)) "
)


@query("robots_allowed", f"{_RULES} SELECT page_id, coalesce(allow, TRUE) AS allowed FROM pages LEFT JOIN (SELECT * FROM m WHERE rn = 1) USING (page_id)")
def robots_allowed(spark, folder):
    pages = table(spark, folder, "pages")
    lines = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(a).alias("allow"), F.lit(p).alias("prefix"))
                      for o, a, p in ((1, True, "/en/7"), (2, False, "/en/"), (3, False, "/fr/8"))])
    rules = pages.select(F.lower(urls.netloc(F.col("url"))).alias("host")).distinct().select("host", F.inline(lines))
    return gr.allowed_pages(pages, rules).select("page_id", "allowed")


@query(
    "frontier_topk",
    f"WITH f AS (SELECT page_id, {sql_site('url')} AS site, (length(html) % 97) / 97.0::DOUBLE AS prio FROM pages) "
    "SELECT site, page_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY prio DESC, page_id) AS rn FROM f) WHERE rn <= 8",
)
def frontier_topk(spark, folder):
    queue = table(spark, folder, "pages").select(
        "page_id", urls.site(F.col("url")).alias("site"), ((F.length("html") % 97) / F.lit(97.0)).alias("prio"))
    return cr.numbered(queue, F.desc("prio"), "page_id").where("rn <= 8").select("site", "page_id", big("rn", "rn"))


@query(
    "link_priorities",
    "WITH s AS (SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE AS s, o_orderkey % 9 AS under, o_orderkey % 2 = 0 AS listed, "
    "o_orderkey % 3 = 0 AS scoped, o_orderkey % 7 = 0 AS avoided, o_custkey % 14 AS kids, o_custkey % 2 AS paged FROM orders) "
    "SELECT o_orderkey, round(s * (0.4 + 0.6 * least(under, 5) / 5.0) * CASE WHEN listed THEN 0.2 ELSE 1 END * "
    "CASE WHEN scoped THEN 1 ELSE 0.3 END * CASE WHEN avoided THEN 0.05 ELSE 1 END, 6) AS prio, "
    "round(s * (0.2 + 0.8 * least(1.0, kids / 10.0 + 0.2 * paged)), 6) AS score FROM s",
)
def link_priorities(spark, folder):
    key, s = F.col("o_orderkey"), (F.col("o_orderkey") % 101) / F.lit(100.0)
    prio = gr.link_priority(s, key % 9, key % 2 == 0, key % 3 == 0, key % 7 == 0)
    score = gr.page_score(s, F.col("o_custkey") % 14, F.col("o_custkey") % 2 == 1)
    return table(spark, folder, "orders").select("o_orderkey", F.round(prio, 6).alias("prio"), F.round(score, 6).alias("score"))


# ---- fetch results -----------------------------------------------------------------------------------------------


def fetches(spark, folder):
    """Two renderings per page with statuses by key: some refused, some failed, some redirected to the site's root."""
    p = table(spark, folder, "pages")
    k = F.col("page_id") % 5
    plain = p.select(
        "page_id", "url", urls.site(F.col("url")).alias("site"), F.lit("requests").alias("via"),
        F.when(k == 0, 403).when(k == 1, 503).when(F.col("page_id") % 2 == 0, 429).otherwise(200).alias("status"),
        F.when(k == 4, F.lit("timeout")).alias("error"),
        F.when(k == 3, F.concat(urls.root(F.col("url")), F.lit("/"))).otherwise(F.col("url")).alias("final_url"),
    )
    browser = plain.where(F.col("page_id") % 3 == 0).withColumn("via", F.lit("browser")).withColumn(
        "status", F.when(F.col("page_id") % 4 == 0, 500).otherwise(200)).withColumn("error", F.lit(None).cast("string"))
    return plain.unionByName(browser)


_FETCHES = (
    f"WITH f0 AS (SELECT page_id, url, {sql_site('url')} AS site, 'requests' AS via, CASE WHEN page_id % 5 = 0 THEN 403 WHEN page_id % 5 = 1 THEN 503 "
    "WHEN page_id % 2 = 0 THEN 429 ELSE 200 END AS status, CASE WHEN page_id % 5 = 4 THEN 'timeout' END AS error, "
    f"CASE WHEN page_id % 5 = 3 THEN {_ROOT} || '/' ELSE url END AS final_url FROM pages), "
    "f AS (SELECT * FROM f0 UNION ALL SELECT page_id, url, site, 'browser', CASE WHEN page_id % 4 = 0 THEN 500 ELSE 200 END, NULL, final_url FROM f0 WHERE page_id % 3 = 0)"
)


@query("best_renderings", f"{_FETCHES} SELECT page_id, min(via) AS via FROM f WHERE error IS NULL AND status < 400 GROUP BY 1")
def best_renderings(spark, folder):
    return gr.best_rendering(fetches(spark, folder)).select("page_id", "via")


@query("walled_sites", f"{_FETCHES} SELECT site, count(*) AS fetched, count(*) FILTER (status IN (403, 429, 503)) AS blocked, "
       "2 * count(*) FILTER (status IN (403, 429, 503)) > count(*) AS walled FROM f GROUP BY 1")
def walled_sites(spark, folder):
    return gr.walled_sites(fetches(spark, folder))


@query(
    "redirect_dedup",
    f"{_FETCHES}, u AS (SELECT page_id, {sql_norm('final_url')} AS final FROM f WHERE error IS NULL AND status < 400 AND via = 'requests') "
    "SELECT final, min(page_id) AS page_id FROM u GROUP BY 1",
)
def redirect_dedup(spark, folder):
    """Redirects can land on a page already read: the first fetch of a final address stands for it."""
    ok = fetches(spark, folder).where(gr.usable() & (F.col("via") == "requests"))
    landed = ok.select("site", "page_id", urls.normalise(F.col("final_url")).alias("norm_url"))
    return cr.first_landings(landed, "page_id").select(F.col("norm_url").alias("final"), "page_id")


@query(
    "new_links",
    f"{_LINKS} SELECT DISTINCT dst FROM b WHERE rn = 1 AND dst NOT IN (SELECT {sql_norm('url')} FROM pages) AND NOT regexp_matches(dst, '/(page|p|pg)/[0-9]+/?$')",
)
def new_links(spark, folder):
    """Links no stored page answers: what a crawl would fetch next."""
    known = table(spark, folder, "pages").select(urls.normalise(F.col("url")).alias("url"))
    return cr.unseen(_links(spark, folder).select(F.col("dst").alias("url")), known).withColumnRenamed("url", "dst")


@query(
    "link_states",
    f"{_LINKS} SELECT page_id, dst, 'Link text: ' || CASE WHEN text = '' THEN '(none)' ELSE text END || chr(10) || 'URL path: ' || {sql_path('dst')} || "
    f"chr(10) || 'Path depth: ' || len(string_split(trim({sql_path('dst')}, '/'), '/')) || chr(10) || 'Known site pages under this path: 0' AS state FROM b WHERE rn = 1",
)
def link_states(spark, folder):
    return _links(spark, folder).select("page_id", "dst", sc.link_state(F.col("text"), F.col("dst"), F.lit(0)).alias("state"))
