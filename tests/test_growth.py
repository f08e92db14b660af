"""How the page queries grow: markup is worked through once, and only where it is needed."""

import contextlib
import io

import pyarrow as pa
from pyspark.sql import functions as F

from pagemill.operators import crawl as cr
from pagemill.operators import dom
from pagemill.operators import links as lk
from pagemill.operators import outline as ol
from pagemill.operators import recipes as rc
from pagemill.operators import scoring as sc
from pagemill.plans import rendered as rd


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_plain_markup_is_nested_without_the_library_parser(monkeypatch):
    pages = ['<!DOCTYPE html><title>a &amp; b</title><p class="x y">t<br>u<br/> &copy; v</p><!-- c --></div><pre> </pre>', "", "text",
             '<script type="application/ld+json">{"name": "n"}</script><A HREF="/x">y</A><p id="a" id="b">']
    odd = ["<p>a < b", "<a href='x'>y", "<script>var t='</p>'</script>z", "<iframe><b></iframe>", '<a href="?a=1&amp;b=2">q</a>', "<p", "<title>a<b>c</title>"]
    fast = dom.build(pa.array(pages + odd)).to_pylist()
    fed = []
    feed = dom._Builder.feed
    monkeypatch.setattr(dom._Builder, "feed", lambda self, html: (fed.append(html), feed(self, html)))
    dom.build(pa.array(pages))
    assert fed == []
    monkeypatch.setattr(dom._Builder, "plain", lambda self, html: False)
    assert dom.build(pa.array(pages + odd)).to_pylist() == fast and len(fed) == len(pages + odd)


def test_outline_works_through_a_page_once(spark):
    html = '<meta name="k" content="v"><main><h1>T</h1><div class="facts"><b>A:</b> 1 <b>B:</b> 2</div></main>'
    pages = spark.createDataFrame([(0, "https://x.org/1", html, ""), (None, "https://x.org/2", html, "")], "page_id long, url string, html string, item_pattern string")
    out = ol.outline_rows(rc.with_items(pages))
    assert plan_of(out).count("ArrowEvalPython [") == 1
    rows = sorted((r.page_id is None, r.n, r.selector) for r in out.collect())
    assert rows == [(lone, n, s) for lone in (False, True) for n, s in enumerate(["meta:k", "h1", "kv:div.facts || A", "kv:div.facts || B"])]
    # learning takes the pages as they are stored, and its joins are not broadcast
    picks = spark.createDataFrame([(0, "a", "text", 2, 1), (0, "t", "text", 1, 1), (0, "no", "number", 1, 1)], "page_id long, field string, type string, n long, page_order int")
    learnt = ol.learn_selectors(picks, out, pages)
    assert sorted((r.field, r.selector) for r in learnt.collect()) == [("a", "kv:div.facts || A"), ("t", "h1")]
    assert "Broadcast" not in plan_of(learnt)


def test_crawl_and_guesses_parse_what_they_look_up(spark):
    items = "".join(f'<a href="/pubs/the-report-{i}/">A long report title number {i}</a>' for i in range(8))
    site = {"/": '<nav><a href="/pubs/">Reports</a></nav>', "/pubs/": items, **{f"/pubs/the-report-{i}/": f"<h1>r{i}</h1>" for i in range(8)}, "/far/": "<p>x</p>"}
    stored = spark.createDataFrame([(f"https://x.org{p}", h) for p, h in site.items()], "url string, html string").withColumn("fetch_url", F.col("url"))
    stored = stored.unionByName(stored.where("url LIKE '%/pubs/'"))  # stored twice
    starts = spark.createDataFrame([("x.org", "https://x.org")], "site string, url string")
    score = lambda name, value: lambda rows: rows.withColumn(name, F.lit(value)).withColumn("role", F.lit("x")).withColumn("holds", F.lit("y"))
    both = []
    for archive in (stored, lk.parse_pages(stored)):
        found = cr.crawl(starts, archive, score("hub", 0.5), score("leads", 0.5), max_pages=5, tabs=1)
        both.append(sorted((r.norm_url, r.rank, r["items"], r.score) for r in found["places"].collect()))
    assert both[0] == both[1] and len(both[0]) == 5
    plans = spark.createDataFrame([("x.org", "https://x.org", ["Pubs", "Far"])], "site string, root string, names array<string>")
    got = [[(r.site, r.url, r["items"]) for r in cr.guessed_listings(plans, starts.select("url"), a).collect()] for a in (stored.distinct(), lk.parse_pages(stored.distinct()))]
    assert got[0] == got[1] == [("x.org", "https://x.org/pubs/", 8)]


def test_site_pages_are_dealt_to_tasks(spark, tables):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, pages = rd.site_graph(spark, tables)
        items = pages.where("url LIKE '%/customers/the-entry-%'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert items == 8


def test_guessing_keeps_trees_out_of_shuffles_and_python(spark):
    page = "<main><div><p>The price is $900.10 here and more words follow it</p></div><span>14</span></main>"
    pages = spark.createDataFrame([(i, f"https://x.org/{i}", page, "") for i in range(3)], "page_id long, url string, html string, item_pattern string")
    items = sc.stored_items(rc.with_items(pages))
    jobs = items.select("page_id", F.lit("price").alias("field"), F.lit("money").alias("type"))
    score = lambda rows: rows.withColumn("p", F.when(F.col("state").contains("$900"), 0.9).otherwise(0.1))
    fields = spark.createDataFrame([("price", "money", "$1.10", r"\$\d")], "field string, type string, example string, pattern string")
    last = sc.finalists(sc.beam_walk(jobs, items, score), items, fields, score)
    assert {(r.page_id, r.value) for r in last.where("rn = 1").collect()} == {(i, "The price is $900.10 here and more words follow it 14") for i in range(3)}
    hops = [line for line in plan_of(last).splitlines() if "Exchange" in line or "ArrowEvalPython [" in line]
    assert hops and not [line for line in hops if "item#" in line]
