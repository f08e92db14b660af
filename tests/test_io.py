import glob
import json

from pyspark.sql import functions as F

from pagemill.operators import crawl as cr
from pagemill.operators import links as lk
from pagemill.sources import sinks, tables as src
from pagemill.streaming import pages as stream

HTML = '<main><h1>Item {0}</h1><p class="d">{1}</p></main>'
SELECTORS = [("r", 0, "title", "text", 0, "main > h1"), ("r", 1, "when", "date", 0, "main > p.d")]


def recipes(spark):
    from pagemill.operators.recipes import compile_recipes

    return compile_recipes(spark.createDataFrame(SELECTORS, "recipe string, field_pos int, field string, type string, prio int, selector string"))


def test_fetch_results(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text(
        '{"url": "u1", "final_url": "u1", "status": 200, "html": "<p>", "more": {"rounds": 2, "clicks": 1}}\n{"url": "u2", "error": "timeout"}\n{oops\n')
    rows = {r.url: r for r in src.fetch_results(spark, str(tmp_path)).collect()}
    assert rows["u1"].more.rounds == 2 and rows["u2"].error == "timeout" and rows[None]._corrupt == "{oops"


def test_plans_and_recipes(spark, tmp_path):
    plan = {"prompt": "calls", "target": "calls", "description": "d", "fields": [
        {"name": "title", "type": "text", "description": "t", "example": "x"}, {"name": "tags", "type": "list", "description": "t", "example": ["a", 1]}]}
    (tmp_path / "plans").mkdir()
    (tmp_path / "plans" / "calls.json").write_text(json.dumps(plan))
    plans = src.plans(spark, str(tmp_path / "plans"))
    fields = src.plan_fields(plans)
    assert [(r.name, r.example, r.pattern) for r in fields.orderBy("field_pos").collect()] == [("title", "x", None), ("tags", '["a", 1]', None)]
    (tmp_path / "recipes").mkdir()
    for i, names in enumerate((["title", "tags"], ["title"])):
        (tmp_path / "recipes" / f"{i}.json").write_text(json.dumps({
            "site": f"s{i}", "prompt": "calls", "selectors": {"title": ["h1", "meta:t"]}, "fields": {"title": "validated"}, "fields_in_plan": names}))
    known = src.matching_recipes(src.recipes(spark, str(tmp_path / "recipes")), plans)
    assert [r.site for r in known.collect()] == ["s0"]
    rows = src.recipe_selectors(known, fields).orderBy("prio").collect()
    one = '{"site":"s0","prompt":"calls"}'
    assert [(r.recipe, r.field, r.prio, r.selector) for r in rows] == [(one, "title", 0, "h1"), (one, "title", 1, "meta:t")]
    # a changed recipe is saved with its first validation date; an unchanged one is not saved at all
    old = known.withColumn("validated_on", F.lit("2026-01-01")).withColumn("listing", F.lit("l"))
    new = old.withColumn("validated_on", F.lit("2026-09-09"))
    assert sinks.changed_recipes(old, new).count() == 0
    more = new.withColumn("selectors", F.map_from_arrays(F.array(F.lit("title")), F.array(F.array(F.lit("h2")))))
    assert sinks.changed_recipes(old, more).first().validated_on == "2026-01-01"


def test_recipes_of_sites_stay_apart(spark):
    """Two sites with one prompt, and one site with two prompts whose fields share a name."""
    known = spark.createDataFrame(
        [("s1", "pubs", {"title": ["h1"]}), ("s2", "pubs", {"title": ["h2"]}), ("s2", "calls", {"title": ["h3"]})],
        "site string, prompt string, selectors map<string, array<string>>")
    fields = spark.createDataFrame([("pubs", "title", 0, "text"), ("calls", "title", 1, "date")], "prompt string, name string, field_pos int, type string")
    got = sorted((r.recipe, r.field_pos, r.type, r.selector) for r in src.recipe_selectors(known, fields).collect())
    assert got == [('{"site":"s1","prompt":"pubs"}', 0, "text", "h1"), ('{"site":"s2","prompt":"calls"}', 1, "date", "h3"), ('{"site":"s2","prompt":"pubs"}', 0, "text", "h2")]
    pages = spark.createDataFrame([("s2", "calls")], "site string, prompt string").select(src.recipe_id("site", "prompt").alias("recipe"))
    assert pages.first().recipe == got[1][0]


def test_archive_and_csv(spark, tmp_path):
    pages = spark.createDataFrame([(f"https://a.org/{i}", HTML.format(i, "x")) for i in range(6)], "url string, html string")
    sinks.write_archive(pages, str(tmp_path / "archive"))
    assert src.archive(spark, str(tmp_path / "archive")).count() == 6
    wide = spark.createDataFrame([("u", 'say "hi", é', ["a", "b"], None)], "url string, title string, tags array<string>, when string")
    scores = spark.createDataFrame([("u", "title", 0.987)], "url string, field string, confidence double")
    rows = sinks.csv_items(wide, ["title", "tags", "when"], ("tags",), scores)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    text = "".join(open(f, encoding="utf-8").read() for f in glob.glob(str(tmp_path / "csv" / "*.csv")))
    assert text.splitlines()[0] == "﻿url,title,tags,when,title_confidence,tags_confidence,when_confidence"
    assert text.splitlines()[1].startswith('u,"say ""hi"", é",a; b,"",0.987')


def test_recipe_stream_resumes(spark, tmp_path):
    schema = "url string, html string, recipe string, item_pattern string"
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "cp"))

    def arrive(*keys):
        spark.createDataFrame([(f"u{k}", HTML.format(k, f"{k} May 2026"), "r", "") for k in keys], schema).coalesce(1).write.mode("append").parquet(source)
        stream.apply_recipe_stream(stream.page_stream(spark, source, schema), recipes(spark), out, checkpoint, False).awaitTermination()
        return sorted((r.url, r.field, r.value) for r in spark.read.parquet(out).collect())

    assert arrive(1, 2) == [("u1", "title", "Item 1"), ("u1", "when", "2026-05-01"), ("u2", "title", "Item 2"), ("u2", "when", "2026-05-02")]
    assert len(arrive(3)) == 6  # pages of the first batch are not read again


def test_stream_dedup_and_drift(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("HTTPS://a.org/x?q=1", "f", "v", 1), ("https://a.org/x", "f", None, 2), ("https://a.org/y", "f", "w", 3)]
    spark.createDataFrame(rows, "url string, field string, value string, s int").select(
        "url", "field", "value", F.lit(None).cast("array<string>").alias("items"),
        F.timestamp_seconds(F.col("s") * 60).alias("seen_at")).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    pages = spark.readStream.schema(schema).parquet(source)
    for name, df, mode in (("dedup", stream.first_per_url(pages, "seen_at", "1 hour"), "append"),
                           ("drift", stream.fill_rate_drift(pages, "seen_at", "10 minutes", "1 hour"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.norm_url for r in spark.table("dedup").collect()) == ["https://a.org/x", "https://a.org/y"]
    rates = spark.table("drift")
    assert [(round(r.fill_rate, 2), r.pages) for r in rates.collect()] == [(0.67, 3)]
    validated = spark.createDataFrame([("f", 0.9)], "field string, rate double")
    assert stream.drifted(rates, validated).count() == 1


def test_crawl_of_a_small_site(spark):
    nav = '<nav><a href="/">Home</a><a href="/about/">About</a><a href="/pubs/">Reports</a><a href="/fr/">Fr</a></nav>'
    items = "".join(f'<a href="/pubs/the-report-{i}/">A long report title number {i}</a>' for i in range(8))
    site = {"/": "<p>hi</p>", "/about/": "<p>us</p>", "/pubs/": items + '<a class="pager" href="/pubs/page/2/">2</a>', "/fr/": "<p>fr</p>",
            "/pubs/page/2/": items, **{f"/pubs/the-report-{i}/": f"<h1>r{i}</h1>" for i in range(8)}}
    pages = spark.createDataFrame([(f"https://x.org{p}", f"<title>{p}</title>{nav}<main>{h}</main>") for p, h in site.items()], "url string, html string")
    archive = lk.parse_pages(pages.withColumn("fetch_url", F.col("url")))

    def score_pages(rows):
        return rows.withColumn("hub", F.when(F.col("title") == "/pubs/", 0.9).otherwise(0.2)).withColumn("role", F.lit("x")).withColumn(
            "holds", F.when(F.col("kids") > 5, "publications").otherwise("mixed"))

    def score_links(rows):
        return rows.withColumn("leads", F.when(F.col("text") == "Reports", 0.9).otherwise(0.4))

    starts = spark.createDataFrame([("x.org", "https://x.org")], "site string, url string")
    found = cr.crawl(starts, archive, score_pages, score_links, max_pages=5, tabs=1)
    places = found["places"].collect()
    assert len(places) == 5 and not [p for p in places if "/page/" in p.url]  # page 2 of a list is not a place
    by_visit = [p.norm_url[len("https://x.org"):] for p in sorted(places, key=lambda p: p.visit)]
    # the reports' link wins the second round; its entries are then worth a fifth, so the menu is read before them
    assert by_visit[:2] == ["/", "/pubs/"] or set(by_visit[1:3]) >= {"/pubs/"}
    best = min(places, key=lambda p: p.rank)
    assert best.norm_url == "https://x.org/pubs/" and best["items"] == 8 and best.linked_from == 0.8
    assert best.score == round(round(0.9 * 1.0, 4) * (0.6 + 0.4 * 0.8), 4)
    assert {r.holds: r.url for r in found["sections"].collect()}["publications"] == "https://x.org/pubs/"
    report = sinks.crawl_report(found).first()
    assert report.answer == "https://x.org/pubs/" and len(report.top) == 5
