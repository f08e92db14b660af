"""Crawls over rendered site graphs with a scorer that needs no model, and learning from labelled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators import crawl as cr
from pagemill.operators import graph as gr
from pagemill.operators import links as lk
from pagemill.operators import outline as ol
from pagemill.operators import recipes as rc
from pagemill.operators import scoring as sc
from pagemill.plans import rendered as rd
from pagemill.plans.catalog import big, query
from pagemill.session import cut_lineage


def page_words(rows: DataFrame) -> DataFrame:
    """Stands in for a model: a page is on topic when it names suppliers."""
    named = F.col("state").contains("All suppliers")
    return rows.withColumn("hub", F.when(named, 0.9).otherwise(0.1)).withColumn(
        "role", F.when(F.col("kids") >= 5, "listing").otherwise("item")
    ).withColumn("holds", F.when(F.col("state").contains("customers"), "people").when(named, "projects").otherwise("mixed"))


def link_words(rows: DataFrame) -> DataFrame:
    return rows.withColumn("leads", F.when(F.col("state").rlike("(?i)suppliers"), 0.8).otherwise(0.3))


def site_archive(spark, folder) -> tuple[DataFrame, DataFrame]:
    starts, pages = rd.site_graph(spark, folder)
    return starts, pages.withColumn("fetch_url", F.col("url"))


def _crawl(spark, folder):
    starts, archive = site_archive(spark, folder)
    return cr.crawl(starts, archive, page_words, link_words, max_pages=12, tabs=2)


# the menu leads everywhere; a listing of suppliers is found wherever the nation has some
_ANSWER = (
    "WITH s AS (SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation) "
)


@query("crawl_answers", f"{_ANSWER} SELECT 'nation' || n_nationkey || '.org' AS site, 'https://www.nation' || n_nationkey || '.org/suppliers/' AS url FROM s WHERE n > 0")
def crawl_answers(spark, folder):
    found = _crawl(spark, folder)["answer"]
    return found.where(F.col("url").endswith("/suppliers/")).select("site", "url")


@query("crawl_places")
def crawl_places(spark, folder):
    return _crawl(spark, folder)["places"].select("site", "rank", "norm_url", "depth", "items", "linked_from", "score")


@query("crawl_sections")
def crawl_sections(spark, folder):
    return _crawl(spark, folder)["sections"]


@query("located_listings", f"{_ANSWER} SELECT 'nation' || n_nationkey || '.org' AS site, 'https://www.nation' || n_nationkey || '.org/suppliers/' AS listing FROM s WHERE n > 0")
def located_listings(spark, folder):
    """Locate with a judge that picks the candidate whose address names suppliers."""
    starts, archive = site_archive(spark, folder)

    def judge(inputs: DataFrame) -> DataFrame:
        hit = F.get(F.filter("candidates", lambda c: c["url"].endswith("/suppliers/")), F.lit(0))
        return inputs.select("site", hit["n"].alias("pick"), F.lit(None).cast("string").alias("picked_url"))

    return cr.locate(starts, archive, page_words, link_words, judge, max_pages=12, tabs=2)


@query(
    "guessed_listings",
    "SELECT 'nation' || s_nationkey || '.org' AS site, 'https://www.nation' || s_nationkey || '.org/suppliers/' AS url, "
    f"count(*) AS items FROM supplier WHERE s_suppkey < {rd.LIST_RANGE} GROUP BY s_nationkey HAVING count(*) >= 5",
)
def guessed_listings(spark, folder):
    """Listing names tried as addresses: only pages that hold a real list count."""
    starts, archive = site_archive(spark, folder)
    names = F.array(F.lit("Suppliers"), F.lit("About"), F.lit("All the open suppliers of this nation and more"), F.lit(""))
    wanted = starts.select("site", urls.root(F.col("url")).alias("root"), names.alias("names"))
    found = cr.guessed_listings(wanted, starts.select("url"), archive)
    return found.select("site", "url", big("items", "items"))


@query(
    "pages_to_render",
    "WITH n AS (SELECT s_nationkey AS k, count(*) AS c FROM supplier GROUP BY 1) SELECT 'https://www.nation' || k || '.org/suppliers/' AS url FROM n WHERE c BETWEEN 2 AND 2",
)
def pages_to_render(spark, folder):
    """On topic, pages known beneath it, yet fewer than three listed: to be stored again from a browser."""
    _, archive = site_archive(spark, folder)
    # every page's links count as known, so all are parsed, but only for what is asked
    archive = lk.parse_pages(archive, ("norm_url", "title", "links", "kids"))
    archive = cut_lineage(archive.select("url", "norm_url", "title", "kids", F.transform("links", lambda k: k["url"]).alias("links")))
    judged = archive.where(F.col("title") == "All suppliers").withColumn("hub", F.lit(0.9))
    known = archive.select(F.explode("links").alias("url")).distinct()
    return cr.needs_rendering(judged, known).select("url")


# ---- learning ----------------------------------------------------------------------------------------------------


def _labelled_items(spark, folder):
    pages = rd.part_pages(spark, folder).withColumnRenamed("p_partkey", "page_id")
    return rc.with_items(pages).select("page_id", "url", "item")


@query(
    "learned_selectors",
    "SELECT 'brand' AS field, CASE WHEN count(*) FILTER (p_partkey % 2 = 0) >= count(*) FILTER (p_partkey % 2 = 1) "
    "THEN 'kv:article > div.facts || Brand' ELSE 'kv:div.item > div.facts || Makes' END AS selector, "
    "greatest(count(*) FILTER (p_partkey % 2 = 0), count(*) FILTER (p_partkey % 2 = 1)) AS n FROM part",
)
def learned_selectors(spark, folder):
    """Learn from labelled values instead of a model's picks: the entry of each outline that equals the known brand."""
    outline = cut_lineage(ol.outline_rows(_labelled_items(spark, folder)).drop("label", "line"))
    known = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("brand"))
    # as many rows as there are pages: never broadcast
    picks = outline.where("kind = 'fact'").join(known.hint("merge"), "page_id").where(F.get("values", F.lit(0)) == F.col("brand")).select(
        "page_id", F.lit("brand").alias("field"), F.lit("text").alias("type"), "n", F.col("page_id").alias("page_order"))
    return ol.learn_selectors(picks, outline, rd.part_pages(spark, folder).withColumnRenamed("p_partkey", "page_id"))


@query(
    "outline_entries",
    "SELECT p_partkey AS page_id, CAST(2 AS BIGINT) AS block_facts, 'fact ''' || CASE WHEN p_partkey % 2 = 0 THEN 'Brand'' = ' || p_brand ELSE 'Kind'' = ' || p_type END AS line FROM part",
)
def outline_entries(spark, folder):
    """Numbered outlines of all item pages; checked by their labelled facts."""
    outline = ol.outline_rows(_labelled_items(spark, folder))
    in_block = F.col("selector").contains("div.facts")
    return outline.groupBy("page_id").agg(
        F.count_if(in_block).alias("block_facts"), F.min(F.when(in_block, F.col("line"))).alias("line"))


@query("outline_texts")
def outline_texts(spark, folder):
    return ol.outline_text(ol.outline_rows(_labelled_items(spark, folder)))


def overlap(rows: DataFrame) -> DataFrame:
    """Stands in for a model: how well a block's words fit the field."""
    return rows.withColumn("p", F.when(
        ((F.col("field") == "price") & F.col("state").rlike(r"\$\d+\.\d\d")) | ((F.col("field") == "size") & F.col("state").rlike(r"\b\d{1,2}\b")),
        F.lit(0.95) - F.least(F.length("state"), F.lit(900)) / 1000.0,
    ).otherwise(0.05))


@query("guessed_values")
def guessed_values(spark, folder):
    """Beam walk, finalists and exclusive assignment for fields nobody validated."""
    items = sc.stored_items(_labelled_items(spark, folder))
    fields = spark.createDataFrame(
        [("price", "money", "$900.10", r"\$\d"), ("size", "number", "14", None)], "field string, type string, example string, pattern string")
    jobs = items.select("page_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("type")) for f, t in (("price", "money"), ("size", "number"))])).alias("j")).select("page_id", "j.*")
    kept = cut_lineage(sc.beam_walk(jobs, items, overlap))
    claims = sc.finalists(kept, items, fields, overlap)
    return sc.assign(claims).select("page_id", "field", "value", "confidence")


@query(
    "greedy_assignment",
    "WITH c AS (SELECT o_orderkey // 7 AS page_id, 'f' || (o_orderkey % 7) AS field, o_orderpriority AS value, "
    "(o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS p FROM orders) "
    "SELECT page_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY page_id, value ORDER BY p DESC, field) AS rn FROM c) WHERE rn = 1",
)
def greedy_assignment(spark, folder):
    """One text answers one field per page; with one claim per field the most confident claim of each text wins."""
    claims = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.floor(F.col("o_orderkey") / 7).alias("page_id"), F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string")).alias("field"),
        F.lit("text").alias("type"), F.lit(1).alias("rn"), F.col("o_orderpriority").alias("value"),
        F.lit(None).cast("array<string>").alias("items"), (F.col("o_orderkey") * 7919 % 1000 / 1000.0).alias("p"))
    return sc.assign(claims).select("page_id", "field", "value")


@query(
    "ranked_places",
    "WITH p AS (SELECT o_orderkey, 'site' || (o_custkey % 50) AS site, (o_orderkey % 41) / 41.0::DOUBLE AS hub, o_custkey % 15 AS items, "
    "o_orderkey % 2 = 0 AS paged, o_orderkey % 13 AS depth, (o_orderkey % 7) / 7.0::DOUBLE AS linked FROM orders), "
    "s AS (SELECT *, round(hub * (0.2 + 0.8 * least(1.0, items / 10.0 + 0.2 * CAST(paged AS INTEGER))), 4) AS s0 FROM p), "
    "r AS (SELECT *, round(s0 * (0.6 + 0.4 * round(linked, 3)), 4) AS score FROM s) "
    "SELECT site, o_orderkey, round(score, 3) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth = 0, score DESC, length('/p/' || o_orderkey), o_orderkey) AS rank FROM r) WHERE rank <= 5",
)
def ranked_places(spark, folder):
    key = F.col("o_orderkey")
    places = spark.read.parquet(f"{folder}/orders.parquet").select(
        "o_orderkey", F.concat(F.lit("site"), (F.col("o_custkey") % 50).cast("string")).alias("site"),
        F.concat(F.lit("https://x.org/p/"), key.cast("string")).alias("url"), (key % 13).alias("depth"), key.alias("visit"),
        F.round(gr.page_score(key % 41 / F.lit(41.0), F.col("o_custkey") % 15, key % 2 == 0), 4).alias("s0"),
        F.round(key % 7 / F.lit(7.0), 3).alias("linked_from"),
    ).withColumn("score", gr.prominent_score(F.col("s0"), F.col("linked_from")))
    best = gr.rank_places(places).where("rank <= 5")
    return best.select("site", "o_orderkey", F.round("score", 3).alias("score"), "rank")
