"""Fixed-schema publication facts: metadata first, the page itself as fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions import tree as tr
from pagemill.functions import urls
from pagemill.functions.lets import built_once, let, opened
from pagemill.operators import content as ct
from pagemill.operators.dom import with_dom

# --- fixed values -------------------------------------------------------------------------------------------------
DOCUMENT_TYPES = "Article|Report|Book|Chapter|CreativeWork|Thesis"
DATE_KEYS = ("citation_publication_date", "citation_date", "dc.date", "article:published_time", "datepublished")
KINDS = (
    "report", "brief", "working_paper", "academic", "book", "commentary", "media", "event", "other",
)
AUTHORS, TOPICS, TITLE_LENGTH, SUMMARY_LENGTH = 12, 10, 300, 600
# ------------------------------------------------------------------------------------------------------------------


def _facts(dom: Column, url: Column) -> Column:
    rows = F.transform(
        ct.meta_rows(dom), lambda r: F.struct(F.lower(r["key"]).alias("key"), tx.strip(r["value"]).alias("value"))
    )
    document = F.get(F.filter(dom["objects"], lambda o: o["type"].rlike(DOCUMENT_TYPES)), F.lit(0))

    def build(tree: Column, meta: Column, doc: Column, base: Column) -> Column:
        def every(key: str) -> Column:
            return F.transform(F.filter(meta, lambda m: m["key"] == key), lambda m: m["value"])

        def first(*keys: str) -> Column:
            return F.coalesce(*[F.get(every(k), F.lit(0)) for k in keys], F.lit(""))

        def field(name: str) -> Column:
            return F.coalesce(F.get_json_object(doc["json"], f"$.{name}"), F.lit(""))

        def members(name: str) -> Column:
            """A list or a single value of the document, as strings (objects by their name)."""
            v = F.try_parse_json(doc["json"])
            single = F.try_variant_get(v, f"$.{name}", "variant")
            many = F.coalesce(
                F.try_variant_get(v, f"$.{name}", "array<variant>"),
                F.when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<variant>")),
            )
            text = lambda x: F.when(
                F.schema_of_variant(x).startswith("OBJECT"), F.coalesce(F.try_variant_get(x, "$.name", "string"), F.lit(""))
            ).otherwise(F.try_variant_get(x, "$", "string"))
            return F.filter(F.transform(many, text), lambda s: s.isNotNull())

        time = tr.first_node(tree, lambda x: x["tag"] == "time")
        shown = let(time, lambda t: tx.first_filled(tr.attr(t, "datetime"), tr.text_of(tree, t)))
        mentioned = tx.first_date_mention(tr.stripped_text(tr.page_strings(tree)))
        date = tx.first_filled(first(*DATE_KEYS), field("datePublished"), shown)

        bylines = F.filter(tree["nodes"], lambda x: tr.attr(x, "class").contains("author"))
        credited = let(bylines, lambda by: F.filter(
            tree["nodes"],
            lambda x: (x["tag"] == "a") & (
                F.coalesce(tr.attr(x, "rel") == "author", F.lit(False))
                | F.exists(by, lambda b: (b["pre"] < x["pre"]) & (x["pre"] <= b["last"]))
            ),
        ))
        linked = F.filter(F.transform(credited, lambda x: tr.text_of(tree, x)), tx.is_person_name)
        sources = F.filter(
            F.array(every("citation_author"), members("author"), every("author"), linked), lambda a: F.size(a) > 0
        )
        authors = let(
            F.coalesce(F.get(sources, F.lit(0)), tr.empty("string")),
            lambda a: F.slice(F.array_distinct(F.filter(
                F.transform(a, tx.strip), lambda n: (n != "") & (F.length(n) < 80))), 1, AUTHORS),
        )

        hrefs = F.transform(
            F.filter(tree["nodes"], lambda x: (x["tag"] == "a") & tr.attr(x, "href").isNotNull()),
            lambda x: tr.attr(x, "href"),
        )
        pdf_link = F.get(F.filter(hrefs, urls.is_pdf), F.lit(0))
        identifiers = F.array_join(F.concat(every("citation_doi"), every("dc.identifier")), " ")
        doi_links = F.array_join(F.filter(hrefs, lambda h: h.contains("doi.org/10.")), " ")

        listed = F.get_json_object(doc["json"], "$.keywords")
        keywords = F.when(listed.isNull(), tr.empty("string")).when(listed.startswith("["), members("keywords")).otherwise(
            F.split(listed, ",")
        )
        topics = F.concat(
            every("article:tag"), F.flatten(F.transform(every("keywords"), lambda k: F.split(k, ","))), keywords
        )
        heading = tr.first_node(tree, lambda x: x["tag"] == "h1")
        page_title = tr.first_node(tree, lambda x: x["tag"] == "title")
        title = tx.first_filled(
            first("citation_title", "dc.title"), field("headline"), field("name"), first("og:title"),
            let(heading, lambda h: tr.text_of(tree, h)), let(page_title, lambda t: tr.text_of(tree, t)),
        )
        summary = tx.first_filled(
            first("citation_abstract", "description", "og:description", "dc.description"), field("description")
        )
        kind = F.when(doc["type"] == "None", F.lit("")).otherwise(doc["type"])
        return F.struct(
            F.substring(title, 1, TITLE_LENGTH).alias("title"),
            tx.timestamp_to_date(tx.first_filled(date, mentioned)).alias("date"),
            authors.alias("authors"),
            F.substring(summary, 1, SUMMARY_LENGTH).alias("summary"),
            tx.first_filled(
                first("citation_pdf_url"),
                let(pdf_link, lambda p: F.when(p.isNotNull(), urls.resolve_from(base, p))),
            ).alias("pdf"),
            tx.doi(tx.first_filled(identifiers, doi_links)).alias("doi"),
            tx.distinct_filled(topics, TOPICS).alias("topics"),
            tx.first_filled(kind, first("og:type")).alias("schema_type"),
        )

    return let(
        tr.readable(dom),
        lambda tree: let(rows, lambda meta: let(document, lambda doc: let(
            urls.parts(url), lambda base: build(tree, meta, doc, base)))),
    )


@built_once
def _facts_column(dom: str, url: str) -> Column:
    return _facts(F.col(dom), F.col(url))


def publication_facts(pages: DataFrame) -> DataFrame:
    """title, date, authors, summary, pdf, doi, topics, schema_type per page."""
    keep = [c for c in pages.columns if c != "html"]
    return opened(with_dom(pages).withColumn("facts", _facts_column("dom", "url")), keep, "facts")


def listed_facts(listed: DataFrame, facts: DataFrame) -> DataFrame:
    """Listing entries (listing_id, url, list_pos, list_title) with their pages' facts; the listing's order is kept in
    ``list_pos``, entries without a page are left out."""
    return listed.join(facts, "url")


def kind_state(list_title: Column, title: Column, pdf: Column, summary: Column) -> Column:
    """What a scoring model sees to label a publication's kind."""
    return F.concat(
        F.lit("How the site lists it: "), F.substring(list_title, 1, 200),
        F.lit("\nTitle: "), title,
        F.lit("\nPDF download: "), F.when(pdf != "", F.lit("yes")).otherwise(F.lit("no")),
        F.lit("\nSummary: "), F.substring(summary, 1, 300),
    )
