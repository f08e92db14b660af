"""Pages to links, link groups and page statistics; one narrow stage, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions import tree as tr
from pagemill.functions import urls
from pagemill.functions.lets import built_once, let, opened, rows_of
from pagemill.functions.runs import per_run
from pagemill.operators.dom import with_dom

# --- fixed values -------------------------------------------------------------------------------------------------
NON_TEXT_TAGS = ("script", "style", "noscript", "template")
SITE_CHROME_TAGS = ("header", "nav", "footer", "aside")
SITE_CHROME_ROLES = ("navigation", "banner", "contentinfo")
TITLE_LENGTH = 20  # list entries carry titles; shorter labels are section navigation
# ------------------------------------------------------------------------------------------------------------------


def anchor_text(tree: Column, node: Column) -> Column:
    """Visible text, else the aria label, else the title."""
    return tx.first_filled(
        tr.text_of(tree, node), tx.clean(tr.attr(node, "aria-label")), tx.clean(tr.attr(node, "title"))
    )


def anchors(tree: Column, url: Column) -> Column:
    """Every anchor of a page with its text and absolute URL; fragments, scripts and mail links are left out."""
    wanted = F.filter(
        tree["nodes"],
        lambda x: (x["tag"] == "a") & ~tr.attr(x, "href").rlike("^(#|javascript|mailto)"),
    )
    return let(urls.parts(url), lambda base: F.transform(
        wanted,
        lambda x: F.struct(
            x["pre"].alias("pos"),
            anchor_text(tree, x).alias("text"),
            urls.resolve_from(base, tr.attr(x, "href")).alias("url"),
            F.coalesce(tr.attr(x, "aria-label"), F.lit("")).alias("aria"),
        ),
    ))


def _last_of_runs(rows: Column, key: str) -> Column:
    """Of an array sorted by ``key``, the last entry of each run of equal keys."""
    return F.filter(
        rows, lambda r, i: F.coalesce(F.get(rows, i + 1)[key] != r[key], F.lit(True))
    )


def _first_of_runs(rows: Column, key: str) -> Column:
    return F.filter(
        rows, lambda r, i: F.when(i == 0, F.lit(True)).otherwise(F.get(rows, i - 1)[key] != r[key])
    )


def _page_links(raw: Column) -> Column:
    """One entry per target: longest text (later wins ties), first position, first position inside the content."""
    best = let(
        F.array_sort(F.transform(raw, lambda r: F.struct(r["url"].alias("url"), F.length(r["text"]).alias("n"), r["pos"].alias("pos"), r["text"].alias("text")))),
        lambda a: _last_of_runs(a, "url"),
    )
    first = let(
        F.array_sort(F.transform(raw, lambda r: F.struct(r["url"].alias("url"), r["pos"].alias("pos")))),
        lambda a: _first_of_runs(a, "url"),
    )
    in_content = let(
        F.array_sort(F.transform(raw, lambda r: F.struct(
            r["url"].alias("url"), F.isnull(r["content_pos"]).alias("outside"), r["content_pos"].alias("content_pos")))),
        lambda a: _first_of_runs(a, "url"),
    )
    zipped = let(first, lambda f: let(in_content, lambda c: F.transform(best, lambda b, i: F.struct(
        F.get(f, i)["pos"].alias("pos"),
        b["url"].alias("url"),
        b["text"].alias("text"),
        urls.folder_pattern(urls.path(b["url"])).alias("gpath"),
        F.get(c, i)["content_pos"].alias("content_pos"),
    ))))
    return F.array_sort(zipped)


def biggest_group(links: Column, counts: Callable[[Column], Column]) -> Column:
    """(gpath, n) of the content link group with most counted entries; the group seen first wins ties."""
    content = F.array_sort(F.transform(
        F.filter(links, lambda k: k["content_pos"].isNotNull()),
        lambda k: F.struct(k["gpath"].alias("gpath"), k["content_pos"].alias("at"), counts(k).alias("counted")),
    ))

    def weighed(first: Column, run: Column) -> Column:
        return F.struct(F.size(F.filter(run, lambda r: r["counted"])).alias("n"), (-first["at"]).alias("order"), first["gpath"].alias("gpath"))

    return F.array_max(per_run(content, "gpath", weighed))


def is_titled(link: Column) -> Column:
    return F.length(link["text"]) > TITLE_LENGTH


def is_item(link: Column) -> Column:
    return is_titled(link) & urls.looks_like_slug(link["url"])


def page_struct(dom: Column, url: Column, only: tuple[str, ...] = ()) -> Column:
    """All link and page facts of one page as a struct (see the field names below), or ``only`` some of them."""
    base = urls.normalise(url)

    def build(whole: Column, me: Column) -> Column:
        def with_content(content: Column) -> Column:
            hrefs = let(urls.parts(url), lambda page_url: F.transform(
                F.filter(whole["nodes"], lambda x: (x["tag"] == "a") & tr.attr(x, "href").isNotNull()),
                lambda x: F.struct(
                    x["pre"].alias("pos"),
                    urls.resolve_from(page_url, tr.attr(x, "href")).alias("href"),
                    x.alias("node"),
                ),
            ))
            web = F.filter(hrefs, lambda h: h["href"].startswith("http"))

            def from_web(w: Column) -> Column:
                raw = F.transform(
                    F.filter(w, lambda h: ~urls.is_document(h["href"])),
                    lambda h: F.struct(
                        h["pos"].alias("pos"),
                        urls.normalise(h["href"]).alias("url"),
                        F.substring(anchor_text(whole, h["node"]), 1, 120).alias("text"),
                        F.when(F.get(content["nodes"], h["pos"]).isNotNull(), h["pos"]).alias("content_pos"),
                    ),
                )
                same_site = let(
                    urls.site(me),
                    lambda home: F.filter(raw, lambda r: (urls.site(r["url"]) == home) & (r["url"] != me)),
                )
                links = let(same_site, _page_links)
                pdfs = F.size(F.filter(w, lambda h: urls.is_document(h["href"]) & urls.is_pdf(h["href"])))
                return F.struct(links.alias("links"), pdfs.alias("pdfs"))

            heading = tr.first_node(content, lambda x: x["tag"] == "h1")
            heads = F.slice(
                F.transform(
                    F.filter(content["nodes"], lambda x: x["tag"].isin("h2", "h3")),
                    lambda x: F.substring(tr.stripped_text(tr.strings_of(content, x)), 1, 80),
                ), 1, 12,
            )
            title = tr.first_node(whole, lambda x: x["tag"] == "title")
            paged = F.exists(
                content["nodes"],
                lambda x: F.coalesce(
                    (x["tag"].isin("a", "link") & tr.has_token(tr.attr(x, "rel"), "next"))
                    | tr.attr(x, "class").contains("pagination")
                    | tr.attr(x, "class").contains("pager"),
                    F.lit(False),
                ),
            )
            read = not only or {"dates", "text_len"} & set(only)
            text = tr.stripped_text(tr.page_strings(content)) if read else F.lit("")

            def finish(found: Column, body: Column) -> Column:
                def with_groups(titled: Column, listed: Column) -> Column:
                    facts = {
                        "norm_url": me,
                        "site": urls.site(me),
                        "title": let(title, lambda t: F.substring(
                            tx.clean(F.array_join(tr.strings_of(whole, t), "")), 1, 150)),
                        "h1": let(heading, lambda h: F.substring(tr.text_of(content, h), 1, 150)),
                        "heads": heads,
                        "links": found["links"],
                        "gpath": F.coalesce(titled["gpath"], F.lit("")),
                        "kids": F.coalesce(titled["n"], F.lit(0)),
                        "item_gpath": F.coalesce(listed["gpath"], F.lit("")),
                        "item_count": F.coalesce(listed["n"], F.lit(0)),
                        "pdfs": found["pdfs"],
                        "dates": tx.date_mentions(body),
                        "paged": paged,
                        "text_len": F.length(body),
                    }
                    return F.struct(*[fact.alias(name) for name, fact in facts.items() if name in (only or facts)])

                groups = F.struct(
                    biggest_group(found["links"], is_titled).alias("titled"), biggest_group(found["links"], is_item).alias("listed"))
                return let(groups, lambda g: with_groups(g["titled"], g["listed"]))

            return let(let(web, from_web), lambda found: let(text, lambda body: finish(found, body)))

        chrome = tr.without(
            whole,
            lambda x: x["tag"].isin(*SITE_CHROME_TAGS)
            | F.coalesce(tr.attr(x, "role").isin(*SITE_CHROME_ROLES), F.lit(False)),
        )
        return let(chrome, with_content)

    text_tree = tr.without(tr.readable(dom), lambda x: x["tag"].isin(*NON_TEXT_TAGS))
    return let(text_tree, lambda whole: let(base, lambda me: build(whole, me)))


@built_once
def _page_column(dom: str, url: str, *only: str) -> Column:
    return page_struct(F.col(dom), F.col(url), only)


@built_once
def _anchor_column(dom: str, url: str) -> Column:
    return let(tr.readable(F.col(dom)), lambda t: anchors(t, F.col(url)))


def parse_pages(pages: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """``pages(page_id, url, html)`` to one row per page: statistics plus its links, or ``only`` some of these columns.
    Input for everything that works on links; write it out once for a crawl over an archive, the markup is not needed again."""
    keep = [c for c in pages.columns if c not in ("html", "dom")]
    parsed = with_dom(pages).withColumn("page", _page_column("dom", "url", *only))
    return opened(parsed, keep, "page")


def page_links(parsed: DataFrame) -> DataFrame:
    """Link rows: one per page and target."""
    rows = rows_of(parsed, ["page_id", F.col("norm_url").alias("src"), "site"], "links", "pos")
    return rows.withColumnRenamed("url", "dst")


def page_anchors(pages: DataFrame) -> DataFrame:
    """Every anchor of every page, unfiltered by site or chrome."""
    rows = with_dom(pages).withColumn("a", _anchor_column("dom", "url"))
    return rows_of(rows, ["page_id"], "a", "pos")


def titled_sample(links: Column, gpath: Column, longer_than: int, at_most: int) -> Column:
    """The first few titled texts of a page's list, in page order."""
    listed = F.filter(links, lambda k: (k["gpath"] == gpath) & k["content_pos"].isNotNull())
    ordered = F.array_sort(
        F.transform(listed, lambda k: F.struct(k["content_pos"].alias("at"), k["text"].alias("text")))
    )
    texts = F.filter(F.transform(ordered, lambda k: k["text"]), lambda t: F.length(t) > longer_than)
    return F.slice(texts, 1, at_most)
