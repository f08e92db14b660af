"""An item page's main content and metadata: what is left once the site around the item is gone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions import tree as tr
from pagemill.functions import urls
from pagemill.functions.lets import let
from pagemill.functions.runs import per_run

# --- fixed values -------------------------------------------------------------------------------------------------
CHROME_TAGS = ("script", "style", "noscript", "template", "svg", "nav", "footer", "aside", "form", "iframe", "dialog")
CHROME_ROLES = ("navigation", "contentinfo", "dialog")
HIDDEN_CLASSES = ("sr-only", "visually-hidden", "screen-reader-text")
HIDDEN_CLASS_PARTS = ("visually-hidden", "skip-link")
CHROME_NAMES = (
    r"(?iU)(^|[-_\s])(footer|breadcrumbs?|cookies?|newsletter|social|share|sharing|sidebar|"
    r"related|recommended|subscribe|consent)([-_\s]|$)"
)
IGNORED_META = (
    r"(?i)^(viewport|theme-color|robots|google|msapplication|fb:|twitter:image|og:image|referrer|format-detection)"
    r"|nonce|csrf|token|verification"
)
CARD_TEXT = 500  # a related-item card is smaller than this
CARD_LABEL = 20  # and is led by a title at least this long
STRUCTURED_LIMIT = 2000
PAGE_TEXT_LIMIT = 20000
# ------------------------------------------------------------------------------------------------------------------


def is_chrome(x: Column) -> Column:
    """Site chrome by tag, role or hidden state."""
    css = F.coalesce(tr.attr(x, "class"), F.lit(""))
    by_class = css.rlike(r"(?:^|\s)(?:" + "|".join(HIDDEN_CLASSES) + r")(?:\s|$)") | css.rlike("|".join(HIDDEN_CLASS_PARTS))
    return x["tag"].isin(*CHROME_TAGS) | F.coalesce(
        tr.attr(x, "role").isin(*CHROME_ROLES), F.lit(False)
    ) | F.coalesce(tr.attr(x, "aria-hidden") == "true", F.lit(False)) | tr.attr(x, "hidden").isNotNull() | by_class


def without_named_chrome(tree: Column) -> Column:
    """Drop elements whose id or class names them chrome, unless they hold the page itself."""
    holders = F.transform(F.filter(tree["nodes"], lambda x: x["tag"].isin("main", "article", "h1")), lambda x: x["pre"])

    def named(x: Column) -> Column:
        name = F.concat(F.coalesce(tr.attr(x, "id"), F.lit("")), F.lit(" "), F.coalesce(tr.attr(x, "class"), F.lit("")))
        return ~x["tag"].isin("html", "body", "main", "[document]") & name.rlike(CHROME_NAMES)

    return let(
        holders,
        lambda hold: tr.without(
            tree, lambda x: named(x) & ~F.exists(hold, lambda h: (h > x["pre"]) & (h <= x["last"]))
        ),
    )


def without_cards(tree: Column, url: Column, item_pattern: Column) -> Column:
    """Drop blocks that advertise *other* items: a link with a title whose URL has the items' pattern, together with
    its largest ancestor block under the size limit. Links are taken in page order because a removed card shrinks the
    blocks around it; the fold's state is the list of cards removed so far."""
    card_type = "struct<pre:int,last:int,s0:int,s1:int,weight:int>"

    def card(node: Column) -> Column:
        length = F.length(tr.text_of(tree, node))
        return F.struct(
            *[node[f].alias(f) for f in ("pre", "last", "s0", "s1")],
            F.when(length == 0, F.lit(0)).otherwise(length + 1).alias("weight"),
        )

    def links(base: Column, me: Column) -> Column:
        def advertises(x: Column) -> Column:
            label = tr.text_of(tree, x)
            digits = F.length(F.regexp_replace(label, r"(?U)\D", ""))
            target = urls.normalise(urls.resolve_from(base, tr.attr(x, "href")))
            return (
                (x["tag"] == "a") & tr.attr(x, "href").isNotNull()
                & (F.length(label) >= CARD_LABEL) & (digits * 3 <= F.length(label))
                & let(target, lambda u: (u != me) & (urls.folder_pattern(urls.path(u)) == item_pattern))
            )

        return F.filter(tree["nodes"], advertises)

    def largest_block(link: Column, gone: Column) -> Column:
        def remaining(block: Column) -> Column:
            inside = F.filter(gone, lambda c: (c["pre"] >= block["pre"]) & (c["pre"] <= block["last"]))
            lost = F.aggregate(inside, F.lit(0), lambda acc, c: acc + c["weight"])
            return F.length(tr.text_of(tree, block)) - lost

        def climb(line: Column) -> Column:
            edges = F.filter(
                F.transform(line, lambda a, i: F.when(a["tag"].isin("body", "main", "article"), i + 1)),
                lambda i: i.isNotNull(),
            )
            free = F.slice(line, F.coalesce(F.array_max(edges), F.lit(0)) + 1, F.size(line))
            return F.coalesce(F.get(F.filter(free, lambda a: remaining(a) < CARD_TEXT), F.lit(0)), link)

        return let(tr.ancestors(tree, link), climb)

    def fold(found: Column) -> Column:
        return F.aggregate(
            found,
            tr.empty(card_type),
            lambda gone, link: F.when(
                F.exists(gone, lambda c: (c["pre"] <= link["pre"]) & (link["pre"] <= c["last"])), gone
            ).otherwise(
                let(
                    largest_block(link, gone),
                    lambda block: F.concat(
                        F.filter(gone, lambda c: (c["pre"] < block["pre"]) | (c["pre"] > block["last"])),
                        F.array(card(block)),
                    ),
                )
            ),
        )

    found = let(urls.parts(url), lambda base: let(urls.normalise(url), lambda me: links(base, me)))
    spans = F.transform(let(found, fold), tr.span)
    return F.when(F.coalesce(item_pattern, F.lit("")) == "", tree).otherwise(
        let(F.array_sort(spans), lambda s: tr.without_spans(tree, s))
    )


def without_site_headers(tree: Column) -> Column:
    holders = F.filter(tree["nodes"], lambda x: x["tag"].isin("main", "article"))
    return let(
        holders,
        lambda hold: tr.without(
            tree,
            lambda x: (x["tag"] == "header")
            & ~F.exists(hold, lambda h: (h["pre"] < x["pre"]) & (x["pre"] <= h["last"])),
        ),
    )


def main_node(tree: Column) -> Column:
    """``main`` when it really holds the page (half of the body's text), else the body."""

    def size(node: Column) -> Column:
        return F.aggregate(tr.strings_of(tree, node), F.lit(0), lambda acc, s: acc + F.length(s))

    body = F.coalesce(tr.first_node(tree, lambda x: x["tag"] == "body"), tr.node_at(tree, F.lit(0)))
    main = F.coalesce(
        tr.first_node(tree, lambda x: x["tag"] == "main"),
        tr.first_node(tree, lambda x: tr.attr(x, "role") == "main"),
    )
    return let(body, lambda b: let(main, lambda m: F.when(m.isNotNull() & (size(m) * 2 >= size(b)), m).otherwise(b)))


def grouped(rows: Column, kind: str) -> Column:
    """(key, value) rows to (kind, key, values): keys in first-seen order, values in page order."""
    marked = F.array_sort(F.transform(rows, lambda x, i: F.struct(x["key"].alias("key"), i.alias("at"), x["value"].alias("value"))))
    groups = per_run(marked, "key", lambda first, run: F.struct(
        first["at"].alias("at"), F.lit(kind).alias("kind"), first["key"].alias("key"),
        F.transform(run, lambda x: x["value"]).alias("values")))
    return F.transform(F.array_sort(groups), lambda g: F.struct(*[g[f].alias(f) for f in ("kind", "key", "values")]))


def meta_rows(dom: Column) -> Column:
    """Named meta tags as (key, value) in page order, unfiltered."""
    tags = F.filter(dom["nodes"], lambda x: x["tag"] == "meta")
    rows = F.transform(
        tags,
        lambda x: F.struct(
            tx.strip(tx.first_filled(tr.attr(x, "name"), tr.attr(x, "property"), tr.attr(x, "itemprop"))).alias("key"),
            tr.attr(x, "content").alias("value"),
        ),
    )
    return F.filter(rows, lambda r: (r["key"] != "") & (F.coalesce(r["value"], F.lit("")) != ""))


def metadata(dom: Column) -> Column:
    """The page's own metadata: meta tags without technical ones, then structured data of bounded size."""
    plain = F.filter(meta_rows(dom), lambda r: ~r["key"].rlike(IGNORED_META))
    plain = F.transform(plain, lambda r: F.struct(r["key"].alias("key"), tx.clean(r["value"]).alias("value")))
    structured = F.filter(
        grouped(dom["leaves"], "ld"), lambda g: F.length(F.array_join(g["values"], "")) < STRUCTURED_LIMIT
    )
    return F.concat(grouped(plain, "meta"), structured)


def page_text(tree: Column, content: Column) -> Column:
    """Content text, one line per text block."""
    lines = F.split(F.array_join(tr.strings_of(tree, content), "\n"), r"\R|[\x1c-\x1e]")
    tidy = F.filter(F.transform(lines, tx.clean), lambda s: s != "")
    return F.substring(F.array_join(tidy, "\n"), 1, PAGE_TEXT_LIMIT)


def item_struct(dom: Column, url: Column, item_pattern: Column) -> Column:
    """struct(tree, content, metas): the cleaned tree, its content root and the page's metadata."""

    def finish(tree: Column) -> Column:
        return F.struct(
            tree.alias("tree"),
            main_node(tree).alias("content"),
            metadata(dom).alias("metas"),
        )

    bare = tr.without(tr.readable(dom), is_chrome)
    return let(
        let(bare, without_named_chrome),
        lambda a: let(
            without_cards(a, url, item_pattern), lambda b: let(without_site_headers(b), finish)
        ),
    )
