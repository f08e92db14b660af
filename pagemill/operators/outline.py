"""Numbered outline of a page: metadata values, labelled facts and small content elements, for whoever maps fields to
elements. It runs on a handful of sample pages per site, so it uses plain rows and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions import tree as tr
from pagemill.functions import urls
from pagemill.functions.lets import built_once, let, rows_of
from pagemill.operators import values as vl

# --- fixed values -------------------------------------------------------------------------------------------------
INLINE_TAGS = (
    "i", "em", "sub", "sup", "u", "small", "abbr", "code", "figref", "math", "mi", "mo", "mn", "mrow", "msub", "msup",
    "mtext", "mfrac", "br", "wbr",
)
OUTLINE_CAP, FACTS_PER_BLOCK, LONG_PROSE = 280, 40, 8
# ------------------------------------------------------------------------------------------------------------------


def shown_attrs(tree: Column, node: Column, label: Column) -> Column:
    """Tag, classes, label and links of an element in one line."""
    css = F.array_join(F.slice(tr.classes(node), 1, 4), " ")
    href = tr.attr(node, "href")
    documents = F.filter(
        F.slice(F.filter(tr.below(tree, node), lambda x: (x["tag"] == "a") & tr.attr(x, "href").isNotNull()), 1, 3),
        lambda x: tr.attr(x, "href").rlike(vl.DOWNLOAD),
    )
    extra = F.concat(
        F.when(label != "", F.array(F.concat(F.lit("labelled '"), label, F.lit("'")))).otherwise(tr.empty("string")),
        F.when((node["tag"] == "a") & (href != ""), F.array(F.concat(F.lit("link to "), F.substring(href, 1, 120))))
        .otherwise(tr.empty("string")),
        F.when((node["tag"] == "time") & (tr.attr(node, "datetime") != ""),
               F.array(F.concat(F.lit("datetime="), tr.attr(node, "datetime")))).otherwise(tr.empty("string")),
        F.when(node["tag"] != "a", F.transform(
            documents, lambda x: F.concat(F.lit("contains link to "), F.substring(tr.attr(x, "href"), 1, 120))))
        .otherwise(tr.empty("string")),
    )
    return F.concat(
        F.lit("<"), node["tag"],
        F.when(css != "", F.concat(F.lit(" class='"), css, F.lit("'"))).otherwise(F.lit("")), F.lit(">"),
        F.when(F.size(extra) > 0, F.concat(F.lit(" "), F.array_join(extra, "; "))).otherwise(F.lit("")),
    )


@built_once
def _entries(item: str) -> Column:
    """Visited elements of one page, in document order."""
    tree, content = F.col(item)["tree"], F.col(item)["content"]

    def described(x: Column) -> Column:
        own = tr.own_text(tree, x)
        branches = F.size(F.filter(tr.children(tree, x), lambda c: tr.text_of(tree, c) != ""))
        return F.struct(
            x.alias("node"), tr.text_of(tree, x).alias("text"), own.alias("own"),
            ((own != "") | (branches != 1)).alias("branching"),
            tr.facts_of(tree, x).alias("facts"),
        )

    def stops(e: Column) -> Column:
        return (F.size(e["facts"]) >= 2) | (e["node"]["tag"] == "p") | (F.length(e["own"]) >= 100)

    targets = F.filter(
        F.transform(F.filter(tr.below(tree, content), lambda x: tr.text_of(tree, x) != ""), described),
        lambda e: e["branching"],
    )

    def visited(found: Column) -> Column:
        closed = F.transform(F.filter(found, stops), lambda e: F.struct(e["node"]["pre"].alias("pre"), e["node"]["last"].alias("last")))
        return let(closed, lambda c: F.filter(
            found, lambda e: ~F.exists(c, lambda s: (s["pre"] < e["node"]["pre"]) & (e["node"]["pre"] <= s["last"]))))

    def entry(e: Column) -> Column:
        return let(tr.label_of(tree, e["node"]), lambda label: F.struct(
            e["node"]["pre"].alias("pre"), e["node"].alias("node"), e["text"].alias("text"), label.alias("label"),
            F.slice(e["facts"], 1, FACTS_PER_BLOCK).alias("facts"),
            tr.css_path(tree, e["node"], content).alias("path"),
            shown_attrs(tree, e["node"], label).alias("attrs"),
        ))

    return F.transform(let(targets, visited), entry)


@built_once
def _fact_rows(item: str) -> Column:
    tree, content = F.col(item)["tree"], F.col(item)["content"]
    blocks = F.transform(
        tr.below(tree, content), lambda x: F.struct(x.alias("node"), tr.facts_of(tree, x).alias("facts")))

    def rows(block: Column) -> Column:
        return let(tr.css_path(tree, block["node"], content), lambda path: F.transform(
            block["facts"],
            lambda f, i: F.struct(block["node"]["pre"].alias("block"), path.alias("block_path"), i.alias("pos"), f["label"].alias("label"),
                                  tx.label_key(f["label"]).alias("label_key"), f["value"].alias("value"))))

    return F.flatten(F.transform(F.filter(blocks, lambda b: F.size(b["facts"]) > 0), rows))


def labelled_facts(items: DataFrame, key: str = "page_id") -> DataFrame:
    """Every "Label: value" pair of every block: ``key, block, block_path, pos, label, label_key, value``."""
    return rows_of(items, [key], _fact_rows("item"), "label")


@built_once
def _outline_column(item: str) -> Column:
    """Metadata values and visited elements of one page as entries of one shape, so that a page is worked through once."""
    no_facts = F.array().cast("array<struct<label:string,value:string>>")
    metas = F.transform(F.col(item)["metas"], lambda m, i: let(F.array_join(m["values"], "; "), lambda shown: F.struct(
        F.lit(0).alias("part"), i.alias("pre"), F.lit(None).cast(tr.NODE).alias("node"),
        F.concat(m["key"], F.lit(": "), F.substring(shown, 1, 300)).alias("text"), F.lit("").alias("label"), no_facts.alias("facts"),
        F.concat(m["kind"], F.lit(":"), m["key"]).alias("path"),
        F.concat(F.lit("meta "), m["key"], F.lit(" = "), F.substring(shown, 1, 110)).alias("attrs"), m["values"].alias("values"))))
    elements = F.transform(_entries(item), lambda e: F.struct(
        F.lit(1).alias("part"), *[e[f].alias(f) for f in ("pre", "node", "text", "label", "facts", "path", "attrs")],
        F.lit(None).cast("array<string>").alias("values")))
    return F.concat(metas, elements)


def outline_rows(items: DataFrame, key: str = "page_id", cap: int = OUTLINE_CAP) -> DataFrame:
    """``(key, n, kind, selector, label, text, values, node, line)``: entries numbered from 0, metadata first.

    Pages are worked through where they are; only their entries move, once, to be numbered by key."""
    in_order = Window.partitionBy(key).orderBy("pre")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    element, block = F.col("part") == 1, F.size("facts") >= 2
    long = element & ~block & (F.length("text") > 150) & (F.col("label") == "")
    kept = F.when(long, F.sum(long.cast("int")).over(in_order) <= LONG_PROSE).otherwise(
        (F.length("text") <= 300) & ((F.col("label") != "") | ~F.col("text").rlike(r"(?U)^[\d\s.,]{1,6}$"))
    ) & ~F.col("node.tag").isin(*INLINE_TAGS)
    adds = F.when(element, F.when(block, F.size("facts")).otherwise(kept.cast("int"))).otherwise(0)
    entries = (
        rows_of(items, [key, F.size("item.metas").alias("n_meta")], _outline_column("item"), "part")
        .withColumn("adds", adds)
        .withColumn("so_far", F.col("n_meta") + F.coalesce(F.sum("adds").over(before), F.lit(0)))
        .where(~element | ((F.col("adds") > 0) & (F.col("so_far") < cap)))
    )
    no_node, no_values = F.lit(None).cast(tr.NODE), F.lit(None).cast("array<string>")

    def row(sub: Column, kind: str, selector: Column, label: Column, text: Column, values: Column, node: Column, line: Column) -> Column:
        return F.struct(sub.cast("int").alias("sub"), F.lit(kind).alias("kind"), selector.alias("selector"), label.alias("label"),
                        text.alias("text"), values.alias("values"), node.alias("node"), line.alias("line"))

    label, text, path = F.col("label"), F.col("text"), F.col("path")
    meta = F.array(row(F.lit(0), "meta", path, label, text, F.col("values"), no_node, F.col("attrs")))
    facts = F.transform("facts", lambda f, i: row(
        i, "fact", F.concat(F.lit("kv:"), path, F.lit(" || "), f["label"]), f["label"], F.concat(f["label"], F.lit(": "), f["value"]),
        F.array(f["value"]), no_node, F.concat(F.lit("fact '"), f["label"], F.lit("' = "), F.substring(f["value"], 1, 110))))
    plain = F.array(row(
        F.lit(0), "element", F.concat(path, F.when(label != "", F.concat(F.lit(" || "), label)).otherwise(F.lit(""))), label, text,
        no_values, F.col("node"), F.concat(F.substring("attrs", 1, 90), F.lit(" "), F.substring(text, 1, 110))))
    rows = rows_of(entries, [key, "part", "pre"], F.when(~element, meta).when(block, facts).otherwise(plain), "kind")
    numbered = Window.partitionBy(key).orderBy("part", "pre", "sub")
    return rows.withColumn("n", (F.row_number().over(numbered) - 1).cast("bigint")).drop("part", "pre", "sub")


def outline_text(outline: DataFrame, key: str = "page_id") -> DataFrame:
    """One text per page, a numbered line per entry; the cap bounds its length."""
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("line"))
    rows = outline.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))
    return rows.select(key, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("outline"))


@built_once
def _picked_value(item: str, url: str, kind: str) -> Column:
    candidate = F.struct(F.col("node"), F.col("text"), F.col("values"))
    tree = F.col(item)["tree"]
    return let(candidate, lambda c: let(urls.parts(F.col(url)), lambda base: let(
        vl.value_of(tree, c, F.col(kind), base),
        lambda v: F.struct(v["value"].alias("value"), v["items"].alias("items"),
                           vl.fits(tree, c, v, F.col(kind)).alias("fits")),
    )))


def learn_selectors(picks: DataFrame, outline: DataFrame, items: DataFrame, key: str = "page_id") -> DataFrame:
    """``picks(key, field, type, n, page_order)`` to one selector per field: picks outside the outline or of the wrong
    shape are dropped, the most common selector wins, the first seen on ties.

    ``items(key, url)`` has the pages as ``item`` (``with_items``) or as they are stored (``html, item_pattern``): then only
    pages of which an element was picked are parsed. Metadata and facts bring their values, so no tree moves for them.
    Every page may have picks, so none of the joins is broadcast for the size its tables seem to have."""
    from pagemill.operators.recipes import with_items

    chosen = picks.hint("merge").join(outline.hint("merge"), [key, "n"])
    tree = items.select("item").schema["item"].dataType if "item" in items.columns else with_items(items).select("item").schema["item"].dataType
    valued = chosen.where("node IS NULL").join(items.select(key, "url").hint("merge"), key).withColumn("item", F.lit(None).cast(tree))
    marked = chosen.where("node IS NOT NULL")
    if "item" not in items.columns:
        items = with_items(items.join(marked.select(key).distinct().hint("merge"), key, "left_semi"))
    marked = marked.join(items.select(key, "url", "item").hint("merge"), key)
    fitting = [rows.withColumn("v", _picked_value("item", "url", "type")).where("v.fits").select("field", "selector", "page_order") for rows in (valued, marked)]
    return most_common(fitting[0].unionByName(fitting[1]), ["field"], "selector", "page_order")


def most_common(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Mode with first-seen ties: pre-aggregated per value, then the best by (count, first seen)."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    best = F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first_seen")))
    return counted.groupBy(*keys).agg(best.alias("best")).select(*keys, f"best.{value}", "best.n")
