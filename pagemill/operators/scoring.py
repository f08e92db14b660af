"""Where a model's opinion enters: a batch scoring hook, the scores' tables, and the choices made from scores."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import text as tx
from pagemill.functions import tree as tr
from pagemill.functions import urls
from pagemill.functions.lets import built_once, let, rows_of
from pagemill.operators import values as vl
from pagemill.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BEAM, KEEP, LEVELS, FINALISTS, GUESS = 2, 0.2, 10, 3, 0.5  # fixed values
EXEMPT = ("date", "number", "url", "money")

BatchScorer = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def scorer(score: BatchScorer, returns: T.DataType | None = None):
    """A user's batch scorer as a column function. It gets an iterator over Arrow batches, so a model is loaded once
    per task and fed whole batches."""
    def batches(states: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from score(states)

    return F.pandas_udf(batches, returns or T.DoubleType(), F.PandasUDFType.SCALAR_ITER).asNondeterministic()


def page_state(url: Column) -> Column:
    """How a page is described to a scoring model; expects the columns of ``parse_pages``."""
    listed = F.transform(
        F.array_sort(F.transform(
            F.filter(F.col("links"), lambda k: (k["gpath"] == F.col("gpath")) & k["content_pos"].isNotNull()),
            lambda k: F.struct(k["content_pos"].alias("at"), k["text"].alias("text")))),
        lambda k: k["text"],
    )
    examples = let(listed, lambda t: F.array_join(F.slice(F.filter(t, lambda x: F.length(x) > 15), 1, 8), " ; "))
    return F.concat(
        F.lit("URL path: "), urls.path(url), F.lit("\nTitle: "), F.col("title"),
        F.lit("\nMain heading: "), F.col("h1"), F.lit("\nSection headings: "), F.array_join("heads", " | "),
        F.lit("\nMain content lists "), F.size(listed).cast("string"), F.lit(" similar linked items (at "),
        F.when(F.col("gpath") == "", F.lit("-")).otherwise(F.col("gpath")), F.lit("); pagination: "),
        F.when(F.col("paged"), F.lit("yes")).otherwise(F.lit("no")), F.lit("; PDF downloads: "),
        F.col("pdfs").cast("string"), F.lit("; dates shown: "), F.col("dates").cast("string"),
        F.lit("\nListed items: "), let(examples, lambda e: F.when(e == "", F.lit("(none)")).otherwise(e)),
    )


def link_state(text: Column, url: Column, under: Column) -> Column:
    return F.concat(
        F.lit("Link text: "), F.when(text == "", F.lit("(none)")).otherwise(text), F.lit("\nURL path: "), urls.path(url),
        F.lit("\nPath depth: "), urls.path_depth(url).cast("string"),
        F.lit("\nKnown site pages under this path: "), under.cast("string"),
    )


# ---- beam walk down the page tree --------------------------------------------------------------------------------


@built_once
def _child_rows(item: str, pre: str) -> Column:
    """Children of an element (or of the page's root when ``pre`` is -1) with text or a link, wrappers collapsed."""
    tree = F.col(item)["tree"]
    parent = F.when(F.col(pre) < 0, F.col(item)["content"]).otherwise(tr.node_at(tree, F.col(pre)))
    seen = F.when(F.col(pre) < 0, F.array(F.col(item)["content"])).otherwise(let(parent, lambda p: F.filter(
        tr.children(tree, p),
        lambda c: (tr.text_of(tree, c) != "") | ((c["tag"] == "a") & (F.coalesce(tr.attr(c, "href"), F.lit("")) != "")))))
    return F.transform(seen, lambda c: let(tr.innermost(tree, c), lambda n: F.struct(
        n["pre"].alias("pre"), n.alias("node"), tr.text_of(tree, n).alias("text"))))


def stored_items(items: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages hashed by key and stored, once for the walk and its last round: the only copy of the trees."""
    return cut_lineage(items.repartition(key))


def beam_walk(jobs: DataFrame, items: DataFrame, score: Callable[[DataFrame], DataFrame], key: str = "page_id") -> DataFrame:
    """``jobs(key, field, type)`` walk down their page trees together, one level per round: of all children of a job's
    open blocks the best two with a score of at least 0.2 stay (the best one always does). Returns the kept blocks
    ``(key, field, type, level, pre, text, p)``.

    ``score`` adds ``p`` to rows with ``field`` and ``state``. A level holds at most two blocks per job, so rounds stay
    narrow; the number of levels is fixed. Every level reads ``items``: they should be stored, hashed by ``key``
    (:func:`stored_items`)."""
    kept = None
    frontier = jobs.select(key, "field", "type", F.lit(-1).alias("pre"))
    # trees are never broadcast or moved: a level only moves its open blocks
    trees = items.select(key, "item").hint("merge")
    levels = []
    for level in range(LEVELS):
        rows = rows_of(frontier.join(trees, key), [key, "field", "type"], _child_rows("item", "pre"), "pre")
        state = F.concat(F.lit("Element: <"), F.col("node.tag"), F.lit(">\nText: "), F.substring("text", 1, 350))
        scored = score(rows.withColumn("state", state))
        best_first = Window.partitionBy(key, "field").orderBy(F.desc("p"), "pre")
        kept = scored.withColumn("rn", F.row_number().over(best_first)).where(
            (F.col("rn") <= BEAM) & ((F.col("p") >= KEEP) | (F.col("rn") == 1))
        )
        kept = cut_lineage(kept.select(key, "field", "type", F.lit(level).alias("level"), "rn", "pre", "node", "text", "p"))
        if kept.isEmpty():
            break
        levels.append(kept)
        # small blocks are the answer or they are not: only longer ones are opened further
        frontier = kept.where((F.length("text") > 40) & (F.col("node.last") > F.col("node.pre"))).select(key, "field", "type", "pre")
    out = levels[0]
    for part in levels[1:]:
        out = out.unionByName(part)
    return out


@built_once
def _finalist_values(item: str, url: str, kind: str, example: str, pattern_hit: str) -> Column:
    candidate = F.struct(F.col("node"), F.col("text"), F.col("values"))
    tree = F.col(item)["tree"]
    return let(candidate, lambda c: let(urls.parts(F.col(url)), lambda base: let(
        vl.value_of(tree, c, F.col(kind), base),
        lambda v: F.struct(v["value"].alias("value"), v["items"].alias("items"), vl.fits(
            tree, c, v, F.col(kind), strict=True, example=F.col(example), pattern_hit=F.col(pattern_hit)).alias("fits")),
    )))


def finalists(
    kept: DataFrame, items: DataFrame, fields: DataFrame, score: Callable[[DataFrame], DataFrame], key: str = "page_id"
) -> DataFrame:
    """Candidates of the last round: kept blocks, small children of the last two kept, and every metadata value; those
    of the field's shape are scored, the best three per job stay. ``fields(field, type, example, pattern)``."""
    from pagemill.operators.recipes import search_patterns

    blocks = kept.select(key, "field", "pre", "node", "text")
    latest = Window.partitionBy(key, "field").orderBy(F.desc("level"), F.desc("rn"))
    opened = kept.withColumn("k", F.row_number().over(latest)).where("k <= 2").select(key, "field", "pre")
    children = rows_of(opened.join(items.select(key, "item").hint("merge"), key), [key, "field"], _child_rows("item", "pre"), "pre")
    elements = blocks.unionByName(children).dropDuplicates([key, "field", "pre"]).select(
        key, "field", "pre", "node", "text", F.lit(None).cast("array<string>").alias("values"), F.lit("").alias("meta"))
    # as many rows as pages have metadata: an estimate may call them few, but they must not be broadcast
    metas = kept.select(key, "field").distinct().join(
        items.select(key, F.posexplode_outer("item.metas").alias("at", "m")).where("m is not null").hint("merge"), key
    ).select(
        key, "field", (F.lit(-2) - F.col("at")).alias("pre"), F.lit(None).cast(tr.NODE).alias("node"),
        F.concat("m.key", F.lit(": "), F.substring(F.array_join("m.values", "; "), 1, 300)).alias("text"),
        F.col("m.values").alias("values"), F.lit("meta").alias("meta"),
    )
    rows = elements.unionByName(metas).join(fields, "field")
    # a plan's pattern is a Python regular expression over the candidate's own text
    subject = F.when(F.col("node").isNull(), F.array_join("values", "\n")).otherwise(F.col("text"))
    hit = search_patterns.asNondeterministic()(subject, F.array(F.coalesce("pattern", F.lit(""))))
    rows = rows.withColumn("hit", hit).withColumn(
        "pattern_hit", F.when(F.coalesce("pattern", F.lit("")) != "", F.get("hit", F.lit(0)) != "")
    )
    # trees join behind the hop to Python, which would hold one per candidate
    rows = rows.join(items.select(key, "url", "item").hint("merge"), key)
    rows = rows.withColumn("v", _finalist_values("item", "url", "type", "example", "pattern_hit")).drop("item")
    state = F.when(F.col("meta") == "meta", F.concat(F.lit("Page metadata: "), F.substring("text", 1, 400))).otherwise(
        F.concat(F.lit("Element: <"), F.col("node.tag"), F.lit(">\nText: "), F.substring("text", 1, 350))
    )
    scored = score(rows.where("v.fits").select(key, "url", "field", "type", "pre", "v.value", "v.items", state.alias("state")))
    best = Window.partitionBy(key, "field").orderBy(F.desc("p"), "pre")
    return scored.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= FINALISTS).drop("state")


def assign(claims: DataFrame, key: str = "page_id") -> DataFrame:
    """One text answers one field per page: claims are taken in order of confidence, a field keeps its best claim whose
    text is still free. Dates, numbers, links and amounts are exempt (two dates may well be equal).

    Sequential by nature, but only within a page, and a page has at most three claims per field: the fold runs over one
    short array per page."""
    text = F.lower(F.substring(tx.clean(F.coalesce(F.array_join("items", "; "), F.col("value"))), 1, 200))
    place = F.col("field_pos") if "field_pos" in claims.columns else F.lit(0)  # claims of equal confidence: in the plan's order
    claim = F.struct(
        (-F.col("p")).alias("order"), place.cast("int").alias("place"), F.col("field"), F.col("rn"), F.col("value"), F.col("items"), F.col("p"),
        F.when(F.col("type").isin(*EXEMPT), F.lit("")).otherwise(text).alias("vkey"),
    )
    kind = "array<struct<order:double,place:int,field:string,rn:int,value:string,items:array<string>,p:double,vkey:string>>"
    pages = claims.groupBy(key).agg(F.array_sort(F.collect_list(claim)).cast(kind).alias("claims"))
    won = F.aggregate(
        "claims", F.array().cast(kind),
        lambda acc, c: F.when(
            F.exists(acc, lambda a: (a["field"] == c["field"]) | ((c["vkey"] != "") & (a["vkey"] == c["vkey"]))), acc
        ).otherwise(F.concat(acc, F.array(c))),
    )
    return rows_of(pages, [key], won, "field").select(key, "field", "value", "items", F.round("p", 3).alias("confidence"), "p")


def with_guesses(values: DataFrame, guesses: DataFrame, key: str = "page_id") -> DataFrame:
    """Fill fields without a selector by sure guesses, marked as such; validated values are never touched."""
    sure = guesses.where(F.col("p") >= GUESS).select(
        key, "field", F.col("value").alias("g_value"), F.col("items").alias("g_items"), F.col("confidence").alias("g_conf"))
    use = (F.col("how") == "") & F.col("g_conf").isNotNull()
    return values.join(sure, [key, "field"], "left").select(
        *[c for c in values.columns if c not in ("value", "items", "how")],
        F.when(use, F.col("g_value")).otherwise(F.col("value")).alias("value"),
        F.when(use, F.col("g_items")).otherwise(F.col("items")).alias("items"),
        F.when(use, F.lit("guess")).otherwise(F.col("how")).alias("how"),
        F.when(use, F.col("g_conf")).alias("guess_confidence"),
    )
