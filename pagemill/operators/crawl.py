"""Find where sites keep their listings: best-first rounds over an archive of stored pages, all sites at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.lets import rows_of
from pagemill.operators import graph as gr
from pagemill.operators import links as lk
from pagemill.operators import scoring as sc
from pagemill.session import cut_lineage

Score = Callable[[DataFrame], DataFrame]

MENU_LINKS, JUDGED, TOP = 80, 6, 5  # fixed values
FEW = 100_000  # fixed value: so many addresses of a round are broadcast


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def crawl(
    starts: DataFrame, archive: DataFrame, score_pages: Score, score_links: Score, *,
    max_pages: int = 30, max_depth: int = 3, tabs: int = 4, avoid: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """``starts(site, url)`` over ``archive``, with the fetched URL as ``fetch_url``: stored pages (``url, html``), of which
    only those a round looks up are parsed, or parsed ones (``parse_pages``).

    Per site and round the best ``2 * tabs`` queued URLs are looked up, judged (``score_pages`` adds ``hub, role,
    holds`` to rows with ``state``), and their new links are scored (``score_links`` adds ``leads``) and queued, until
    the page budget is used or the queue is empty. ``avoid(site, prefix)`` steers away from rejected sections.

    Every round works on all sites with ``site`` as key; a round's state is checkpointed, so its plan never grows and
    lost executors only repeat the round. Returns ``places`` (ranked), ``sections``, ``menu`` and ``top``."""
    best = (F.desc("prio"), "round", "ahead", "pos")
    start = starts.select("site", urls.normalise(F.col("url")).alias("url"))
    scope = start.select("site", F.concat(urls.without_slash(urls.path(F.col("url"))), F.lit("/")).alias("scope"))
    if avoid is None:
        avoid = starts.sparkSession.createDataFrame([], "site string, prefix string")
    avoided = avoid.groupBy("site").agg(F.collect_set("prefix").alias("avoid"))
    sites = cut_lineage(scope.join(avoided, "site", "left").withColumn(
        "avoid", F.coalesce("avoid", F.array().cast("array<string>"))))
    lookup = _lookup(archive)
    queue = cut_lineage(start.select(
        "site", "url", F.lit("").alias("text"), F.lit(0).alias("depth"), F.lit(1.0).alias("prio"), F.lit(-1).alias("round"),
        F.lit(0).alias("ahead"), F.lit(0).alias("pos"),
    ))
    visited: list[DataFrame] = []
    round_ = 0
    while not queue.isEmpty():
        done = _union(visited) if visited else None
        budget = queue.select("site").distinct()
        if done is not None:
            spent = done.groupBy("site").agg(F.count(F.lit(1)).alias("spent"))
            budget = budget.join(spent, "site", "left").where(F.coalesce("spent", F.lit(0)) < max_pages)
            budget = budget.withColumn("left", F.least(F.lit(2 * tabs), max_pages - F.coalesce("spent", F.lit(0)))).drop("spent")
        else:
            budget = budget.withColumn("left", F.lit(min(2 * tabs, max_pages)))
        ranked = numbered(queue.join(budget, "site"), *best)
        batch = ranked.where((F.col("rn") <= 2 * tabs) & (F.col("rn") <= F.col("left")))
        fetched = lookup(batch.select(F.col("site").alias("asked_site"), F.col("url").alias("key"), "depth", "prio", "rn"))
        fetched = fetched.where(F.col("asked_site") == F.col("site")).drop("asked_site")
        # redirects may land on a page already visited, in an earlier round or in this one
        fetched = first_landings(fetched, "rn")
        if done is not None:
            fetched = fetched.join(done.select("site", "norm_url"), ["site", "norm_url"], "left_anti")
        judged = score_pages(fetched.withColumn("state", sc.page_state(F.col("url"))))
        places = cut_lineage(judged.select(
            "site", "url", "norm_url", F.lit(round_).alias("round"), F.col("rn").alias("visit"), "depth",
            "role", "holds", F.col("hub").cast("double").alias("hub"), F.col("kids").alias("items"), "paged", "gpath",
            F.round(F.col("prio"), 4).alias("prio"), "title", "links",
            lk.titled_sample(F.col("links"), F.col("gpath"), 15, 6).alias("sample"),
        ))
        if not places.isEmpty():
            visited.append(places)
        done = _union(visited) if visited else places

        rest = ranked.where(~((F.col("rn") <= 2 * tabs) & (F.col("rn") <= F.col("left")))).drop("rn", "left")
        found = rows_of(done, ["site", "depth", "round", "visit"], "links", "url").join(sites.select("site"), "site", "left_semi")
        listed = done.where((F.col("items") >= 5) & (F.col("gpath") != "/")).join(sites, "site").where(
            F.col("gpath") != F.col("scope")
        ).groupBy("site", "gpath").agg(F.min("round").alias("since"))
        # a list confirmed in this round: queued entries of its pattern are that list's contents, not new places
        demoted = rest.withColumn("gpath", urls.folder_pattern(urls.path(F.col("url")))).join(
            listed.where(F.col("since") == round_), ["site", "gpath"], "left"
        ).withColumn("prio", F.when(F.col("since").isNotNull(), F.col("prio") * 0.2).otherwise(F.col("prio"))).drop("gpath", "since")

        open_links = places_to_go(found.where(F.col("depth") < max_depth))
        first_seen = open_links.groupBy("site", "url").agg(
            F.min_by(F.struct("text", "depth", "round", "visit", "pos"), F.struct("round", "visit", "pos")).alias("f")
        ).join(start, ["site", "url"], "left_anti")
        new = first_seen.where(F.col("f.round") == round_)
        probes = new.select("url").distinct()
        under = gr.count_under(probes, found.select("url").distinct())
        states = new.join(under, "url").select(
            "site", "url", F.col("f.text").alias("text"), (F.col("f.depth") + 1).alias("depth"),
            F.col("f.visit").alias("ahead"), F.col("f.pos").alias("pos"), "under",
        )
        scored = score_links(states.withColumn("state", sc.link_state(F.col("text"), F.col("url"), F.col("under"))))
        path = urls.path(F.col("url"))
        queued = (
            scored.withColumn("gpath", urls.folder_pattern(path))
            .join(listed.select("site", "gpath", F.lit(True).alias("listed")), ["site", "gpath"], "left")
            .join(sites, "site")
            .withColumn("prio", gr.link_priority(
                F.col("leads"), F.col("under"), F.coalesce("listed", F.lit(False)),
                F.startswith(path, F.col("scope")), F.exists("avoid", lambda a: F.startswith(path, a))))
            .select("site", "url", "text", "depth", "prio", F.lit(round_).alias("round"), "ahead", "pos")
        )
        queue = cut_lineage(demoted.unionByName(queued))
        round_ += 1

    everything = _union(visited)
    n_places = everything.groupBy("site").agg(F.count(F.lit(1)).alias("places"))
    into = gr.inlinks(rows_of(
        everything, ["site", F.col("norm_url").alias("src")], F.transform("links", lambda k: F.struct(k["url"].alias("dst"))), "dst"))
    scored = (
        everything.drop("links").join(n_places, "site")
        .join(into.withColumnRenamed("dst", "norm_url"), ["site", "norm_url"], "left")
        .withColumn("linked_from", gr.linked_from(F.coalesce("inlinks", F.lit(0)), F.col("places")))
        .withColumn("score", F.round(gr.page_score(F.col("hub"), F.col("items"), F.col("paged")), 4))
        .withColumn("score", gr.prominent_score(F.col("score"), F.col("linked_from")))
        .withColumn("visit", F.col("round") * 1000 + F.col("visit"))
        .drop("inlinks", "places")
    )
    ranked = gr.rank_places(scored)
    menu = rows_of(everything.where("depth = 0"), ["site"], "links", "url").select("site", "pos", "url", "text").where(
        F.length("text").between(2, 40)
    )
    return {
        "places": ranked, "sections": gr.sections(ranked), "menu": menu,
        "top": ranked.where(F.col("rank") <= TOP), "answer": ranked.where("rank = 1").select("site", "url"),
    }


def _lookup(archive: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Rows with a ``key`` to the same rows with the parsed page of that address.

    Several stored pages may share an address: the one fetched by exactly that address counts, else the first in order.
    For stored markup this is settled on the addresses alone; a round then finds its pages by a join before they are parsed."""
    stored = Window.partitionBy("key").orderBy(F.col("fetch_url") != F.col("key"), F.length("fetch_url"), "fetch_url")
    raw = "html" in archive.columns
    known = (archive.select("fetch_url") if raw else archive).withColumn("key", urls.normalise(F.col("fetch_url")))
    known = cut_lineage(known.withColumn("nth", F.row_number().over(stored)).where("nth = 1").drop("nth"))
    if not raw:
        return lambda asked: asked.join(known, "key")

    def look_up(asked: DataFrame) -> DataFrame:
        wanted = cut_lineage(asked.join(known, "key"))
        hint = "broadcast" if wanted.count() <= FEW else "merge"
        return lk.parse_pages(archive.join(wanted.hint(hint), "fetch_url").dropDuplicates(["asked_site", "key"]))

    return look_up


def numbered(queue: DataFrame, *best: Column | str) -> DataFrame:
    """A queue's rows with ``rn``, their place within their site in the order ``best``. A filter on ``rn`` is cut before the
    shuffle."""
    return queue.withColumn("rn", F.row_number().over(Window.partitionBy("site").orderBy(*best)))


def first_landings(fetched: DataFrame, order: Column | str) -> DataFrame:
    """Redirects can land on a page already read: the first fetch (by ``order``) that ends at an address stands for it."""
    once = Window.partitionBy("site", "norm_url").orderBy(order)
    return fetched.withColumn("nth", F.row_number().over(once)).where("nth = 1")


def places_to_go(links: DataFrame, url: str = "url") -> DataFrame:
    """Links that lead to places of their own: not to a further page of a list."""
    return links.where(~urls.is_page_number(F.col(url)))


def unseen(links: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct places (url) that links lead to and that are not ``known(url)``."""
    return places_to_go(links).select("url").distinct().join(known.select("url").distinct(), "url", "left_anti")


def guessed_addresses(plans: DataFrame, known: DataFrame) -> DataFrame:
    """Root and slug of every listing name, but for those already known. ``plans(site, root, names)``, ``known(url)``."""
    seen = known.select(urls.without_slash(F.col("url")).alias("url")).distinct()
    guesses = plans.select("site", "root", F.explode("names").alias("name")).withColumn("slug", urls.slug(F.col("name")))
    return guesses.where((F.col("name") != "") & (F.length("slug") < 30)).select(
        "site", F.concat("root", F.lit("/"), "slug").alias("url")).distinct().join(seen, "url", "left_anti")


def needs_rendering(judged: DataFrame, known: DataFrame) -> DataFrame:
    """Pages that are on topic and have pages beneath them but list nothing: their list is loaded by script, so the
    page has to be stored again from a browser."""
    under = gr.count_under(judged.select(F.col("norm_url").alias("url")).distinct(), known)
    return judged.join(under.withColumnRenamed("url", "norm_url"), "norm_url").where(
        (F.col("hub") > 0.5) & (F.col("kids") < 3) & (F.col("under") >= 2)
    )


def guessed_listings(plans: DataFrame, known: DataFrame, listing: DataFrame) -> DataFrame:
    """Listings no link leads to: ``/datasets``, ``/publications``... from the plan's listing names, kept when the
    archive holds a page there with a real list. ``plans(site, root, names)``, ``known(url)``; ``listing`` comes from
    ``parse_pages`` with ``fetch_url``, or is stored pages (``url, html, fetch_url``): then only guessed ones are parsed."""
    seen = known.select(urls.without_slash(F.col("url")).alias("url")).distinct()
    guesses = guessed_addresses(plans, known)
    pages = listing.withColumn("guess", urls.without_slash(F.col("fetch_url")))
    hits = guesses.withColumnRenamed("site", "plan_site").join(pages.drop("site"), guesses["url"] == pages["guess"]).drop(guesses["url"])
    if "html" in listing.columns:
        hits = lk.parse_pages(hits)
    hits = hits.join(seen.withColumnRenamed("url", "seen"), urls.without_slash(F.col("norm_url")) == F.col("seen"), "left_anti")
    titled = F.size(F.filter("links", lambda k: (k["gpath"] == F.col("item_gpath")) & k["content_pos"].isNotNull() & (F.length(k["text"]) > 15)))
    return hits.withColumn("items", titled).where("items >= 5").select(
        F.col("plan_site").alias("site"), "url", "title", "items",
        lk.titled_sample(F.col("links"), F.col("item_gpath"), 15, 6).alias("sample"),
    )


def judge_input(places: DataFrame, guessed: DataFrame, menu: DataFrame, rejected: DataFrame) -> DataFrame:
    """Numbered candidates and short menu per site, for whoever judges which page is the listing. Candidates are the
    best-scored places outside rejected sections plus the guessed ones; both lists are short by definition."""
    outside = places.withColumn("prefix", urls.first_section(F.col("url"))).join(rejected, ["site", "prefix"], "left_anti")
    w = Window.partitionBy("site").orderBy(F.desc("score"), "visit")
    best = outside.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= JUDGED).select(
        "site", "rn", "url", "title", F.col("items").cast("int").alias("items"), F.col("score").cast("string").alias("score"), "sample")
    extra = guessed.select("site", F.lit(JUDGED + 1).alias("rn"), "url", "title", "items", F.lit("guessed").alias("score"), "sample")
    numbered = best.unionByName(extra).withColumn(
        "n", F.row_number().over(Window.partitionBy("site").orderBy("rn", "url")).cast("bigint")
    )
    line = F.concat(
        F.col("n").cast("string"), F.lit(". "), "url", F.lit("\n   title: "), "title", F.lit("\n   listed items: "),
        F.col("items").cast("string"), F.lit(", score "), "score", F.lit("\n   sample items: "),
        F.when(F.size("sample") > 0, F.array_join(F.slice("sample", 1, 5), " | ")).otherwise(F.lit("(none seen)")),
    )
    cands = numbered.groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("n", line.alias("line"), "url"))).alias("candidates"))
    short = menu.withColumn("rn", F.row_number().over(Window.partitionBy("site").orderBy("pos"))).where(F.col("rn") <= MENU_LINKS)
    menus = short.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(
        "rn", F.concat("text", F.lit(" -> "), "url").alias("line"), "url"))).alias("menu"))
    return cands.join(menus, "site", "full").select(
        "site", "candidates", "menu",
        F.array_join(F.transform("candidates", lambda c: c["line"]), "\n").alias("candidate_text"),
        F.array_join(F.transform("menu", lambda c: c["line"]), "\n").alias("menu_text"),
    )


def judged_listing(inputs: DataFrame, answers: DataFrame) -> DataFrame:
    """``answers(site, pick, picked_url)`` to the chosen URL: a menu link must be on the menu, a number must be a
    candidate's; anything else is no choice (NULL)."""
    joined = inputs.join(answers, "site", "left")
    by_menu = F.get(F.filter("menu", lambda m: m["url"] == F.col("picked_url")), F.lit(0))["url"]
    by_number = F.get(F.filter("candidates", lambda c: c["n"] == F.col("pick")), F.lit(0))["url"]
    return joined.select("site", F.coalesce(by_menu, by_number).alias("listing"))


def locate(
    starts: DataFrame, archive: DataFrame, score_pages: Score, score_links: Score,
    judge: Callable[[DataFrame], DataFrame], guesses: Callable[[DataFrame], DataFrame] | None = None, **budget,
) -> DataFrame:
    """Two attempts: sites whose judge rejects every candidate are crawled once more, away from the rejected sections.
    ``judge`` maps ``judge_input`` rows to ``answers``. Returns ``(site, listing)``."""
    spark = starts.sparkSession
    avoid = spark.createDataFrame([], "site string, prefix string")
    no_guess = spark.createDataFrame([], "site string, url string, title string, items int, sample array<string>")
    chosen = []
    for _ in range(2):
        found = crawl(starts, archive, score_pages, score_links, avoid=avoid, **budget)
        guessed = guesses(found["places"]) if guesses else no_guess
        inputs = cut_lineage(judge_input(found["places"], guessed, found["menu"], avoid))
        picks = cut_lineage(judged_listing(inputs, judge(inputs)))
        chosen.append(picks.where("listing is not null"))
        starts = starts.join(picks.where("listing is null").select("site"), "site", "left_semi")
        if starts.isEmpty():
            break
        rejected = inputs.select("site", F.explode("candidates").alias("c")).select(
            "site", urls.first_section(F.col("c.url")).alias("prefix")).where("prefix <> ''")
        avoid = cut_lineage(avoid.unionByName(rejected).distinct())
    return _union(chosen)
