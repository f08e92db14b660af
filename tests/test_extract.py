import pytest
from pyspark.sql import functions as F

from pagemill.functions import tree as tr
from pagemill.functions import urls
from pagemill.functions.lets import let
from pagemill.operators import content as ct
from pagemill.operators import outline as ol
from pagemill.operators import recipes as rc
from pagemill.operators import values as vl


def facts_block(pairs, tag="b", name="panel"):
    """Labelled facts in one block: the label in its own element, the value as the text behind it."""
    return f'<div class="{name}">' + "\n".join(f"<{tag}>{label}</{tag}>: {value}" for label, value in pairs) + "</div>"


def card(href, title, words=0):
    return f'<section><a href="{href}">{title}</a><p>{"word " * words}</p></section>'


def items(spark, *rows):
    df = spark.createDataFrame(
        [(i, u, h, p) for i, (u, h, p) in enumerate(rows)], "page_id long, url string, html string, item_pattern string")
    return rc.with_items(df)


def texts(spark, *rows):
    df = items(spark, *rows).select("page_id", ct.page_text(F.col("item.tree"), F.col("item.content")).alias("t"))
    return [r.t for r in sorted(df.collect(), key=lambda r: r.page_id)]


def test_metadata(spark):
    """Three ways to name a key, repeated keys as lists, look-and-feel keys left out, JSON-LD without its trails."""
    metas = "".join(f'<meta {way}="k{i}" content="v{i}">' for i, way in enumerate(("name", "property", "itemprop")))
    again = "".join(f'<meta name="again" content="{v}">' for v in "xyz")
    looks = '<meta name="robots" content="none"><meta name="csrf-token" content="1"><meta property="og:image" content="i.png">'
    data = '<script type="application/ld+json">[{"@type": "BreadcrumbList", "name": "way"}, {"@type": "Thing", "weight": 7}]</script>'
    got = {r.page_id: [(m["kind"] + ":" + m["key"], m["values"]) for m in r.metas] for r in items(
        spark, ("", metas + again, ""), ("", looks + data, ""), ("", '<meta name="q" content="salt &amp; &#8220;tar&#8221;">', "")).select("page_id", "item.metas").collect()}
    assert got[0] == [("meta:k0", ["v0"]), ("meta:k1", ["v1"]), ("meta:k2", ["v2"]), ("meta:again", ["x", "y", "z"])]
    assert got[1] == [("ld:@type", ["Thing"]), ("ld:weight", ["7"])]
    assert got[2] == [("meta:q", ["salt & “tar”"])]


@pytest.mark.parametrize("chrome", ['<nav>{}</nav>', '<footer>{}</footer>', '<div role="navigation">{}</div>', '<p aria-hidden="true">{}</p>', '<div id="cookie-box">{}</div>', '<div class="page-sidebar">{}</div>'])
def test_site_chrome_goes_unless_it_holds_the_content(spark, chrome):
    inside, around, named = texts(
        spark, ("", "<main><p>kept one</p>" + chrome.format("gone") + "<p>kept two</p></main>", ""),
        ("", "<p>before</p>" + chrome.format("<i>gone</i>" * 3) + "<p>after</p>", ""),
        ("", '<div class="sidebar-left"><article><h1>Head</h1><p>kept</p></article></div>', ""))
    assert inside.split("\n") == ["kept one", "kept two"] and around.split("\n") == ["before", "after"]
    assert named == "Head\nkept"  # a name of the frame does not take the content along


def test_cards_of_other_items_go(spark):
    """A link to another item takes its block along; links elsewhere, short ones and those of numbers stay."""
    own = "<article><h1>Anchor of 1702</h1><p>" + "iron " * 120 + "</p>"
    other = card("/iron/nails-of-1690", "Nails that held the hull together")
    kept = card("/help", "How to read this page, in many words") + card("/iron/x-1", "Short") + card("/iron/n-1", "170211 993844 1203 x")
    for n in (1, 4):
        text, = texts(spark, ("https://ropes.works/iron/anchor-of-1702", own + other * n + kept + "</article>", "/iron/"))
        assert "Nails" not in text and all(t in text for t in ("iron iron", "How to read", "Short", "993844"))


def test_cards_shrink_the_blocks_around_them(spark):
    card = '<li><a href="/i/other-{0}">Another item with a long title {0}</a> <span>' + "x" * 160 + "</span></li>"
    html = "<body><div><p>" + "y" * 300 + "</p><ul>" + card.format(1) + card.format(2) + card.format(3) + "</ul></div></body>"
    # 1: only its own item (the list is over 500); 2: the rest of the list fits now, so the list goes whole
    assert texts(spark, ("https://x.org/i/me", html, "/i/"))[0] == "y" * 300
    assert "Another item" in texts(spark, ("https://x.org/i/me", html, "/j/"))[0]


META = '<body><p>y</p></body><meta name="k" content="{}">'.format


def shape_cases():
    """html, selector, type, example, fits strictly, fits when graded, value: a rule of each type from both sides."""
    for text, fits, value in (("1702-03-04", True, "1702-03-04"), ("4 March 1702", True, "1702-03-04"), ("Mar 4, 1702", True, "1702-03-04"), ("in due time", False, None)):
        yield META(text), "meta:k", "date", None, fits, True, value
    for text in ("7", "7 fathoms", "£1,200.50"):
        yield META(text), "meta:k", "money", None, True, True, text
    for text in ("a1b2c3", "https://ropes.works/7", "x" * 70 + " 7"):
        yield META(text), "meta:k", "number", None, False, False, None
    for end, fits in (("pdf", True), ("html", True), ("png", False), ("svg", False)):
        yield META(f"https://ropes.works/f.{end}"), "meta:k", "url", None, fits, fits, f"https://ropes.works/f.{end}" if fits else None
    for sep in ("; ", ", "):
        yield META(sep.join(("hemp", "flax", "jute"))), "meta:k", "list", None, True, True, ["hemp", "flax", "jute"]
    yield META("Hanna Tau; Per Oye (Yard, NO), Ida Roe"), "meta:k", "people", None, True, True, ["Hanna Tau", "Per Oye (Yard, NO)", "Ida Roe"]
    yield META("mail@ropes.works"), "meta:k", "people", None, False, False, None
    for n in (2, 5):
        words = [f"strand{chr(97 + k)}" for k in range(n)]
        yield "<main><ul>" + "".join(f"<li>{w}</li>" for w in words + words[:1]) + "</ul></main>", "main > ul", "list", None, True, True, words
    yield "<main><h2>Hold</h2></main>", "main > h2", "text", None, False, True, "Hold"  # one word is too short without an example
    yield "<main><p>Eighty fathoms of three-strand rope for the bower</p></main>", "main > p", "text", "Forty fathoms of rope for the stern", True, True, None


SHAPES = list(shape_cases())


def test_values_and_shapes(spark):
    base = "https://ropes.works/"
    rows = [(i, base, c[0], "", c[1], c[2], c[3]) for i, c in enumerate(SHAPES)]
    df = rc.with_items(spark.createDataFrame(
        rows, "i int, url string, html string, item_pattern string, path string, kind string, example string"))
    df = df.withColumn("s", vl.compile_selector(F.col("path")))
    candidate = vl.find(F.col("item"), F.col("s"), F.lit(None).cast("string"))
    tree, kind = F.col("item.tree"), F.col("kind")
    out = let(candidate, lambda c: let(urls.parts(F.lit(base)), lambda b: let(
        vl.value_of(tree, c, kind, b), lambda v: F.struct(
            v["value"].alias("value"), v["items"].alias("items"),
            vl.fits(tree, c, v, kind, True, F.col("example")).alias("strict"), vl.fits(tree, c, v, kind).alias("graded")))))
    got = {r.i: r.o for r in df.select("i", out.alias("o")).collect()}
    for i, (html, path, kind_, _, strict, graded, value) in enumerate(SHAPES):
        o = got[i]
        assert (o.strict, o.graded) == (strict, graded), (html, path, kind_, o)
        if value is not None:
            assert (o["items"] if isinstance(value, list) else o.value) == value


def records(spark, pages, selectors):
    df = spark.createDataFrame(pages, "url string, html string, recipe string, item_pattern string")
    rows = spark.createDataFrame(selectors, "recipe string, field_pos int, field string, type string, prio int, selector string")
    got = rc.value_rows(rc.apply_recipes(df, rc.compile_recipes(rows))).collect()
    return {(r.url[-1], r.field): (r.value if r["items"] is None else r["items"]) for r in got}


def test_recipes(spark):
    """Facts by label, fallbacks in order, typed values, text patterns and what finds nothing."""
    pages = [(f"https://ropes.works/r/{n}", "<main>" + facts_block([("Length", f"{n * 100} m"), ("Makers" if n > 1 else "Maker", "; ".join(f"Maker {chr(64 + k)}" for k in range(1, n + 1))), ("Sold", f"0{n} May 1760")], tag, name) + f"<p>Cost: {n} crowns.</p></main>", "r", "/r/")
             for n, (tag, name) in enumerate([("b", "panel"), ("strong", "panel"), ("b", "plate"), ("strong", "plate")], 1)]
    got = records(spark, pages, [
        ("r", 0, "length", "number", 0, "kv:div.panel || Length"), ("r", 0, "length", "number", 1, "kv:div.plate || Length"),
        ("r", 1, "makers", "people", 1, "kv:div.plate || Makers"), ("r", 1, "makers", "people", 0, "kv:div.panel || Makers"),
        ("r", 2, "sold", "date", 0, "kv:div.panel || Sold"), ("r", 3, "cost", "money", 0, r"re:Cost:\s*(\d+) crowns"),
        ("r", 4, "weight", "text", 0, "kv:div.panel || Weight"), ("r", 5, "odd", "text", 0, "kv:div[n=1] || Sold"),
        ("r", 6, "broken", "text", 0, "re:("), ("r", 6, "broken", "text", 1, r"re:Cost: (?P<n>\d+)")])
    for n in range(1, 5):
        assert got[str(n), "length"] == f"{n * 100} m" and got[str(n), "makers"] == [f"Maker {chr(64 + k)}" for k in range(1, n + 1)]
        assert got[str(n), "sold"] == (f"1760-05-0{n}" if n < 3 else None) and got[str(n), "cost"] == str(n)
        assert (got[str(n), "weight"], got[str(n), "odd"], got[str(n), "broken"]) == (None, None, str(n))


def test_recipes_are_joined_alike_without_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = records(spark, [(f"https://lamps.museum/{i}", f"<main><h1>L{i}</h1></main>", "p", "") for i in range(5)],
                      [("p", 0, "t", "text", 0, "main > h1")])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(str(i), "t"): f"L{i}" for i in range(5)}


def test_outline_and_learning(spark):
    html = '<meta name="k" content="v"><body><main><h1>T</h1><div class="facts"><b>A:</b> 1 <b>B:</b> 2</div><div><div><p>hello <b>w</b></p></div></div><table><tr><th>Price</th><td>3</td></tr></table><p>' + "long " * 40 + "</p><span>7</span></main></body>"
    it = items(spark, ("https://x.org/1", html, "")).cache()
    out = ol.outline_rows(it)
    rows = sorted(out.collect(), key=lambda r: r.n)
    assert [(r.kind, r.selector) for r in rows] == [
        ("meta", "meta:k"), ("element", "h1"), ("fact", "kv:div.facts || A"), ("fact", "kv:div.facts || B"),
        ("element", "div > div > p"), ("element", "table > tr"), ("element", "table > tr > th"), ("element", "table > tr > td || Price"), ("element", "p")]
    assert rows[3].line == "fact 'B' = 2" and rows[7].line == "<td> labelled 'Price' 3"
    picks = spark.createDataFrame(
        [(0, "price", "number", 7, 1), (0, "bad", "number", 1, 1), (0, "out", "text", 99, 1)], "page_id long, field string, type string, n long, page_order int")
    assert [(r.field, r.selector) for r in ol.learn_selectors(picks, out, it).collect()] == [("price", "table > tr > td || Price")]


def test_deep_and_broken_pages_do_not_fail(spark):
    got = texts(spark, ("", "<p>x" * 3000, ""), ("", "", ""), ("", "<<<>>> &bogus; </div><a href>", ""))
    assert got[0].count("x") == 3000 and got[1] == ""
    assert tr.LABEL_TAGS[0] == "strong"
