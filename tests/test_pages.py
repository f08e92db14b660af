from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.operators import facts as fc
from pagemill.operators import links as lk
from pagemill.operators import listing as ls



def anchors(links, wrap="{}"):
    """(href, text) pairs as markup, each in a wrapping element."""
    return "".join(wrap.format(f'<a href="{href}">{text}</a>') for href, text in links)


def group(folder, n, said="Yearly account number {} of the rope works", slug="account-of-year-{}/"):
    """n links of one group below a folder."""
    return [(folder + slug.format(1700 + k), said.format(1700 + k)) for k in range(n)]


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


@pytest.mark.parametrize("n", [1, 6, 23])
def test_kids_are_the_biggest_group_of_titled_links(spark, n):
    """Whatever stands around them: links with short texts don't count, however many, and a page without any has none."""
    below, beside = group("/ledger/", n), group("/workers/", 4, said="Rope maker {}", slug="hand-{}")
    df = lk.parse_pages(pages(
        spark, ("https://ropes.works/ledger/", anchors(beside) + "<ol>" + anchors(below, "<li>{}</li>") + "</ol>"),
        ("https://ropes.works/workers/", anchors(beside)), ("https://ropes.works" + below[0][0], anchors(beside))))
    assert [r.kids for r in sorted(df.collect(), key=lambda r: r.page_id)] == [n, 0, 0]


@pytest.mark.parametrize(("dated", "other"), [(5, 3), (9, 20), (30, 2)])
def test_biggest_group_of_titled_links(spark, dated, other):
    """Links with a title of over 20 characters count; short ones don't, however many there are."""
    days = [(f"/{1850 + k % 2}/{1 + k % 12:02}/launch-of-the-ship-{k}", f"How ship number {k} left the yard") for k in range(dated)]
    short = [(f"/sort/by_mast/{k}/rows", f"Masts: {k}") for k in range(40)]
    long = group("/sort/by_rope/", other, said="Ropes of kind {}, all lengths", slug="{}/rows")
    r = lk.parse_pages(pages(spark, ("https://ropes.works/yard/", anchors(short) + anchors(long, "<p>{}</p>") + anchors(days, "<div>{}</div>")))).first()
    assert (r.item_gpath, r.item_count) == ("/*/*/", dated)  # only these look like items
    assert r.gpath == ("/*/*/" if dated > other else r.gpath) and r.gpath != "/sort/by_mast/*/"


def test_pagers_count_outside_the_chrome(spark):
    controls = ['<link rel="up next" href="/yard/b/">', '<div class="list pager-small">2</div>', '<p class="pagination">2</p>']
    rows = [("https://ropes.works/yard/", c) for c in controls] + [("https://ropes.works/yard/", f"<nav>{c}</nav>") for c in controls[1:]]
    got = {r.page_id: r.paged for r in lk.parse_pages(pages(spark, *rows)).collect()}
    assert [got[i] for i in range(5)] == [True, True, True, False, False]


def test_documents_and_headings(spark):
    html = "<h1>The <i>long</i>\n walk</h1>" + "<a href='plan.pdf'>Plan</a>" * 3 + "<a href='plan.docx'>Text</a>" + "".join(f"<h{2 + k % 2}>part {k}</h{2 + k % 2}>" for k in range(15))
    r = lk.parse_pages(pages(spark, ("https://ropes.works/walk", html))).first()
    assert (r.h1, r.pdfs, r.heads) == ("The long walk", 3, [f"part {k}" for k in range(12)])


def test_link_texts(spark):
    html = ('<a href="/x/">ab</a><a href="/x/?q=1">cd</a><a href="/x/#f">a</a><a href="/i/" aria-label="Icon"><img></a>'
            '<a href="/t/" title=" Long  title "></a><a href="https://other.com/">o</a><a href="/me">self</a><a href="/f.docx">doc</a>'
            '<a href="mailto:a@b">m</a>')
    rows = lk.page_links(lk.parse_pages(pages(spark, ("https://ex.org/me", html)))).orderBy("pos").collect()
    # the longest text wins, the later one on ties
    assert [(r.dst, r.text) for r in rows] == [("https://ex.org/x/", "cd"), ("https://ex.org/i/", "Icon"), ("https://ex.org/t/", "Long title")]


def test_tolerant_markup(spark):
    html = '<title>A &amp; B</title><p>one<p>two <b>three</p></i></div><script>var x="</p>";</script><h1>H<br>x</h1><br/>tail'
    r = lk.parse_pages(pages(spark, ("https://ex.org/", html))).first()
    assert (r.title, r.h1, r.text_len) == ("A & B", "H x", len("A & B one two three H x tail"))


def test_paging_controls(spark):
    here = "https://ropes.works/yard/"
    says = [f"{verb} more" for verb in ("Load", "SHOW", "view")] + ["Older posts", "→"]
    pager = anchors([(f"?sheet={k}", str(k + 1)) for k in (0, 1, 2, 40)])
    cases = [(here, pager), (here, '<link rel="first next" href="/yard/sheets/2">'), *[(here, anchors([("?from=50", t)])) for t in says],
             (here, anchors([("/visit/", "Visit us"), ("/hemp/", "")])), (here, "<p>a single sheet</p>")]
    df = ls.listing_pages(pages(spark, *cases))
    following = ls.next_url(F.col("pager"), F.lit(1))
    got = Counter((r.n or "", r.c) for r in df.select(following.alias("n"), ls.page_count(F.col("pager"), following).alias("c")).collect())
    assert got[here + "?sheet=1", 41] == 1  # counted from 0, ?sheet=40 is the 41st
    assert sum(c for (n, _), c in got.items() if n == here + "?from=50") == len(says)
    assert sum(c for (n, _), c in got.items() if n.endswith("/sheets/2")) == 1 and got["", None] == 2


def test_facts_by_preference(spark):
    """Every source of a fact alone, then each pair of sources: the one named first wins."""
    title = [('<meta name="citation_title" content="{}">', 0), ('<meta name="dc.title" content="{}">', 1), ('<script type="application/ld+json">{{"@type": "Article", "headline": "{}"}}</script>', 2),
             ('<meta property="og:title" content="{}">', 3), ("<h1>{}</h1>", 4), ("<title>{}</title>", 5)]
    pairs = [(x, y) for x in title for y in title]
    rows = [("https://ropes.works/p", y[0].format(f"title {y[1]}") + x[0].format(f"title {x[1]}")) for x, y in pairs]
    got = {r.page_id: r.title for r in fc.publication_facts(pages(spark, *rows)).collect()}
    assert got == {i: f"title {min(x[1], y[1])}" for i, (x, y) in enumerate(pairs)}


def test_facts_of_people_topics_and_files(spark):
    many = "".join(f'<meta name="citation_author" content="Maker {chr(65 + k)}, Rope">' for k in range(15))
    tags = "".join(f'<meta property="article:tag" content="{t}">' for t in ("hemp", " tar ", "hemp"))
    links = anchors([("/d/first.pdf", "Drawing"), ("/d/second.pdf", "Drawing"), ("https://doi.org/10.5555/rope.walk-3", "cite")])
    other = '<time datetime="1766-05-04T10:00">in spring</time><div class="author">' + anchors([("/a", "Read more"), ("/b", "Hanna Tau"), ("/c", "+5 others")]) + "</div>"
    a, b = sorted(fc.publication_facts(pages(spark, ("https://ropes.works/x", many + tags + links), ("https://ropes.works/y", other))).collect(), key=lambda r: r.page_id)
    assert a.authors == [f"Maker {chr(65 + k)}, Rope" for k in range(12)] and a.topics == ["hemp", "tar"]
    assert (a.pdf, a.doi) == ("https://ropes.works/d/first.pdf", "10.5555/rope.walk-3")
    assert (b.date, b.authors) == ("1766-05-04", ["Hanna Tau"])


def test_walk_load_more_and_view_all(spark):
    def entries(a, b):
        return "".join(f'<a href="/p/some-item-no-{i}">A sufficiently long title {i}</a>' for i in range(a, b))

    archive = ls.listing_pages(pages(
        spark, ("https://a.org/", "<main>" + entries(0, 5) + "</main>"),
        ("https://b.org/", '<main><a href="/more/">View all reports</a></main>'),
        ("https://b.org/more/", '<main><a href="/archive/">Full archive</a></main>'),
        ("https://b.org/archive/", "<main>" + entries(0, 5) + '<a href="?page=2">Next</a></main>'),
        ("https://b.org/archive/?page=2", "<main>" + entries(3, 9) + '<a href="?page=3">Next</a></main>'),
        ("https://b.org/archive/?page=3", "<main>" + entries(3, 9) + '<a href="?page=4">Next</a></main>')))
    grown = ls.listing_pages(pages(spark, ("https://a.org/", "<main>" + entries(0, 8) + "</main>")))
    hubs = spark.createDataFrame([("a", "https://a.org/", 40), ("b", "https://b.org/", 7)], "listing_id string, hub string, max_items int")
    items, info = ls.walk_listings(hubs, archive, grown)
    got = {r.listing_id: r for r in info.collect()}
    assert (got["a"].mode, got["b"].mode) == ("load-more", "view-all -> view-all -> next-link")
    assert got["b"].landing == "https://b.org/" and got["b"].list == "https://b.org/archive/" and got["b"].pages_fetched == 2
    listed = sorted((r.listing_id, r.list_pos, r.url[-2:]) for r in items.collect())
    assert [x for x in listed if x[0] == "a"] == [("a", i + 1, f"-{i}") for i in range(8)]
    assert [x for x in listed if x[0] == "b"] == [("b", i + 1, f"-{i}") for i in range(7)]  # the cap cuts page 2


def test_long_chains_cycles_and_links_written_loosely(spark):
    """Seven landing pages before the list, landing pages that point at each other, next links with fragments, line
    breaks in links and hosts in capitals."""
    def entries(a, b):
        return "".join(f'<a href="\n  /o/lamp-with-number-{i}\t">A lamp with a long title, number {i}</a>' for i in range(a, b))

    chain = [(f"https://chain.org/{k}/", f'<main><a href="\n/{k + 1}/\n">View all lamps</a></main>') for k in range(7)]
    ring = [(f"https://ring.org/{k}/", f'<main><a href="/{(k + 1) % 3}/">View all lamps</a></main>') for k in range(3)]
    archive = ls.listing_pages(pages(
        spark, *chain, *ring, ("https://chain.org/7/", "<main>" + entries(0, 6) + '<a href="?from=2#results">Next</a></main>'),
        ("https://CHAIN.org/7/?from=2", "<main>" + entries(6, 12) + "</main>")))
    hubs = spark.createDataFrame([("c", "https://Chain.org/0/#top", 40), ("r", "https://ring.org/0/", 40)], "listing_id string, hub string, max_items int")
    items, info = ls.walk_listings(hubs, archive)
    got = {r.listing_id: r for r in info.collect()}
    assert got["c"].mode == "view-all -> " * 7 + "next-link" and got["c"].pages_fetched == 2 and got["c"].list == "https://chain.org/7/"
    assert got["r"].mode == "view-all -> view-all -> single-page"
    assert [r.url for r in items.where("listing_id = 'c'").orderBy("list_pos").collect()] == [f"https://chain.org/o/lamp-with-number-{i}" for i in range(12)]
