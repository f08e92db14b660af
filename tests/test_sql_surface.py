"""SQL functions against the column functions they repeat, and the table function against the page trees."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions import urls
from pagemill.operators.dom import with_dom
from pagemill.plans.sql_surface import register_functions

COLUMN_FORMS = {
    "url_normalised": urls.normalise, "url_site": urls.site, "url_folder": urls.folder_pattern, "url_section": urls.first_section,
    "url_reads_like_item": urls.looks_like_slug, "text_slug": urls.slug, "text_clean": tx.clean, "text_iso_date": tx.to_iso, "label_key": tx.label_key,
}
ODD = ["", None, " ", "/", "//", "HTTPS://Sub.Example.CO.uk:80/A/2024/x-y-z/?q=1#f", "http://localhost", "mailto:a@b", "http://a.de", "a/b/12/c", "?q", "#f",
       "https://x.org//a//", "13 May 2026", "May 3rd, 2026", "2026-05-13T10:00", "2026/05/13", "3 Foo 2026", "Authors: ", "Topics", "a  b\n c", "Ünï côdé", "http://h.com.au/1/٣/2",
       "x" * 5000, "https://a.b/2019-report", "https://a.b/one-two-three/", "s"]


def compared(spark, values):
    register_functions(spark)
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    pairs = [F.struct(F.expr(f"{name}(v)").alias("sql"), form(F.col("v")).alias("col")).alias(name) for name, form in COLUMN_FORMS.items()]
    for row in rows.select("v", *pairs).collect():
        for name in COLUMN_FORMS:
            assert row[name]["sql"] == row[name]["col"], (name, row.v)


def test_scalars_equal_their_column_forms(spark):
    compared(spark, ODD)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZ09/:.?#-_  \nßé&=%,[]Mayun", max_size=40), min_size=30, max_size=60))
def test_scalars_on_generated_texts(spark, values):
    compared(spark, values)


def test_scalars_are_no_python(spark):
    register_functions(spark)
    plan = spark.sql("SELECT url_site(v) AS s, text_iso_date(v) AS d FROM VALUES ('http://a.org/x') t(v)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("clause", ["", " PARTITION BY url"])
def test_elements_equal_the_trees(spark, clause):
    register_functions(spark)
    pages = spark.createDataFrame(
        [(1, "u1", "<main id=m><h1>A  b</h1>c<!-- no --><p class='x y'>d<br>e</p> f</main>", "extra"), (2, "u2", "", None), (3, "u3", None, "x"), (4, None, "<p>", "x")],
        "page_id int, url string, html string, tag string")
    pages.createOrReplaceTempView("some_pages")
    got = spark.sql(f"SELECT url, pre, parent, last, tag, attrs, own_text FROM page_elements(TABLE(some_pages){clause})").collect()
    trees = with_dom(pages).select("url", F.explode("dom.nodes").alias("n")).select("url", "n.pre", "n.parent", "n.last", "n.tag", "n.attrs").collect()
    key = lambda r: (r.url or "", r.pre)
    assert [(r.url, r.pre, r.parent, r.last, r.tag, r.attrs) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(trees, key=key)]
    texts = {(r.url, r.tag): r.own_text for r in got}
    assert texts["u1", "main"] == "c f" and texts["u1", "p"] == "de" and texts["u1", "h1"] == "A b" and texts["u2", "[document]"] == ""


def test_elements_without_a_shuffle(spark):
    register_functions(spark)
    spark.createDataFrame([("u", "<p>")], "url string, html string").createOrReplaceTempView("some_pages")
    plan = spark.sql("SELECT tag FROM page_elements(TABLE(some_pages))")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert spark.sql("SELECT * FROM page_elements(TABLE(SELECT * FROM some_pages WHERE url = 'none'))").count() == 0
