from urllib.parse import urljoin, urlsplit, urlunsplit

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions import urls


def column(spark, values, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", expression(F.col("v")).alias("x"))
    return [r["x"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_normalise_and_site(spark):
    assert column(spark, ["https://EX.org/en/publications?page=2#x", "HTTPS://a.B"], urls.normalise) == [
        "https://ex.org/en/publications", "https://a.b/"]
    hosts = ["https://www2.fundsforngos.org/x", "https://www.fundsforngos.org/", "https://catalog.data.gov/dataset",
             "https://data.gov", "https://www.gov.uk/search", "https://www.bbc.co.uk/news", "https://bbc.co.uk", "http://h:8080/"]
    assert column(spark, hosts, urls.site) == [
        "fundsforngos.org", "fundsforngos.org", "data.gov", "data.gov", "www.gov.uk", "bbc.co.uk", "bbc.co.uk", "h"]


def test_folders(spark):
    paths = ["/2025/12/some-paper", "/2026/01/other/", "/", "/a", "/a/b/"]
    assert column(spark, paths, urls.folder_pattern) == ["/*/*/", "/*/*/", "/", "/", "/a/"]
    assert column(spark, ["https://x.org/tag/a/b", "https://x.org"], urls.first_section) == ["/tag/", ""]
    slugs = ["https://x.org/a-long-one", "https://x.org/a-b", "https://x.org/p/12345/", "https://x.org/p/123"]
    assert column(spark, slugs, urls.looks_like_slug) == [True, False, True, False]


def test_resolve_like_the_standard_library(spark):
    bases = ["https://ex.org/a/b/c", "https://ex.org/a/b/", "https://ex.org", "https://ex.org/a?x=1#f", "http://EX.org/a/../b/x.html"]
    hrefs = ["", "#", "#t", "?p=2", "x", "x/y", "./x", "../x", "../../../x", "/x", "/a/../b", "/a/./b/..", "//h.org/z",
             "https://z.org", "mailto:a@b", "javascript:void(0)", "x//y", "..", ".", "a/..", "/", "x?y=1#z", "a:b"]
    pairs = [(b, h) for b in bases for h in hrefs]
    rows = spark.createDataFrame(pairs, "b string, h string").select("b", "h", urls.resolve(F.col("b"), F.col("h")).alias("u")).collect()
    assert {(r.b, r.h): r.u for r in rows} == {(b, h): urljoin(b, h) for b, h in pairs}


def test_page_candidates(spark):
    rows = spark.createDataFrame([("https://ex.org/r/?q=a&p=9",)], "u string").select(
        F.inline(urls.page_candidates(F.col("u"), F.lit(2)))).collect()
    assert [(r["shape"], r["offset"], r["url"]) for r in rows] == [
        ("?page={}", 0, "https://ex.org/r/?q=a&p=9&page=2"), ("?page={}", -1, "https://ex.org/r/?q=a&p=9&page=1"),
        ("?paged={}", 0, "https://ex.org/r/?q=a&p=9&paged=2"), ("?p={}", 0, "https://ex.org/r/?q=a&p=2"),
        ("?pg={}", 0, "https://ex.org/r/?q=a&p=9&pg=2"), ("/page/{}/", 0, "https://ex.org/r/page/2/?q=a&p=9")]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.from_regex(r"https?://[A-Za-z0-9.]{1,20}(/[A-Za-z0-9._~-]{0,8}){0,4}(\?[a-z=&]{0,8})?(#[a-z]{0,4})?", fullmatch=True), min_size=40, max_size=40))
def test_normalise_is_idempotent_and_keeps_the_site(spark, many):
    once = column(spark, many, urls.normalise)
    assert column(spark, once, urls.normalise) == once
    assert column(spark, once, urls.site) == column(spark, many, urls.site)
    for raw, got in zip(many, once, strict=True):
        s = urlsplit(raw)
        assert got == urlunsplit((s.scheme.lower(), s.netloc.lower(), s.path or "/", "", ""))


def test_dates(spark):
    texts = ["17 September 2026", "Sep 17, 2026", "2026/09/17", "2026-09-17T10:00", "28-Jul-2026", "17th Sep. 2026",
             "Open - no closing date", "12 Foo 2026 then May 3rd, 2026", "x" * 60]
    got = column(spark, texts, tx.to_iso)
    assert got == ["2026-09-17"] * 4 + ["2026-07-28", "2026-09-17", "Open - no closing date", "2026-05-03", "x" * 40]
    iso = got[:6]
    assert column(spark, iso, tx.to_iso) == iso


def test_labels_and_names(spark):
    labels = ["Next", "Next ›", "Next page →", "»", "Load more", "", "About", "Next up"]
    assert column(spark, labels, tx.is_next_label) == [True] * 5 + [False] * 3
    assert column(spark, ["Inventors:", "Inventor", " inventors : "], tx.label_key) == ["inventor"] * 3
    people = column(spark, ["Qiang Zhu (Sunnyvale, CA), John Chao (Foster City, CA)", "a; b"], tx.split_people)
    assert people == [["Qiang Zhu (Sunnyvale, CA)", "John Chao (Foster City, CA)"], ["a", "b"]]
    assert column(spark, ["a  b\n c "], tx.clean) == ["a b c"]
    totals = ["286 results 53038 results found", "1-20 of 369 results, 400 items", "12 items and 7 reports", "none", "1,234 publications"]
    assert column(spark, totals, tx.result_total) == [53038, 369, 12, None, 1234]


def test_answers(spark):
    texts = ['<think>[1]</think> ok ```json\n{"a": [1]}\n```', "no", "{broken"]
    assert column(spark, texts, tx.first_json) == ['{"a": [1]}', None, None]
