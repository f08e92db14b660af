import datetime

from pyspark.sql import functions as F

from pagemill.operators import graph as gr
from pagemill.operators import ledger
from pagemill.operators import quality as ql
from pagemill.operators import scoring as sc


def test_field_status(spark):
    cases = [("a", 3, 1, 0, 0, 0), ("b", 2, 2, 0, 0, 0), ("c", 1, 0, 0, 3, 0), ("d", 2, 0, 2, 0, 0), ("e", 2, 0, 0, 0, 2), ("f", 0, 0, 0, 4, 0)]
    tally = spark.createDataFrame(cases, "field string, correct long, wrong long, missed long, absent long, uncertain long")
    got = {r.field: r.status for r in ql.field_status(tally).collect()}
    assert got == {"a": "validated", "b": "unreliable", "c": "validated", "d": "unreliable", "e": "validated", "f": "absent"}


def test_never_validated_without_a_correct_verdict(spark):
    grid = [(f"{w}{m}{a}", 0, w, m, a, 0) for w in range(4) for m in range(4) for a in range(4)]
    tally = spark.createDataFrame(grid, "field string, correct long, wrong long, missed long, absent long, uncertain long")
    assert ql.field_status(tally).where("status = 'validated'").count() == 0


def test_second_opinion(spark):
    first = spark.createDataFrame([("a", "f", "correct"), ("b", "f", "correct"), ("c", "f", "wrong"), ("d", "f", "correct")], "url string, field string, verdict string")
    agree = spark.createDataFrame([("c", "f", "wrong")], first.schema)
    differ = spark.createDataFrame([("c", "f", "correct")], first.schema)
    assert [r.url for r in ql.pages_to_regrade(first).collect()] == ["c"]
    assert sorted(ql.second_opinion(first, first).collect()) == sorted(first.select("url", "field", "verdict").collect())
    assert ql.verdict_tally(ql.second_opinion(first, agree)).first().wrong == 1
    r = ql.verdict_tally(ql.second_opinion(first, differ)).first()
    assert (r.correct, r.wrong, r.uncertain) == (3, 0, 1)


def test_usage_cost(spark):
    calls = spark.createDataFrame([("plan", 517, 1606), ("extract", 100_000, 20_000), ("extract", None, None)], "stage string, tokens_in long, tokens_out long")
    got = {r.stage: (r.calls, r.usd) for r in ledger.usage_cost(calls).collect()}
    assert got == {"plan": (1, 0.0021), "extract": (2, 0.054), "total": (3, 0.0561)}
    assert all(r.usd == 0 for r in ledger.usage_cost(calls, 0, 0).collect())


def test_coverage_counts_exactly_a_fifth(spark):
    rows = [("f", f"u{i}", i, None if i < 1 else "x", None) for i in range(5)] + [("g", f"u{i}", i, None if i < 1 else "x", None) for i in range(6)]
    values = spark.createDataFrame(rows, "field string, url string, list_pos int, value string, items array<string>")
    gaps = ql.coverage_gaps(values)
    assert [r.field for r in gaps.collect()] == ["f"]
    checked = spark.createDataFrame([("f", datetime.date(2026, 1, 10))], "field string, checked_on date")
    assert ql.due_for_check(gaps, checked, F.lit("2026-02-08").cast("date")).count() == 0
    assert ql.due_for_check(gaps, checked, F.lit("2026-02-09").cast("date")).count() == 1


def test_count_under_against_brute_force(spark):
    known = [f"https://s{i % 3}.org/{'en/' * (i % 4)}p{i % 17}/{i}" for i in range(300)] + ["https://s0.org/", "https://s0.org/en/"]
    probes = ["https://s0.org/", "https://s0.org/en/", "https://s0.org/en/p1", "https://s1.org/p", "https://none.org/", known[5], "https://s2.org"]
    got = {r.url: r.under for r in gr.count_under(
        spark.createDataFrame([(u,) for u in probes], "url string"),
        spark.createDataFrame([(u,) for u in set(known)], "url string").repartition(7)).collect()}
    assert got == {p: sum(k.startswith(p) and k != p for k in set(known)) for p in probes}


def test_scores_of_published_reports(spark):
    # hub, listed items, pager seen, share of pages linking there, published score
    rows = [(0.9999, 20, False, 0.967, 0.9867), (0.6767, 23, False, 0.967, 0.6678), (0.6074, 20, False, 0.967, 0.5994)]
    df = spark.createDataFrame(rows, "hub double, items int, paged boolean, linked double, published double")
    score = gr.prominent_score(F.round(gr.page_score(F.col("hub"), F.col("items"), F.col("paged")), 4), F.col("linked"))
    assert all(abs(r.s - r.published) < 2e-4 for r in df.select(score.alias("s"), "published").collect())


def test_assignment_and_guesses(spark):
    claims = spark.createDataFrame(
        [(1, "title", "text", 1, "Same text", None, 0.9), (1, "name", "text", 1, "same  TEXT", None, 0.8), (1, "name", "text", 2, "Other", None, 0.6),
         (1, "date", "date", 1, "2026-01-01", None, 0.7), (1, "updated", "date", 1, "2026-01-01", None, 0.65)],
        "page_id int, field string, type string, rn int, value string, items array<string>, p double")
    won = sc.assign(claims)
    assert {r.field: r.value for r in won.collect()} == {"title": "Same text", "name": "Other", "date": "2026-01-01", "updated": "2026-01-01"}
    values = spark.createDataFrame([(1, "title", "Kept", None, "selector"), (1, "name", None, None, ""), (1, "updated", None, None, "")],
                                   "page_id int, field string, value string, items array<string>, how string")
    got = {r.field: (r.value, r.how) for r in sc.with_guesses(values, won).collect()}
    assert got == {"title": ("Kept", "selector"), "name": ("Other", "guess"), "updated": ("2026-01-01", "guess")}


def test_batch_scorer(spark):
    def lengths(batches):
        for states in batches:
            yield states.str.len() / 100.0

    df = spark.createDataFrame([("ab",), ("abcd",)], "state string")
    assert sorted(r.p for r in df.select(sc.scorer(lengths)(F.col("state")).alias("p")).collect()) == [0.02, 0.04]
