"""Learning runs: resuming from a log, waiting for answers, second opinions."""

from collections import Counter

import pytest

from pagemill.operators import learning as ln

PLAN = [(r, f) for r in ("a", "b", "c") for f in ("name", "size", "note")]
ANSWERS = [("a", "name", "map", 0, "h1"), ("a", "size", "map", 0, "td"), ("a", "note", "map", 0, None), ("b", "name", "map", 0, "bad"), ("b", "size", "map", 0, "half"), ("b", "note", "map", 0, "bad"),
           ("b", "name", "repair", 1, "h1"), ("b", "size", "repair", 1, "td"), ("b", "note", "repair", 1, "bad2"), ("b", "note", "repair", 2, None), ("b", "note", "pattern", 0, "(note"), ("b", "note", "pattern", 1, "(x)")]
RIGHT = {"re:(nothing)": "missed", "h1": "correct", "td": "correct", "re:(x)": "correct", "bad": "wrong", "bad2": "wrong", None: "missed"}


class Teller:
    """Grades four pages per recipe by what the first selector is; counts how often each recipe was graded."""

    def __init__(self, spark):
        self.spark, self.asked, self.again = spark, Counter(), set()

    def __call__(self, trial, kind, round_, again):
        rows, pages = [], None if again is None else {(r.recipe, r.url) for r in again.collect()}
        for r in trial.collect():
            best = max(r.selectors, key=lambda s: RIGHT.get(s) == "correct") if r.selectors else None
            if again is None and r.field == "name":
                self.asked[r.recipe, kind, round_] += 1
            for p in "1234":
                verdict = "absent" if r.recipe == "a" and r.field == "note" else RIGHT.get(best, "missed" if p == "4" else "correct")
                if best == "half" and p != "1":
                    verdict = "missed"
                if pages is None or (r.recipe, p) in pages:
                    rows.append((r.recipe, r.field, p, "correct" if pages is not None and p == "2" else verdict))
        if pages:
            self.again |= pages
        return self.spark.createDataFrame(rows, "recipe string, field string, url string, verdict string")


@pytest.fixture(scope="module")
def plan(spark):
    return spark.createDataFrame(PLAN, "recipe string, field string")


def answers(spark, rows):
    return spark.createDataFrame(rows, "recipe string, field string, kind string, round int, selector string")


def outcome(log):
    return {(r.recipe, r.field): (r.status, r.selectors) for r in ln.settled(log).collect()}


def test_a_run_goes_on_where_its_answers_ended(spark, plan):
    """Whole at once, and in three parts: the same rows, and nothing is graded twice."""
    whole, parts = Teller(spark), Teller(spark)
    want = ln.learn(plan, answers(spark, ANSWERS), whole)
    log = None
    for n in (3, 9, len(ANSWERS)):
        log = ln.learn(plan, answers(spark, ANSWERS[:n]), parts, log)
        cursor = {r.recipe: r.step for r in ln.latest(log).groupBy("recipe").agg({"step": "max"}).withColumnRenamed("max(step)", "step").collect()}
        assert cursor["a"] == ln.SETTLED and "c" not in cursor and ("b" in cursor) == (n > 3)
    assert sorted(map(tuple, log.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert parts.asked == whole.asked and set(parts.asked.values()) == {1}
    assert outcome(log) == {
        ("a", "name"): ("validated", ["h1"]), ("a", "size"): ("validated", ["td"]), ("a", "note"): ("absent", []),
        ("b", "name"): ("validated", ["h1"]),  # gave wrong values: replaced
        ("b", "size"): ("validated", ["half", "td"]),  # was right where it found something: a fallback
        ("b", "note"): ("unreliable", [])}  # its pattern does not compile, so there is no second try
    assert whole.again == {("b", p) for p in "234"}  # pages behind negative verdicts of the one mixed field


def test_second_usable_pattern(spark, plan):
    rows = [r for r in ANSWERS if r[2:4] != ("pattern", 0)] + [("b", "note", "pattern", 0, "(nothing)")]
    assert outcome(ln.learn(plan, answers(spark, rows), Teller(spark)))["b", "note"] == ("validated as text pattern", ["re:(x)"])


def test_known_and_saved_selectors(spark, plan):
    known = spark.createDataFrame([("a", "name", ["old"], "validated")], "recipe string, field string, selectors array<string>, status string")
    seed = spark.createDataFrame([("c", f, ["h1"]) for f in ("name", "size", "note")], "recipe string, field string, selectors array<string>")
    teller = Teller(spark)
    got = outcome(ln.learn(plan, answers(spark, []), teller, known=known, seed=seed))
    assert got == {("a", "name"): ("validated", ["old"]), ("a", "size"): ("unreliable", []), ("a", "note"): ("unreliable", []), **{("c", f): ("validated", ["h1"]) for f in ("name", "size", "note")}}
    assert set(teller.asked) == {("c", "select", 0)}


def test_disagreement_is_uncertain(spark):
    first = spark.createDataFrame([("r", "f", "1", "correct"), ("r", "f", "2", "wrong"), ("r", "f", "3", "missed"), ("r", "g", "2", "wrong")], "recipe string, field string, url string, verdict string")
    pages = ln.disputed_pages(first)
    assert {r.url for r in pages.collect()} == {"2", "3"}
    second = spark.createDataFrame([("r", "f", "2", "correct"), ("r", "f", "3", "missed"), ("r", "g", "2", "correct")], first.schema)
    got = {(r.field, r.url): (r.verdict, r.backed) for r in ln.agreed(first, second).collect()}
    assert got == {("f", "1"): ("correct", False), ("f", "2"): ("uncertain", False), ("f", "3"): ("missed", True), ("g", "2"): ("wrong", True)}
