"""Learning of recipes as a state machine over tables: all sites, and all their fields, advance together.

What models answered comes in as a table, what a grader says through a function. Every step appends its outcome to a
log, one row per field, and works only on the recipes that are due for it and whose answers are there. So a run can stop
anywhere, also for want of answers, and goes on from its log: nothing that is answered is asked for or computed again.

Steps of a recipe: 0 its fields are mapped to selectors; 1, 3, 5 all of them are graded; 2, 4 failing ones are repaired;
6, 7 fields that still fail are tried as text patterns; 8 what is not validated loses its selectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.quality import NEGATIVE, RECHECK_DAYS, VERDICTS, passes
from pagemill.operators.recipes import pattern_groups
from pagemill.session import cut_lineage

KEY = ["recipe", "field"]
ROUNDS, TRIALS, EXAMPLES = 2, 1, 2
SETTLED = 8
LOG = "recipe string, field string, step int, selectors array<string>, status string, wrong bigint, tried boolean"

#: (trial: recipe, field, selectors; kind; round; pages) -> recipe, field, url, verdict on the recipe's sample pages;
#: with pages (recipe, url) a second opinion on these alone
Grader = Callable[[DataFrame, str, int, DataFrame | None], DataFrame]


def tally(verdicts: DataFrame) -> DataFrame:
    """One row per recipe and field with a count per verdict."""
    return verdicts.groupBy(*KEY).agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))


def nothing() -> Column:
    return F.array().cast("array<string>")


def status_of() -> Column:
    """The outcome of a tally."""
    graded = F.col("correct") + F.col("wrong") + F.col("missed")
    return F.when(passes(), "validated").when((F.col("absent") > 0) & (graded == 0), "absent").otherwise("unreliable")


def mixed_fields(verdicts: DataFrame) -> DataFrame:
    """Fields that are right on some pages, and wrong or missed on others."""
    return tally(verdicts).where("correct > 0 AND wrong + missed > 0").select(*KEY)


def disputed_pages(verdicts: DataFrame) -> DataFrame:
    """(recipe, url) of the pages behind the negative verdicts of mixed fields."""
    return verdicts.where(F.col("verdict").isin(*NEGATIVE)).join(mixed_fields(verdicts), KEY, "left_semi").select("recipe", "url").distinct()


def agreed(first: DataFrame, second: DataFrame) -> DataFrame:
    """First verdicts, "uncertain" where the second grading of a disputed page says otherwise on a mixed field.
    ``backed``: a negative verdict that no second grading contradicts; only these are shown as examples of failure."""
    again = second.select(*KEY, "url", F.col("verdict").alias("again"))
    rows = first.join(mixed_fields(first).withColumn("mixed", F.lit(True)), KEY, "left").join(again, [*KEY, "url"], "left")
    differs = F.coalesce(F.col("mixed") & (F.col("again") != F.col("verdict")), F.lit(False))
    return rows.select(*KEY, "url", F.when(differs, "uncertain").otherwise(F.col("verdict")).alias("verdict"), (F.col("verdict").isin(*NEGATIVE) & ~differs).alias("backed"))


def latest(log: DataFrame) -> DataFrame:
    """The newest row of every recipe and field."""
    rest = [c for c in log.columns if c not in (*KEY, "step")]
    return log.groupBy(*KEY).agg(F.max("step").alias("step"), F.max_by(F.struct(*rest), "step").alias("now")).select(*KEY, "step", "now.*")


def _at(now: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """The rows of the recipes that have come as far as one of ``steps``, with what is open in the recipe."""
    cursor = now.groupBy("recipe").agg(
        F.max("step").alias("at"), F.max((F.col("status") == "unreliable").cast("int")).alias("fails"), F.max(F.col("tried").cast("int")).alias("trial"))
    return now.join(cursor.where(F.col("at").isin(*steps)), "recipe")


def _answered(rows: DataFrame, answers: DataFrame, kind: str, round_: int) -> DataFrame:
    """``rows`` of the recipes with an answer of this kind and round, with the answered ``selector`` (null: none)."""
    own = answers.where((F.col("kind") == kind) & (F.col("round") == round_))
    told = own.groupBy(*KEY).agg(F.max("selector").alias("selector"))
    return rows.join(own.select("recipe").distinct(), "recipe", "left_semi").join(told, KEY, "left")


def _logged(rows: DataFrame, step: int, selectors: Column, status: Column, wrong: Column | None = None, tried: Column | None = None) -> DataFrame:
    none, no = F.lit(0).cast("bigint"), F.lit(False)
    return rows.select(*KEY, F.lit(step).alias("step"), selectors.alias("selectors"), status.alias("status"),
                       F.coalesce(none if wrong is None else wrong, none).alias("wrong"), F.coalesce(no if tried is None else tried, no).alias("tried"))


def map_fields(fields: DataFrame, log: DataFrame, answers: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Step 0: a saved selector where there is one, else the answered one. A recipe whose fields are all saved needs none."""
    new = fields.select(*KEY).distinct().join(log.select("recipe").distinct(), "recipe", "left_anti")
    saved = new.withColumn("saved", F.lit(None).cast("array<string>")) if seed is None else new.join(seed.select(*KEY, F.col("selectors").alias("saved")), KEY, "left")
    whole = saved.groupBy("recipe").agg(F.min(F.col("saved").isNotNull()).alias("whole")).where("whole").select("recipe")
    ready = whole.union(answers.where("kind = 'map' AND round = 0").select("recipe")).distinct()
    own = answers.where("kind = 'map' AND round = 0").groupBy(*KEY).agg(F.max("selector").alias("selector"))
    rows = saved.join(ready, "recipe", "left_semi").join(own, KEY, "left")
    answered = F.when(F.col("selector").isNotNull(), F.array("selector")).otherwise(nothing())
    return _logged(rows, 0, F.coalesce("saved", answered), F.lit("mapped"))


def grade_fields(log: DataFrame, grade: Grader, round_: int) -> DataFrame:
    """Step 2 round + 1: every field of the recipes that were mapped or repaired; absent ones lose their selectors."""
    rows = _at(latest(log), (2 * round_,))
    trial = rows.select(*KEY, "selectors")
    first = cut_lineage(grade(trial, "select", round_, None))
    verdicts = agreed(first, grade(trial, "select", round_, disputed_pages(first)))
    graded = rows.drop("status", "wrong").join(tally(verdicts).withColumn("status", status_of()), KEY)
    return _logged(graded, 2 * round_ + 1, F.when(F.col("status") == "absent", nothing()).otherwise(F.col("selectors")), F.col("status"), F.col("wrong"))


def repair_fields(log: DataFrame, answers: DataFrame, round_: int) -> DataFrame:
    """Step 2 round: in recipes with failing fields a selector that gave wrong values is replaced by the answered one,
    one that was right but missed pages gets it as a fallback."""
    rows = _answered(_at(latest(log), (2 * round_ - 1,)).where("fails = 1"), answers, "repair", round_)
    before = F.col("selectors")
    mended = F.when((F.col("wrong") > 0) | (F.size(before) == 0), F.array("selector")).otherwise(F.array_distinct(F.concat(before, F.array("selector"))))
    changes = (F.col("status") == "unreliable") & F.col("selector").isNotNull()
    return _logged(rows, 2 * round_, F.when(changes, mended).otherwise(before), F.col("status"), F.col("wrong"))


def try_patterns(log: DataFrame, answers: DataFrame, grade: Grader, trial: int) -> DataFrame:
    """Step 6 + trial: fields that failed as elements, as text patterns. A pattern must compile and capture something;
    the whole recipe is graded with it, and it stays only if its field passes. Without any usable pattern no other try."""
    last = 2 * ROUNDS + 1
    rows = _at(latest(log), (last,) if not trial else (last + trial,)).where("fails = 1" if not trial else "fails = 1 AND trial = 1")
    rows = _answered(rows, answers, "pattern", trial)
    pattern = F.when(F.col("status") == "unreliable", F.col("selector"))
    rows = cut_lineage(rows.drop("tried").withColumn("pattern", F.when(pattern_groups(pattern) >= 1, F.concat(F.lit("re:"), pattern))))
    tried = F.when(F.col("pattern").isNotNull(), F.array("pattern"))
    graded = tally(grade(rows.select(*KEY, F.coalesce(tried, F.col("selectors")).alias("selectors")), "pattern", trial, None)).select(*KEY, passes().alias("good"))
    rows = rows.join(graded, KEY, "left")
    good = F.col("pattern").isNotNull() & F.coalesce("good", F.lit(False))
    return _logged(rows, 6 + trial, F.when(good, tried).otherwise(F.col("selectors")), F.when(good, "validated as text pattern").otherwise(F.col("status")), F.col("wrong"), F.col("pattern").isNotNull())


def settle(log: DataFrame) -> DataFrame:
    """Step 8 of the recipes with nothing left to try: a blank instead of a wrong value."""
    last = 2 * ROUNDS + 1
    rows = _at(latest(log), tuple(range(1, SETTLED, 1)))
    waits = ((F.col("at") % 2 == 0) & (F.col("at") < last)) | ((F.col("fails") == 1) & ((F.col("at") <= last) | ((F.col("at") < last + 1 + TRIALS) & (F.col("trial") == 1))))
    done = rows.where(~waits)
    return _logged(done, SETTLED, F.when(F.col("status").startswith("validated"), F.col("selectors")).otherwise(nothing()), F.col("status"), F.col("wrong"))


def learn(fields: DataFrame, answers: DataFrame, grade: Grader, log: DataFrame | None = None, known: DataFrame | None = None, seed: DataFrame | None = None) -> DataFrame:
    """The log of a run as far as the answers reach, from an earlier ``log`` on.

    ``fields(recipe, field)``; ``answers(recipe, field, kind, round, selector)`` with kind map, repair or pattern;
    ``known(recipe, field, selectors, status)``: recipes taken as they are, without any answer or grade;
    ``seed(recipe, field, selectors)``: saved selectors that are graded first, so that only fields without one are mapped.
    Only fields of the plan are logged; an empty plan gives an empty log."""
    spark = fields.sparkSession
    log = spark.createDataFrame([], LOG) if log is None else log.select(*[c.split()[0] for c in LOG.split(", ")])
    if known is not None:
        new = known.join(log.select("recipe").distinct(), "recipe", "left_anti")
        kept = fields.select(*KEY).distinct().join(new.select("recipe").distinct(), "recipe", "left_semi").join(new, KEY, "left")
        log = cut_lineage(log.unionByName(_logged(kept, SETTLED, F.coalesce("selectors", nothing()), F.coalesce("status", F.lit("unreliable")))))
    steps = [lambda at: map_fields(fields, at, answers, seed), lambda at: grade_fields(at, grade, 0)]
    for r in range(1, ROUNDS + 1):
        steps += [lambda at, r=r: repair_fields(at, answers, r), lambda at, r=r: grade_fields(at, grade, r)]
    steps += [lambda at, t=t: try_patterns(at, answers, grade, t) for t in range(TRIALS + 1)]
    for step in [*steps, settle]:
        log = cut_lineage(log.unionByName(step(log)))
    return log


def settled(log: DataFrame) -> DataFrame:
    """(recipe, field, selectors, status) of the recipes that are through."""
    return log.where(F.col("step") == SETTLED).select(*KEY, "selectors", "status")


def cover(fields: DataFrame, counts: DataFrame, answers: DataFrame, grade: Grader, checked: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """Further forms of validated fields that come out empty on a fifth of their pages or more.

    ``fields(recipe, field, selectors, status)`` are settled ones, ``counts(recipe, field, empty, total)`` from applying
    them, ``checked(recipe, field, checked_on)`` what was looked at before; checks of the last thirty days aren't repeated.
    An answered selector (kind "coverage") becomes a fallback if the probe pages grade right at least once and never
    wrong. Returns the fields and the checks, those of today among them."""
    gaps = fields.where(F.size("selectors") > 0).join(counts, KEY).where(5 * F.col("empty") >= F.col("total"))
    recent = F.coalesce(F.datediff(today, "checked_on") < RECHECK_DAYS, F.lit(False))
    due = gaps.join(checked, KEY, "left").where(~recent).select(*KEY, "selectors")
    told = answers.where("kind = 'coverage'").groupBy(*KEY).agg(F.max("selector").alias("selector"))
    trial = due.join(told, KEY).where(F.col("selector").isNotNull() & ~F.array_contains("selectors", F.col("selector")))
    trial = cut_lineage(trial.select(*KEY, F.concat("selectors", F.array("selector")).alias("longer")))
    right = tally(grade(trial.select(*KEY, F.col("longer").alias("selectors")), "coverage", 0, None)).where("correct > 0 AND wrong = 0").select(*KEY)
    accepted = trial.join(right, KEY, "left_semi")
    after = fields.join(accepted, KEY, "left").select(*KEY, F.coalesce("longer", "selectors").alias("selectors"), "status")
    looked = due.select(*KEY, today.alias("checked_on"))
    return after, checked.join(looked, KEY, "left_anti").select(*KEY, "checked_on").unionByName(looked)
