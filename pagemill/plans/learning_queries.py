"""Learning runs over the rendered part pages: a recipe per brand. The answers of the model are fixed per field; the
grader is the table itself, which knows what every page shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators import learning as ln
from pagemill.operators import quality as ql
from pagemill.operators import recipes as rc
from pagemill.plans import rendered as rd
from pagemill.plans.catalog import query, table
from pagemill.session import cut_lineage

KNOWN_BRAND, TODAY = "Brand#55", "2026-02-15"
TYPES = {"title": "text", "brand": "text", "kind": "text", "price": "money", "sheet": "url", "colour": "text"}
#: field, kind of answer, round, selector (None: the model found nothing). Pages come in two layouts, even and odd keys.
ANSWERS = [
    ("title", "map", 0, "article > h1.title"), ("title", "repair", 1, "ld:name"), ("title", "coverage", 0, "ld:name"),
    ("kind", "map", 0, "kv:div.facts || Brand"), ("kind", "repair", 1, "kv:div.facts || Type"), ("kind", "repair", 2, "kv:div.facts || Kind"),
    ("price", "map", 0, None), ("price", "repair", 1, None), ("price", "pattern", 0, r"(?i)weight of (\d+)"),
    ("price", "pattern", 1, r"(?i)cost:\s*(\$[\d.]+)"), ("price", "coverage", 0, "main > article > table > tr > td || Price"),
    ("sheet", "map", 0, "article > a"), ("sheet", "repair", 1, "div.item > p.links"), ("sheet", "coverage", 0, "div.item > p.links"),
    ("colour", "map", 0, None),
]
SEEDS = ["kv:div.facts || Brand", "kv:div.facts || Make"]


class Parts:
    """Pages, plan, answers and grader of the run."""

    def __init__(self, spark, folder):
        self.spark = spark
        part = table(spark, folder, "part")
        self.brands = part.select(F.col("p_brand").alias("recipe")).distinct()
        self.pages = rd.part_pages(spark, folder).join(part.select("p_partkey", "p_brand"), "p_partkey").drop("recipe").withColumnRenamed("p_brand", "recipe")
        plan = spark.createDataFrame(list(enumerate(TYPES)), "field_pos int, field string")
        self.plan = plan.withColumn("type", F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col("field")])
        self.fields = self.brands.crossJoin(F.broadcast(self.plan.select("field")))
        self.answers = self.brands.crossJoin(F.broadcast(spark.createDataFrame(ANSWERS, "field string, kind string, round int, selector string")))
        self.seed = self.brands.select("recipe", F.lit("brand").alias("field"), F.array(*map(F.lit, SEEDS)).alias("selectors"))
        self.known = spark.createDataFrame([(KNOWN_BRAND, "title", ["ld:name"], "validated")], "recipe string, field string, selectors array<string>, status string")
        self.checked = self.brands.where("recipe LIKE 'Brand#1%'").select("recipe", F.lit("title").alias("field"), F.lit("2026-02-10").cast("date").alias("checked_on"))
        sheet = F.when(F.col("p_partkey") % 2 == 0, F.format_string("https://www.parts.org/files/part-%d.pdf", "p_partkey")).otherwise(F.format_string("https://www.parts.org/part/sheet-%d.html?download=1", "p_partkey"))
        shown = {"title": F.col("p_name"), "brand": F.col("p_brand"), "kind": F.col("p_type"), "price": F.format_string("$%.2f", "p_retailprice"), "sheet": sheet, "colour": F.lit(None).cast("string")}
        self.truth = part.select("p_partkey", F.col("p_brand").alias("recipe"), F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c.alias("truth")) for n, c in shown.items()))).alias("t")).select("p_partkey", "recipe", "t.*")
        first = Window.partitionBy("p_brand").orderBy("p_partkey")
        self.sample = cut_lineage(part.select("p_partkey", "p_brand").withColumn("nth", F.row_number().over(first)).where(f"nth <= {ql.SAMPLE_PAGES}").select("p_partkey"))
        # a few pages per recipe, tried again and again: parsed once
        self.tried = cut_lineage(rc.with_items(self.pages.join(F.broadcast(self.sample), "p_partkey", "left_semi")))
        self.last = self.empty = None

    def values(self, trial: DataFrame, pages: DataFrame) -> DataFrame:
        """(recipe, p_partkey, field, value) of all pages whose recipe has a selector."""
        rows = trial.select(*ln.KEY, F.posexplode("selectors").alias("prio", "selector")).join(F.broadcast(self.plan), "field")
        return rc.value_rows(rc.apply_recipes(pages, rc.compile_recipes(rows))).select("recipe", "p_partkey", "field", "value")

    def probes(self, trial: DataFrame) -> DataFrame:
        """The first two pages of each field, outside the sample if there are any, that the settled selectors left empty."""
        empty = self.empty.join(trial.select(*ln.KEY), ln.KEY, "left_semi")
        marked = empty.join(self.sample.withColumn("inside", F.lit(True)), "p_partkey", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
        return marked.withColumn("nth", F.row_number().over(Window.partitionBy(*ln.KEY).orderBy("inside", "p_partkey"))).where("nth <= 2").select("recipe", "field", "p_partkey")

    def grade(self, trial: DataFrame, kind: str, round_: int, again: DataFrame | None) -> DataFrame:
        shown = self.truth.join(trial.select(*ln.KEY), ln.KEY, "left_semi")
        if kind == "coverage":
            asked = cut_lineage(shown.join(self.probes(trial), [*ln.KEY, "p_partkey"], "left_semi"))
            got = self.values(trial, self.pages.join(asked.select("p_partkey").distinct(), "p_partkey", "left_semi"))
        else:
            asked = shown.join(F.broadcast(self.sample), "p_partkey", "left_semi")
            if again is None:
                self.last = cut_lineage(self.values(trial, self.tried))
            got = self.last  # the second opinion sees the same records
        rows = asked.join(got, [*ln.KEY, "p_partkey"], "left").withColumn("url", F.col("p_partkey").cast("string"))
        verdict = F.when(F.col("truth").isNull(), F.when(F.col("value").isNull(), "absent").otherwise("wrong")).when(F.col("value").isNull(), "missed").when(F.col("value") == F.col("truth"), "correct").otherwise("wrong")
        if again is not None:  # it finds every third sheet right
            rows = rows.join(again, ["recipe", "url"], "left_semi")
            verdict = F.when((F.col("field") == "sheet") & (F.col("p_partkey") % 3 == 0), "correct").otherwise(verdict)
        return rows.select(*ln.KEY, "url", verdict.alias("verdict"))

    def run(self, answers: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
        return ln.learn(self.fields, self.answers if answers is None else answers, self.grade, log, self.known, self.seed)

    def covered(self, log: DataFrame) -> tuple[DataFrame, DataFrame]:
        fields = ln.settled(log)
        got = self.truth.select("recipe", "field", "p_partkey").join(self.values(fields, self.pages), ["recipe", "field", "p_partkey"], "left")
        self.empty = cut_lineage(got.where("value IS NULL").select("recipe", "field", "p_partkey"))
        empty = self.empty.groupBy(*ln.KEY).agg(F.count(F.lit(1)).alias("empty"))
        totals = self.truth.groupBy(*ln.KEY).agg(F.count(F.lit(1)).alias("total"))
        counts = totals.join(empty, ln.KEY, "left").select(*ln.KEY, F.coalesce("empty", F.lit(0)).alias("empty"), "total")
        return ln.cover(fields, counts, self.answers, self.grade, self.checked, F.lit(TODAY).cast("date"))


_SAMPLE = (
    "WITH s AS (SELECT p_brand, count(*) FILTER (p_partkey % 2 = 0) AS e, count(*) FILTER (p_partkey % 2 = 1) AS o, count(*) FILTER (p_partkey % 2 = 1 AND p_partkey % 3 = 0) AS u "
    "FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part) WHERE nth <= 4 GROUP BY 1), "
    "a AS (SELECT p_brand, count(*) FILTER (p_partkey % 2 = 0) AS even, count(*) FILTER (p_partkey % 2 = 1) AS odd, count(*) AS n FROM part GROUP BY 1), "
    f"b AS (SELECT *, p_brand = '{KNOWN_BRAND}' AS known, e > 0 AND 4 * o <= e + o AS first_only, e > 0 AND 4 * (o - u) <= e + o - u AS sheet_first, o > 0 AND 4 * e <= e + o AS prose, "
    "5 * odd >= n AS odd_gap, 5 * even >= n AS even_gap, p_brand LIKE 'Brand#1%' AS recent FROM s JOIN a USING (p_brand))"
)
_H, _K, _P, _L = "article > h1.title", "kv:div.facts || ", r"re:(?i)cost:\s*(\$[\d.]+)", "div.item > p.links"


@query(
    "learned_fields",
    f"{_SAMPLE}, f AS (SELECT p_brand AS recipe, unnest(["
    f"{{'field': 'title', 'status': 'validated', 'selectors': CASE WHEN known THEN 'ld:name' WHEN first_only AND (recent OR NOT odd_gap) THEN '{_H}' ELSE '{_H} + ld:name' END}}, "
    f"{{'field': 'brand', 'status': CASE WHEN known THEN 'unreliable' ELSE 'validated' END, 'selectors': CASE WHEN known THEN '' ELSE '{_K}Brand + {_K}Make' END}}, "
    f"{{'field': 'kind', 'status': CASE WHEN known THEN 'unreliable' ELSE 'validated' END, 'selectors': CASE WHEN known THEN '' WHEN e = 0 THEN '{_K}Brand + {_K}Type + {_K}Kind' WHEN first_only THEN '{_K}Type' ELSE '{_K}Type + {_K}Kind' END}}, "
    f"{{'field': 'price', 'status': CASE WHEN known OR NOT prose THEN 'unreliable' ELSE 'validated as text pattern' END, 'selectors': CASE WHEN known OR NOT prose THEN '' WHEN even_gap THEN '{_P} + main > article > table > tr > td || Price' ELSE '{_P}' END}}, "
    f"{{'field': 'sheet', 'status': CASE WHEN known THEN 'unreliable' ELSE 'validated' END, 'selectors': CASE WHEN known THEN '' WHEN sheet_first AND NOT odd_gap THEN 'article > a' ELSE 'article > a + {_L}' END}}, "
    "{'field': 'colour', 'status': CASE WHEN known THEN 'unreliable' ELSE 'absent' END, 'selectors': ''}]) AS f FROM b) SELECT recipe, f.field AS field, f.status AS status, f.selectors AS selectors FROM f",
)
def learned_fields(spark, folder):
    """Validated, absent and unreliable fields of every recipe, with the selectors that are delivered."""
    parts = Parts(spark, folder)
    after, _ = parts.covered(parts.run())
    return after.select(*ln.KEY, "status", F.array_join("selectors", " + ").alias("selectors"))


@query(
    "learn_and_apply",
    f"{_SAMPLE} SELECT p_partkey, CASE WHEN known OR p_partkey % 2 = 0 OR NOT (first_only AND (recent OR NOT odd_gap)) THEN p_name END AS title, CASE WHEN NOT known THEN p_brand END AS brand, "
    "CASE WHEN known THEN NULL WHEN p_partkey % 2 = 0 THEN CASE WHEN e = 0 THEN p_brand ELSE p_type END WHEN e > 0 AND first_only THEN NULL ELSE p_type END AS kind, "
    "CASE WHEN NOT known AND prose AND (p_partkey % 2 = 1 OR even_gap) THEN printf('$%.2f', p_retailprice) END AS price, "
    "CASE WHEN known THEN NULL WHEN p_partkey % 2 = 0 THEN 'https://www.parts.org/files/part-' || p_partkey || '.pdf' WHEN sheet_first AND NOT odd_gap THEN NULL ELSE 'https://www.parts.org/part/sheet-' || p_partkey || '.html?download=1' END AS sheet "
    "FROM part JOIN b USING (p_brand)",
)
def learn_and_apply(spark, folder):
    """From nothing to records: learnt selectors, their further forms, and every page with what they find."""
    parts = Parts(spark, folder)
    after, _ = parts.covered(parts.run())
    found = parts.values(after, parts.pages).groupBy("p_partkey").pivot("field", list(TYPES)).agg(F.first("value"))
    return table(spark, folder, "part").select("p_partkey").join(found, "p_partkey", "left").select("p_partkey", "title", "brand", "kind", "price", "sheet")
