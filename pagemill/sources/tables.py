"""Reading what a run starts from: stored pages, plans, recipes, saved runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FETCHES = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("final_url", T.StringType()),
    T.StructField("status", T.IntegerType()), T.StructField("html", T.StringType()),
    T.StructField("via", T.StringType()), T.StructField("title", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("more", T.StructType([T.StructField("rounds", T.IntegerType()), T.StructField("clicks", T.IntegerType())])),
    T.StructField("_corrupt", T.StringType()),
])

PLAN = T.StructType([
    T.StructField("prompt", T.StringType()), T.StructField("target", T.StringType()),
    T.StructField("singular", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("confusables", T.ArrayType(T.StringType())), T.StructField("listing_names", T.ArrayType(T.StringType())),
    T.StructField("examples", T.ArrayType(T.StringType())),
    T.StructField("fields", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("example", T.StringType()),  # text, number or list: kept as its JSON text
        T.StructField("pattern", T.StringType()),
    ]))),
])

_COST = T.StructType([
    T.StructField("calls", T.LongType()), T.StructField("in", T.LongType()), T.StructField("out", T.LongType()),
    T.StructField("usd", T.DoubleType()),
])
RECIPE = T.StructType([
    T.StructField("site", T.StringType()), T.StructField("prompt", T.StringType()), T.StructField("listing", T.StringType()),
    T.StructField("item_pattern", T.StringType()), T.StructField("paging", T.StringType()),
    T.StructField("selectors", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("coverage_checked", T.MapType(T.StringType(), T.StringType())),
    T.StructField("fields_in_plan", T.ArrayType(T.StringType())), T.StructField("validated_on", T.StringType()),
    T.StructField("build_cost", T.MapType(T.StringType(), _COST)),
])

CACHE = T.StructType([
    T.StructField("hub", T.StringType()), T.StructField("listed", T.MapType(T.StringType(), T.StringType())),
    T.StructField("info", T.StructType([T.StructField("item_pattern", T.StringType()), T.StructField("mode", T.StringType())])),
    T.StructField("pages", T.MapType(T.StringType(), T.StructType([
        T.StructField("html", T.StringType()), T.StructField("via", T.StringType())]))),
])


def fetch_results(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a fetcher, one per URL in any order, success or error; unreadable lines stay in ``_corrupt``."""
    return spark.read.schema(FETCHES).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def plans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLAN).option("multiLine", True).json(path)


def plan_fields(plans_: DataFrame) -> DataFrame:
    """One row per plan and field, in the plan's order."""
    return plans_.select("prompt", F.posexplode("fields").alias("field_pos", "f")).select("prompt", "field_pos", "f.*")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPE).option("multiLine", True).json(path)


def matching_recipes(recipes_: DataFrame, plans_: DataFrame) -> DataFrame:
    """Recipes made for exactly the plan's fields; others have to be learned again."""
    wanted = plans_.select("prompt", F.transform("fields", lambda f: f["name"]).alias("names"))
    return recipes_.join(wanted, "prompt").where(F.col("fields_in_plan") == F.col("names")).drop("names")


def recipe_id(site: Column | str, prompt: Column | str) -> Column:
    """What a recipe is known by: its site and its prompt. Pages carry the same in their column ``recipe``."""
    return F.to_json(F.struct(F.col(site).alias("site"), F.col(prompt).alias("prompt")) if isinstance(site, str) else F.struct(site.alias("site"), prompt.alias("prompt")))


def recipe_selectors(recipes_: DataFrame, fields: DataFrame) -> DataFrame:
    """Selector rows for ``compile_recipes``: ``recipe, field_pos, field, type, prio, selector``. Several sites may have a
    recipe for one prompt, and a site recipes for several; types come from the plan of the recipe's own prompt."""
    exploded = recipes_.select("site", "prompt", F.explode("selectors").alias("name", "many")).select(
        "site", "prompt", "name", F.posexplode("many").alias("prio", "selector"))
    return exploded.join(fields.select("prompt", "name", "field_pos", "type"), ["prompt", "name"]).select(
        recipe_id("site", "prompt").alias("recipe"), "field_pos", F.col("name").alias("field"), "type", "prio", "selector")


def page_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A saved run's pages: (pages(url, html, via), listed(url, title)) without their hub's other state."""
    cache = spark.read.schema(CACHE).option("multiLine", True).json(path)
    pages = cache.select("hub", "info.item_pattern", F.explode("pages").alias("url", "p")).select("hub", "item_pattern", "url", "p.html", "p.via")
    return pages, cache.select("hub", F.posexplode("listed").alias("list_pos", "url", "list_title"))


def archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def quality_input(values: DataFrame, pages: DataFrame) -> DataFrame:
    """Values of a saved run next to the page they came from."""
    return values.join(pages.select("url", "html"), "url")
