"""Domain views over the driver's tables: dishes, ingredients, cookbooks, documents, plans.

Each view is a lazy projection or join, so filters and column pruning reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import first_words, squash
from larder.session import spread

# Collection slug of each market segment of the customer table; the last has no collection.
SEGMENT_SLUGS = {
    "BUILDING": "nytimes",
    "AUTOMOBILE": "jamie-oliver",
    "MACHINERY": "bbc-goodfood",
    "HOUSEHOLD": "waitrose-recipes",
}
REVIEW_OF_STATUS = {"F": "verified", "O": "pending_review", "P": "needs_review"}


LARGE_TABLES = ("documents", "pages", "conversations", "lineitem", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in LARGE_TABLES else rows


def _mapped(c: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for pair in names.items() for v in pair)), c)


def dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recipe per order. ``position`` is the stored order score within the cookbook."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("recipe_id"),
        F.col("o_custkey").alias("cookbook_id"),
        F.col("o_orderkey").alias("position"),
        F.to_date("o_orderdate").alias("created_on"),
        _mapped(F.col("o_orderstatus"), REVIEW_OF_STATUS).alias("review_status"),
        F.col("o_orderpriority").alias("priority"),
    )


def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One written ingredient line per order line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("recipe_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_linenumber").alias("line_no"),
        F.concat(
            F.col("l_quantity").cast("int").cast("string"), F.lit("g "), "p_name", F.lit(", "), F.lower("p_type")
        ).alias("raw"),
        F.col("p_name").alias("name"),
    )


def ingredient_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted index: distinct (name, recipe_id)."""
    return ingredients(spark, sf_dir).select("recipe_id", "name").distinct()


def part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted index on the wide vocabulary: part numbers as names."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("recipe_id"), F.col("l_partkey").alias("name"))
        .distinct()
    )


def cookbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    year = (1990 + key % 30).cast("string")
    month = F.lpad((1 + key % 12).cast("string"), 2, "0")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("cookbook_id"),
        F.col("c_name").alias("title"),
        F.when(F.col("c_acctbal") >= 0, F.col("n_name")).alias("author"),
        F.col("n_name").alias("cuisine"),
        _mapped(F.col("c_mktsegment"), SEGMENT_SLUGS).alias("collection_slug"),
        F.when(key % 11 != 0, F.when(key % 3 == 0, year).otherwise(F.concat_ws("-", year, month))).alias(
            "published_at"
        ),
        (1577836800 + (key * 7919) % 1000003).alias("uploaded_epoch"),
        F.when(key % 13 != 0, key % 7).alias("recipe_count"),
        F.col("c_acctbal").alias("balance"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dishes read from the document table, whole texts kept."""
    doc = table(spark, sf_dir, "documents")
    return doc.select(
        F.col("doc_id").alias("recipe_id"),
        F.col("source").alias("cookbook_title"),
        F.col("lang"),
        first_words(F.col("text"), 8).alias("title"),
        F.col("text"),
        F.split("text", "\n").alias("lines"),
    )


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that keyword search reads."""
    docs = documents(spark, sf_dir)
    line = F.col("lines")
    return docs.select(
        "recipe_id",
        "title",
        "cookbook_title",
        F.array(F.lower(squash(F.col("lang")))).alias("ingredient_names"),
        F.filter(line, lambda x: F.rlike(x, F.lit("[0-9]"))).alias("ingredient_raw"),
        line.alias("method_steps"),
        F.substring(F.array_join(F.slice(line, 1, 4), " "), 1, 420).alias("excerpt"),
        F.col("recipe_id").alias("scan_order"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("recipe_id"), F.col("embedding")
    )


def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourite and want-to-try switches of the event stream."""
    return toggles_of(table(spark, sf_dir, "events"))


def toggles_of(events: DataFrame) -> DataFrame:
    kinds = {"click": "favourite", "view": "favourite", "purchase": "want_to_try", "error": "want_to_try"}
    return events.where(F.col("event_type").isin(*kinds)).select(
        "event_id",
        "ts",
        _mapped(F.col("event_type"), kinds).alias("kind"),
        F.get_json_object("props", "$.k").cast("bigint").alias("recipe_id"),
        F.col("event_type").isin("click", "purchase").alias("is_on"),
    )


def plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One planned slot per order; weeks start on the Sunday before the order date."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    start = F.date_sub(day, F.dayofweek(day) - 1)
    return orders.select(
        F.concat(F.lit("week-"), start.cast("string")).alias("week_id"),
        start.cast("string").alias("start_on"),
        key.alias("row_id"),
        key.alias("row_seq"),
        F.when(key % 17 != 0, F.date_format(day, "EEEE")).otherwise("").alias("weekday"),
        F.element_at(F.array(*[F.lit(m) for m in ("breakfast", "LUNCH", "Dinner", "Tea", "")]), (key % 5 + 1).cast("int")).alias("meal"),
        F.when(key % 19 != 0, F.concat(F.lit("Order "), "o_orderpriority")).otherwise("").alias("title"),
        (F.col("o_orderstatus") == "F").alias("completed"),
        F.when(key % 5 != 0, F.when(key % 7 != 0, key).otherwise(key + 1000000000000)).alias("recipe_id"),
    )


def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text plans: every document line is kept whole and given a plan line's form."""
    doc = table(spark, sf_dir, "documents")
    forms = F.transform(
        F.split("text", "\n"),
        lambda line, i: plan_line_form(F.regexp_replace(line, "[\t\r]+", " "), (F.col("doc_id") + i) % 11, i),
    )
    return doc.select(F.col("doc_id").alias("file_id"), F.array_join(forms, "\n").alias("text"))


def plan_line_form(line: Column, form: Column, i: Column) -> Column:
    number = i.cast("string")
    return (
        F.when(form == 0, F.concat(F.lit("Week of "), (1 + i % 28).cast("string"), F.lit(" April 2024")))
        .when(form == 1, F.lit("Dinners:"))
        .when(form == 2, F.concat(F.lit("- [x] "), line))
        .when(form == 3, F.concat(F.lit("  • "), line))
        .when(form == 4, F.concat(F.lit("• "), line))
        .when(form == 5, F.lit(""))
        .when(form == 6, F.concat(F.lit("Monday\t"), line, F.lit("\t"), line))
        .when(form == 7, F.concat(F.lit("https://example.com/plan/"), number))
        .when(form == 8, F.concat(F.lit("- Tuesday lunch: "), line, F.lit(" https://example.com/a")))
        .when(form == 9, F.lit("snacks"))
        .otherwise(line)
    )
