"""Plan sources and sinks: free text files and the JSON document, version 2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.plan_text import display_title, meal_label, week_start, weekday_label
from larder.functions.text import blank_to_null, strip, text

LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
ROW = "struct<id:string,weekday:string,meal:string,title:string,completed:boolean,recipe_id:string>"
PLAN_SCHEMA = (
    "version int, weeks array<struct<id:string,title:string,start_on:string,legacy_title:string,"
    f"notes:string,entries:array<{ROW}>,"
    "days:array<struct<label:string,slug:string,meals:array<struct<meal_label:string,"
    "meal_slug:string,title:string,completed:boolean,recipe_id:string>>>>>>"
)


def read_plan_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per plan text file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))


def plan_lines(texts: DataFrame) -> DataFrame:
    """Lines of each plan in order."""
    return texts.select("file_id", F.posexplode(F.split("text", LINE_BREAK)).alias("line_no", "line"))


def _clean(c: Column) -> Column:
    return strip(text(c))


def plan_rows_from_json(plans: DataFrame, as_of_year: int) -> DataFrame:
    """Rows of plan documents ``(file_id, payload)``.

    A week without usable ``entries`` reads the older ``days[].meals[]`` layout and keeps a row
    only when one of its values is set. A week without rows, and a plan without weeks, gets one
    blank row. A document is one input row, so exploding it stays within its partition.
    """
    parsed = plans.select("file_id", F.from_json("payload", PLAN_SCHEMA).alias("plan"))
    weeks = parsed.select("file_id", F.posexplode_outer("plan.weeks").alias("week_seq", "week"))
    row_type = f"array<{ROW}>"

    def blank(c: Column) -> Column:
        return F.coalesce(c, F.array().cast(row_type))

    def shaped(row: Column) -> Column:
        return F.struct(
            _clean(row["id"]).alias("id"),
            weekday_label(text(row["weekday"])).alias("weekday"),
            meal_label(text(row["meal"])).alias("meal"),
            _clean(row["title"]).alias("title"),
            F.coalesce(row["completed"], F.lit(False)).alias("completed"),
            blank_to_null(_clean(row["recipe_id"])).alias("recipe_id"),
        )

    current = F.transform(blank(F.col("week.entries")), shaped)

    def older_meals(day: Column) -> Column:
        label = F.coalesce(blank_to_null(_clean(day["label"])), _clean(day["slug"]))
        return F.transform(
            F.coalesce(day["meals"], F.array()),
            lambda meal: shaped(
                F.struct(
                    F.lit("").alias("id"),
                    label.alias("weekday"),
                    F.coalesce(blank_to_null(_clean(meal["meal_label"])), text(meal["meal_slug"])).alias("meal"),
                    meal["title"].alias("title"),
                    meal["completed"].alias("completed"),
                    meal["recipe_id"].alias("recipe_id"),
                )
            ),
        )

    older = F.filter(
        F.flatten(F.transform(F.coalesce(F.col("week.days"), F.array()), older_meals)),
        lambda r: (r["title"] != "") | r["recipe_id"].isNotNull() | (r["weekday"] != "") | (r["meal"] != ""),
    )
    empty = F.array(
        F.struct(
            F.lit("").alias("id"), F.lit("").alias("weekday"), F.lit("").alias("meal"), F.lit("").alias("title"),
            F.lit(False).alias("completed"), F.lit(None).cast("string").alias("recipe_id"),
        )
    ).cast(row_type)
    start_on = week_start(_clean(F.col("week.start_on")), as_of_year)
    title = F.when(_clean(F.col("week.title")).isin("Undated Week", "New Week"), "").otherwise(_clean(F.col("week.title")))
    legacy = F.coalesce(blank_to_null(_clean(F.col("week.legacy_title"))), title)
    rows = (
        F.when(F.size(current) > 0, current.cast(row_type))
        .when(F.size(older) > 0, older.cast(row_type))
        .otherwise(empty)
    )
    spread = weeks.select(
        "file_id",
        F.coalesce("week_seq", F.lit(0)).alias("week_seq"),
        F.col("week.id").alias("week_name"),
        start_on.alias("start_on"),
        F.when(start_on == "", display_title(legacy)).otherwise("").alias("legacy_title"),
        _clean(F.col("week.notes")).alias("notes"),
        F.posexplode(rows).alias("row_seq", "row"),
    )
    # Missing ids derive from the place in the document, so a rerun gives the same ones.
    week_id = F.coalesce(blank_to_null(_clean(F.col("week_name"))), F.concat(F.lit("week-"), F.col("week_seq").cast("string")))
    return spread.select(
        "file_id",
        week_id.alias("week_id"),
        "week_seq",
        "start_on",
        "legacy_title",
        "notes",
        F.coalesce(
            blank_to_null(F.col("row.id")), F.concat(F.lit("row-"), "week_seq", F.lit("-"), "row_seq")
        ).alias("row_id"),
        "row_seq",
        "row.weekday",
        "row.meal",
        "row.title",
        "row.completed",
        "row.recipe_id",
    )


def plan_format_union(current: DataFrame, older: DataFrame) -> DataFrame:
    """Rows of both layouts in one table; values one layout lacks are empty."""
    return current.unionByName(older, allowMissingColumns=True)


def plan_rows_to_json(rows: DataFrame) -> DataFrame:
    """Plan documents of rows, weeks and rows in their order.

    The document is the unit of storage, so its rows meet in one place by design.
    """
    row = F.struct("row_seq", F.struct(F.col("row_id").alias("id"), "weekday", "meal", "title", "completed", "recipe_id").alias("row"))
    week_title = F.when(F.col("start_on") != "", F.concat(F.lit("Week of "), F.date_format(F.col("start_on").try_cast("date"), "d MMMM yyyy"))).otherwise(F.col("legacy_title"))
    weeks = rows.groupBy("file_id", "week_seq", "week_id", "start_on", "legacy_title").agg(
        F.array_sort(F.collect_list(row)).alias("rows")
    )
    week = F.struct(
        "week_seq",
        F.struct(
            F.col("week_id").alias("id"),
            week_title.alias("title"),
            "start_on",
            "legacy_title",
            F.lit("").alias("notes"),
            F.transform("rows", lambda r: r["row"]).alias("entries"),
        ).alias("week"),
    )
    plans = weeks.groupBy("file_id").agg(F.array_sort(F.collect_list(week)).alias("weeks"))
    body = F.struct(F.lit(2).alias("version"), F.transform("weeks", lambda w: w["week"]).alias("weeks"))
    return plans.select("file_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))
