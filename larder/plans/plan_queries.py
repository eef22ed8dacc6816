"""Queries on plan text, title matching, plan ordering and shopping lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import plan_text as P
from larder.functions.text import first_words
from larder.operators import plan
from larder.session import computed_once, cut_lineage
from larder.sources import plan_files, views

YEAR = 2024
# Whose absence plans note beside a title.
PEOPLE = ("sam",)


def _lines(spark, d):
    return plan_files.plan_lines(views.plan_texts(spark, d))


def plan_lines(spark, d):
    lines = plan.classify_lines(_lines(spark, d))
    return lines.select("file_id", "line_no", "line", "kind")


def lookahead_line(spark, d):
    return plan.lookahead_line(_lines(spark, d))


def meal_text(spark, d):
    return _lines(spark, d).select("file_id", "line_no", P.meal_text(F.col("line")).alias("meal_text"))


def _titles(spark, d):
    """Document titles in the ways plans write them."""
    docs = views.documents(spark, d)
    form, title = F.col("recipe_id") % 7, F.col("title")
    written = (
        F.when(form == 0, F.concat(F.lit("Monday - "), title))
        .when(form == 1, F.concat(F.lit("Dinner "), title))
        .when(form == 2, F.concat(title, F.lit(" (Soup of the day)")))
        .when(form == 3, F.concat(F.lit("Tuesday "), title, F.lit(" (sam out)")))
        .when(form == 4, F.concat(F.lit("("), title, F.lit(")")))
        .when(form == 5, first_words(title, 7))
        .otherwise(title)
    )
    return docs.select(F.col("recipe_id").alias("entry_id"), written.alias("title"))


def _known(spark, d):
    docs = views.documents(spark, d)
    return docs.select("recipe_id", "title", "cookbook_title", F.col("recipe_id").alias("listing_order"))


def title_variants(spark, d):
    return _titles(spark, d).select("entry_id", F.array_join(P.title_variants(F.col("title"), PEOPLE), "|").alias("variants"))


def entry_cleaners(spark, d):
    line = F.col("line")
    return _lines(spark, d).select(
        "file_id",
        "line_no",
        P.clean_entry(line).alias("clean_entry"),
        P.display_title(line).alias("display_title"),
        P.trim_heading(line).alias("trim_heading"),
        P.link_label(line).alias("link_label"),
        P.slot_title(line).alias("slot_title"),
    )


def plan_labels(spark, d):
    rows = views.plan_rows(spark, d)
    return rows.select(
        "row_id",
        P.weekday_label(F.concat(F.lit(" - "), F.upper("weekday"))).alias("weekday"),
        P.meal_label(F.col("meal")).alias("meal"),
    )


def _headings(spark, d):
    rows = views.dishes(spark, d)
    day, key = F.col("created_on"), F.col("recipe_id")
    form = key % 9
    heading = (
        F.when(form == 0, day.cast("string"))
        .when(form == 1, F.concat(F.lit("Week of "), F.date_format(day, "d MMMM yyyy")))
        .when(form == 2, F.concat(F.lit("week 3 of "), F.date_format(day, "d MMM")))
        .when(form == 3, F.date_format(day, "dd MMM yy"))
        .when(form == 4, F.concat(F.lit("Week "), F.date_format(day, "d MMM")))
        .when(form == 5, F.concat(F.lit("3"), (key % 3).cast("string"), F.lit(" feb "), F.date_format(day, "yyyy")))
        .when(form == 6, F.upper(F.date_format(day, "d MMMM")))
        .when(form == 7, F.concat(F.date_format(day, "yyyy-MM-"), F.lit("31")))
        .otherwise(F.concat(F.lit("Plan "), F.date_format(day, "MMM")))
    )
    return rows.select("recipe_id", heading.alias("heading"))


def week_start(spark, d):
    return _headings(spark, d).select("recipe_id", "heading", P.week_start(F.col("heading"), YEAR).alias("start_on"))


def week_title(spark, d):
    start = P.week_start(F.col("heading"), YEAR)
    legacy = F.when(F.col("recipe_id") % 2 == 0, F.col("heading")).otherwise("")
    return _headings(spark, d).select("recipe_id", P.week_title(start, legacy).alias("title"))


def heading_tests(spark, d):
    line = F.col("line")
    return _lines(spark, d).select(
        "file_id", "line_no",
        P.is_section_heading(line).alias("is_section"),
        P.is_group_heading(line).alias("is_group"),
    )


def schedule_row(spark, d):
    parts = P.schedule_parts(F.col("line"))
    rows = _lines(spark, d).select("file_id", "line_no", parts.alias("parts")).where(F.col("parts").isNotNull())
    return rows.select(
        "file_id", "line_no", F.col("parts")[0].alias("day"), F.col("parts")[1].alias("lunch"),
        F.col("parts")[2].alias("dinner"),
    )


def build_entry(spark, d):
    rows = computed_once(_lines(spark, d), "e", P.bulleted_entry(F.trim("line")))
    return rows.where(F.col("e").isNotNull()).select("file_id", "line_no", "e.*").drop("day")


def non_recipe_entries(spark, d):
    entries = plan.plan_carry_forward(_lines(spark, d))
    return plan.non_recipe_entries(entries).select("file_id", "line_no", "slot", "title")


def _entries(spark, d):
    return plan.plan_carry_forward(_lines(spark, d))


def plan_carry_forward(spark, d):
    return _entries(spark, d).select(
        "file_id", "section_no", "section_title", "group_at", "group_title", "line_no", "slot", "title", "raw_text",
        "is_recipe", "is_complete", "day", "external_url", F.array_join("details", "|").alias("details"),
    )


def recent_weeks(spark, d):
    return plan.recent_weeks(_entries(spark, d), 2).select("file_id", "week_seq", "line_no", "slot", "title")


def infer_day_meal(spark, d):
    rows = plan.plan_rows_from_entries(_entries(spark, d), YEAR)
    return rows.where("is_row").select(
        "file_id", "line_no", "slot", "start_on", "legacy_title", "title", "weekday", "meal", "completed"
    )


def plan_notes(spark, d):
    return plan.plan_notes(plan.plan_rows_from_entries(_entries(spark, d), YEAR))


def exact_title_match(spark, d):
    return plan.exact_title_match(_titles(spark, d), _known(spark, d), PEOPLE)


def fuzzy_title_match(spark, d):
    # Read more than once each; the texts that they are cut from are not.
    titles, known = cut_lineage(_titles(spark, d)), cut_lineage(_known(spark, d))
    rest = titles.join(plan.exact_title_match(titles, known, PEOPLE), "title", "left_anti")
    return plan.fuzzy_title_match(rest, known, people=PEOPLE)


def _written_plans(spark, d):
    """Plans of six documents' titles each, in the ways plans write them."""
    docs = views.documents(spark, d)
    title, form = F.col("title"), F.col("recipe_id") % 6
    number = (1 + F.floor(F.col("recipe_id") / 6) % 28).cast("string")
    line = (
        F.when(form == 0, F.concat(F.lit("Week of "), number, F.lit(" April 2024\nDinners:\n- [x] "), title))
        .when(form == 1, F.concat(F.lit("• "), title))
        .when(form == 2, F.concat(title, F.lit(" https://example.com/a")))
        .when(form == 3, F.concat(F.lit("Lunches\n- Tuesday: "), title, F.lit("\n• for two")))
        .when(form == 4, F.concat(F.lit("- "), first_words(title, 7)))
        .otherwise(F.concat(F.lit("\nFriday\t"), title, F.lit("\tSoup")))
    )
    files = docs.groupBy(F.floor(F.col("recipe_id") / 6).cast("bigint").alias("file_id"))
    lines = files.agg(F.array_sort(F.collect_list(F.struct("recipe_id", line.alias("line")))).alias("lines"))
    return lines.select("file_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def import_plans(spark, d):
    """From plan files to ranked rows with their dishes, and the notes of their weeks."""
    rows, notes = plan.import_plans(_written_plans(spark, d), cut_lineage(_known(spark, d)), YEAR, PEOPLE)
    return rows.join(notes, ["file_id", "section_no"], "left").select(
        "file_id", "section_no", "start_on", "rank", "weekday", "meal", "title", "completed", "recipe_id", "score", "notes"
    )


def client_title_match(spark, d):
    found = plan.client_title_match(_titles(spark, d), _known(spark, d))
    return found.withColumn("score", F.round("score", 6))


def best_with_margin(spark, d):
    """The margin rule on the stock prices of parts: the clearly dearest order line per order."""
    lines = views.table(spark, d, "lineitem")
    scored = lines.select(
        F.col("l_orderkey").alias("title"), F.col("l_partkey").alias("recipe_id"),
        F.round(F.col("l_extendedprice") / 100000, 4).alias("score"),
    ).groupBy("title", "recipe_id", "score").agg(F.count("*").alias("copies"))
    return plan.best_with_margin(scored, 0.81, 0.035)


def resolve_reference(spark, d):
    titles = _titles(spark, d)
    key = F.col("entry_id")
    form = key % 4
    rows = titles.select(
        key.alias("row_id"),
        F.when(form == 0, F.concat("title", F.lit(" - Book ["), (key + 1).cast("string"), F.lit("] "))).otherwise(F.col("title")).alias("value"),
        F.when(form == 1, F.lit(" ")).otherwise(F.col("title")).alias("fallback_title"),
        F.when(form == 2, (key * 2).cast("string")).otherwise("").alias("explicit_id"),
    )
    return plan.resolve_reference(rows, _known(spark, d), fuzzy=False, people=PEOPLE)


def sort_plan_rows(spark, d):
    return plan.sort_plan_rows(views.plan_rows(spark, d)).select(
        "week_id", "row_id", "day_offset", "meal_offset", "rank"
    )


def plan_link_hydrate(spark, d):
    dishes = views.dishes(spark, d).select("recipe_id", F.col("priority").alias("title"))
    return plan.plan_link_hydrate(views.plan_rows(spark, d), dishes).select("row_id", "recipe_id", "recipe_title")


def next_week_start(spark, d):
    """Each customer's orders as that customer's weeks, newest first."""
    rows = views.dishes(spark, d)
    weeks = rows.select(
        F.col("cookbook_id").alias("plan_id"), (-F.col("recipe_id")).alias("week_seq"),
        F.when(F.col("recipe_id") % 3 != 0, F.col("created_on").cast("string")).otherwise("").alias("start_on"),
    )
    return plan.next_week_start(weeks)


def _shopping(spark, d):
    dishes = views.dishes(spark, d).select("recipe_id", F.concat(F.lit("Dish "), (F.col("recipe_id") % 50).cast("string")).alias("title"))
    lines = views.ingredients(spark, d).select(
        "recipe_id", F.lit(None).cast("string").alias("canonical_name"), F.col("name").alias("normalized_name"), "raw"
    )
    rows = plan.plan_link_hydrate(views.plan_rows(spark, d).drop("title"), dishes)
    return rows, dishes, lines


def shopping_list(spark, d):
    return plan.shopping_list(*_shopping(spark, d)).select(
        "week_id", "name", "total_uses", "source_count", "first_source", "rank"
    )


def shopping_sources(spark, d):
    uses = plan.shopping_uses(*_shopping(spark, d))
    return plan.shopping_sources(uses).select("week_id", "key", "recipe_id", "use_count", "source_label")


def shopping_label(spark, d):
    from larder.functions.ingredients import shopping_label as label

    lines = views.ingredients(spark, d)
    raw = F.when(F.col("line_no") % 3 == 0, F.regexp_extract("raw", "^[^,]*", 0)).otherwise(F.col("raw"))
    return lines.select(raw.alias("raw"), "name").distinct().select("raw", "name", label(F.col("raw"), F.col("name")).alias("label"))


def plan_stats(spark, d):
    rows = views.plan_rows(spark, d)
    items = plan.shopping_items(plan.shopping_uses(*_shopping(spark, d)))
    return plan.plan_stats(rows, items)


def recipe_options(spark, d):
    return plan.recipe_options(_known(spark, d))


def _plan_files(spark, d):
    """Plan documents: one per customer and month, one week per order date's week."""
    rows = views.plan_rows(spark, d)
    orders = views.dishes(spark, d).select("recipe_id", "cookbook_id", F.date_format("created_on", "yyyy-MM").alias("month"))
    joined = rows.join(orders, rows.row_id == orders.recipe_id).drop(orders.recipe_id)
    return joined.select(
        F.concat_ws("/", "cookbook_id", "month").alias("file_id"),
        F.datediff(F.col("start_on").cast("date"), F.lit("1990-01-07").cast("date")).alias("week_seq"),
        "week_id", "start_on", F.lit("").alias("legacy_title"),
        F.concat(F.lit("r"), "row_id").alias("row_id"), "row_seq",
        P.weekday_label(F.col("weekday")).alias("weekday"), P.meal_label(F.col("meal")).alias("meal"),
        "title", "completed", F.col("recipe_id").cast("string").alias("recipe_id"),
    )


def plan_rows_to_json(spark, d):
    """Round trip: rows to documents and back."""
    documents = plan_files.plan_rows_to_json(_plan_files(spark, d))
    return plan_files.plan_rows_from_json(documents, YEAR).select(
        "file_id", "week_id", "start_on", "row_id", "weekday", "meal", "title", "completed", "recipe_id"
    )


def _plan_json(spark, d):
    key = F.col("o_orderkey")
    text = F.col("o_orderpriority")
    row = F.struct(
        F.lit("a").alias("id"), F.lit("TUESDAY").alias("weekday"), F.lit("dinner").alias("meal"),
        F.concat(F.lit(" "), text, F.lit(" ")).alias("title"), (key % 2 == 0).alias("completed"),
        F.lit("").alias("recipe_id"),
    )
    meal = F.struct(
        F.lit("").alias("meal_label"), F.lit("lunch").alias("meal_slug"), text.alias("title"),
        F.lit(True).alias("completed"), key.cast("string").alias("recipe_id"),
    )
    new = F.struct(F.lit("w1").alias("id"), F.lit("Undated Week").alias("title"), F.lit("2024-04-14").alias("start_on"), F.array(row).alias("entries"))
    day = F.struct(F.lit("").alias("label"), F.lit("friday").alias("slug"), F.array(meal).alias("meals"))
    old = F.struct(F.lit("11 April 2024").alias("title"), F.lit("").alias("start_on"), F.array(day).alias("days"))
    payload = (
        F.when(key % 3 == 0, F.to_json(F.struct(F.array(new).alias("weeks"))))
        .when(key % 3 == 1, F.to_json(F.struct(F.array(old).alias("weeks"))))
        .otherwise("{}")
    )
    return views.table(spark, d, "orders").select(key.alias("file_id"), payload.alias("payload"))


def plan_rows_from_json(spark, d):
    return plan_files.plan_rows_from_json(_plan_json(spark, d), YEAR)


def plan_format_union(spark, d):
    rows = plan_files.plan_rows_from_json(_plan_json(spark, d), YEAR)
    current = rows.where(F.col("week_id") == "w1").select("file_id", "row_id", "title", "completed")
    older = rows.where(F.col("week_id") != "w1").select("file_id", "title", "recipe_id")
    return plan_files.plan_format_union(current, older)


QUERIES = {
    f.__name__: f
    for f in (
        plan_lines, lookahead_line, meal_text, title_variants, entry_cleaners, plan_labels, week_start, week_title,
        heading_tests, schedule_row, build_entry, non_recipe_entries, plan_carry_forward, recent_weeks,
        infer_day_meal, plan_notes, exact_title_match, fuzzy_title_match, import_plans, client_title_match, best_with_margin,
        resolve_reference, sort_plan_rows, plan_link_hydrate, next_week_start, shopping_list, shopping_sources,
        shopping_label, plan_stats, recipe_options, plan_rows_to_json, plan_rows_from_json, plan_format_union,
    )
}
