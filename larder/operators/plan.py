"""Weekly plans: reading free text, matching titles to dishes, ordering, shopping lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from larder.functions import plan_text as P
from larder.functions.ingredients import index_name, shopping_label
from larder.functions.text import bind, blank_to_null, casefold, strip, text
from larder.operators.ordering import ranked
from larder.session import computed_once, cut_lineage, dealt, sized
from larder.sources.plan_files import plan_lines

# --- free text -------------------------------------------------------------------------------


def classify_lines(lines: DataFrame) -> DataFrame:
    """Kind of every plan line, and whether the next line is a detail (``•``).

    Windows are per file. A file arrives as one row, so its lines fit in a task.
    """
    order = Window.partitionBy("file_id").orderBy("line_no")
    line = strip(F.col("line"))
    kind = (
        F.when(line == "", "blank")
        .when(F.rlike(line, F.lit(f"^{P.URL}$")), "url")
        # A stripped line that does not start with a weekday has no first part that does, and is not taken apart.
        .when(P.starts_with_weekday(line) & P.schedule_parts(line).isNotNull(), "schedule")
        .when(P.is_section_heading(line), "section")
        .when(P.is_group_heading(line), "group")
        .when(F.startswith(line, F.lit("•")), "detail")
        .otherwise("entry")
    )
    return lines.select("file_id", "line_no", line.alias("line"), kind.alias("kind")).withColumns(
        {
            "before_detail": F.coalesce(F.startswith(F.lead("line").over(order), F.lit("•")), F.lit(False)),
            "after_reset": F.coalesce(
                F.lag("kind").over(order).isin("blank", "url", "schedule", "section", "group"), F.lit(True)
            ),
        }
    )


def lookahead_line(lines: DataFrame) -> DataFrame:
    """Lines that stand alone: followed at once by a detail line."""
    return classify_lines(lines).where(F.col("kind").isin("entry", "detail")).select(
        "file_id", "line_no", F.col("before_detail").alias("standalone")
    )


def plan_carry_forward(lines: DataFrame) -> DataFrame:
    """Entries of free-text plans with their week section, meal group and details.

    A heading holds for the lines after it. A ``•`` line belongs to the entry above it unless a
    blank, link, schedule row or heading lies between. Schedule rows add to the groups Lunches
    and Dinners. Groups with the same name in a section are one, in order of first mention.
    """
    by_file = Window.partitionBy("file_id").orderBy("line_no")
    line, kind = F.col("line"), F.col("kind")
    rows = classify_lines(lines).withColumn(
        "kind", F.when((kind == "detail") & F.col("after_reset"), "entry").otherwise(kind)
    )
    rows = rows.withColumns(
        {
            "section_no": F.sum((kind == "section").cast("int")).over(by_file),
            "entry_no": F.sum(kind.isin("entry", "url", "schedule").cast("int")).over(by_file),
        }
    )
    by_section = Window.partitionBy("file_id", "section_no").orderBy("line_no")
    earlier = by_section.rowsBetween(Window.unboundedPreceding, -1)
    heading = F.when(kind == "group", P.trim_heading(line))
    fills = kind.isin("entry", "url", "schedule") | ((kind == "group") & (F.lower(P.trim_heading(line)) != "meals"))
    # A group heading before anything else names the first group of the first dated section.
    opening = (F.col("section_no") == 0) & (kind == "group") & (
        F.coalesce(F.sum(fills.cast("int")).over(earlier), F.lit(0)) == 0
    )
    rows = rows.withColumns(
        {
            "section_title": F.coalesce(
                F.last(F.when(kind == "section", P.trim_heading(line)), ignorenulls=True).over(by_section),
                F.lit("Imported Plan"),
            ),
            "heading": F.last(heading, ignorenulls=True).over(by_section),
            "opening": F.when(opening, heading),
        }
    )
    whole = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    initial = F.when(
        F.col("section_no") == 1, F.coalesce(F.last("opening", ignorenulls=True).over(whole), F.lit("Meals"))
    ).otherwise("Meals")
    rows = rows.withColumn("initial", initial)
    details = (
        rows.where(kind == "detail")
        .select("file_id", "entry_no", "line_no", P.clean_entry(F.regexp_extract(line, P.BULLET, 1)).alias("detail"))
        .where(F.col("detail") != "")
        .groupBy("file_id", "entry_no")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "detail"))).alias("found"))
        .select("file_id", "entry_no", F.transform("found", lambda d: d["detail"]).alias("details"))
    )
    parts = P.schedule_parts(line)
    none = F.lit(None).cast("string")
    group = F.coalesce("heading", "initial")

    def slot(no: int, title: Column, body: Column, day: Column) -> Column:
        return F.struct(F.lit(no).alias("slot"), title.alias("group"), body.alias("body"), day.alias("day"))

    slots = F.when(
        kind == "schedule",
        F.array(slot(0, F.lit("Lunches"), parts[1], parts[0]), slot(1, F.lit("Dinners"), parts[2], parts[0])),
    ).otherwise(F.array(slot(0, group, line, none)))
    items = rows.where(kind.isin("entry", "url", "schedule", "group")).select("*", F.explode(slots).alias("s"))
    items = items.select("*", "s.slot", "s.group", "s.body", "s.day", (F.col("line_no") * 2 + F.col("s.slot")).alias("at"))
    same_group = Window.partitionBy("file_id", "section_no", F.lower("group"))
    first_at = F.when(F.lower("group") == F.lower("initial"), -1).otherwise(F.min("at").over(same_group))
    named = F.when(F.lower("group") == F.lower("initial"), F.col("initial")).otherwise(
        F.min_by("group", "at").over(same_group)
    )
    items = items.withColumns({"group_at": first_at, "group_title": named}).where(kind != "group")

    bullet = P.bulleted_entry(F.col("body"))
    standalone = (kind == "entry") & F.col("before_detail")
    plain_title = F.when(kind == "url", P.link_label(F.col("body"))).otherwise(P.clean_entry(F.col("body")))
    plain = F.struct(
        plain_title.alias("title"),
        F.col("body").alias("raw_text"),
        F.lit(False).alias("is_recipe"),
        F.lit(None).cast("boolean").alias("is_complete"),
        none.alias("day"),
        F.when(kind == "url", F.col("body")).alias("external_url"),
    )
    entry = (
        F.when(kind == "url", plain)
        .when(kind == "schedule", P.build_entry(F.col("body"), None, F.col("day")))
        .when(standalone, P.build_entry(F.col("body")))
        .otherwise(F.coalesce(bullet, plain))
    )
    # Filters on entries do not work them out again.
    found = computed_once(items, "e", entry).select(
        "file_id", "section_no", "section_title", "group_at", "group_title", "line_no", "slot", "entry_no", "e"
    )
    return found.join(details, ["file_id", "entry_no"], "left").select(
        "file_id", "section_no", "section_title", "group_at", "group_title", "line_no", "slot", "e.*",
        F.coalesce("details", F.array().cast("array<string>")).alias("details"),
    )


def recent_weeks(entries: DataFrame, n: int = 4) -> DataFrame:
    """Entries of the first ``n`` sections that have any; plans list the newest week first."""
    order = Window.partitionBy("file_id").orderBy("section_no")
    return entries.withColumn("week_seq", F.dense_rank().over(order) - 1).where(F.col("week_seq") < n)


def non_recipe_entries(entries: DataFrame) -> DataFrame:
    """Entries that name something to cook."""
    return entries.where(P.looks_like_recipe(F.col("title")))


def plan_rows_from_entries(entries: DataFrame, as_of_year: int) -> DataFrame:
    """Plan rows and row notes of text entries; a week without rows gets a blank one."""
    title = P.slot_title(F.col("title"))
    day = P.weekday_label(P.infer_day(F.col("day"), F.col("raw_text"), F.col("title")))
    meal = P.meal_label(P.infer_meal(F.col("raw_text"), F.col("title"), P.group_meal(F.col("group_title"))))
    start_on = P.week_start(F.col("section_title"), as_of_year)
    legacy = P.display_title(F.col("section_title"))
    remarks = F.array_join(F.concat(F.col("details"), F.array_compact(F.array("external_url"))), " | ")
    rows = entries.select(
        "file_id", "section_no", "group_at", "line_no", "slot",
        start_on.alias("start_on"),
        F.when((start_on == "") & (F.lower(legacy) != "new week"), legacy).otherwise("").alias("legacy_title"),
        title.alias("slot_title"),
        day.alias("weekday"),
        meal.alias("meal"),
        F.coalesce("is_complete", F.lit(False)).alias("completed"),
        "is_recipe",
        F.col("title").alias("match_title"),
        remarks.alias("remarks"),
        "external_url",
    )
    in_week = Window.partitionBy("file_id", "section_no")
    usable = F.col("slot_title") != ""
    note = (
        F.when(usable & (F.col("remarks") != ""), F.concat(
            F.coalesce(blank_to_null(F.col("weekday")), F.lit("Any day")), F.lit(" "), F.col("meal"), F.lit(" notes: "), "remarks"))
        .when(~usable & F.col("external_url").isNotNull(), F.concat(F.lit("Link: "), "external_url"))
        .otherwise("")
    )
    first = F.row_number().over(in_week.orderBy("group_at", "line_no", "slot")) == 1
    any_row = F.max(usable.cast("int")).over(in_week) == 1
    return rows.withColumns({"note": note, "is_row": usable | (first & ~any_row)}).select(
        "file_id", "section_no", "group_at", "line_no", "slot", "start_on", "legacy_title",
        F.col("slot_title").alias("title"),
        F.when(usable, F.col("weekday")).otherwise("").alias("weekday"),
        F.when(usable, F.col("meal")).otherwise("").alias("meal"),
        (F.col("completed") & usable).alias("completed"),
        "is_recipe", "match_title", "note", "is_row",
    )


def plan_notes(rows: DataFrame) -> DataFrame:
    """Notes text per week, one line per noted entry in plan order."""
    noted = rows.where(F.col("note") != "").groupBy("file_id", "section_no").agg(
        F.array_sort(F.collect_list(F.struct("group_at", "line_no", "slot", "note"))).alias("found")
    )
    return noted.select(
        "file_id", "section_no", strip(F.array_join(F.transform("found", lambda n: n["note"]), "\n")).alias("notes")
    )


# --- ordering and linking --------------------------------------------------------------------


def weekday_offset(weekday: Column, start_on: Column) -> Column:
    """Days after the start of the week (Sunday when unknown); 8 for no known weekday."""
    place = F.array_position(F.array(*[F.lit(d) for d in P.WEEKDAYS]), P.weekday_label(weekday))
    start = F.coalesce(F.weekday(start_on.try_cast("date")), F.lit(6))
    return F.when(place > 0, F.pmod(place - 1 - start, F.lit(7))).otherwise(8).cast("int")


def meal_order(meal: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(m) for m in P.MEALS]), P.meal_label(meal))
    return F.when(place > 0, place - 1).otherwise(4).cast("int")


def sort_plan_rows(rows: DataFrame) -> DataFrame:
    """Rank of each row in its week: weekday from the week's start, meal, then stored order."""
    keyed = rows.withColumns(
        {
            "day_offset": weekday_offset(F.col("weekday"), F.col("start_on")),
            "meal_offset": meal_order(F.col("meal")),
        }
    )
    return ranked(keyed, [F.col("day_offset"), F.col("meal_offset"), F.col("row_seq")], ["week_id"])


def next_week_start(weeks: DataFrame) -> DataFrame:
    """Start of the week to append: a week after the first dated week, back to its Sunday."""
    dated = weeks.where(F.col("start_on") != "").groupBy("plan_id").agg(
        F.min_by("start_on", "week_seq").alias("first_start")
    )
    later = F.date_add(F.col("first_start").cast("date"), 7)
    sunday = F.date_sub(later, F.pmod(F.weekday(later) + 1, F.lit(7)))
    return dated.select("plan_id", sunday.cast("string").alias("start_on"))


def plan_link_hydrate(plan_rows: DataFrame, dishes: DataFrame) -> DataFrame:
    """Attach recipe titles to plan rows; a link to a missing recipe becomes NULL."""
    known = dishes.select(F.col("recipe_id").alias("found_id"), F.col("title").alias("recipe_title"))
    return (
        plan_rows.join(known, plan_rows.recipe_id == F.col("found_id"), "left")
        .withColumn("recipe_id", F.col("found_id"))
        .drop("found_id")
    )


# --- title matching --------------------------------------------------------------------------

# Titles that hold a rare token, at most; commoner tokens lead to titles two at a time.
RARE_USES = 200


def _known_titles(dishes: DataFrame) -> DataFrame:
    """One row per normalised title: its first recipe in listing order and how many share it."""
    return (
        computed_once(dishes.select("recipe_id", "listing_order", "title"), "norm", P.meal_text(F.col("title")))
        .where(F.col("norm") != "")
        .groupBy("norm")
        .agg(
            F.min(F.struct("listing_order", "recipe_id")).alias("first"),
            F.count("*").alias("copies"),
        )
        .select("norm", "first.listing_order", "first.recipe_id", "copies")
    )


def _variants(entries: DataFrame, variants: Column) -> DataFrame:
    """Distinct titles with each of their readings; equal titles are matched once.

    Titles are small and their readings dear: they are dealt to all cores, however few bytes they have.
    """
    titles = dealt(entries.select("title").distinct(), "title")
    # Outer, so that readings are worked out once and not for a test of their number as well.
    return titles.select("title", F.explode_outer(variants).alias("variant")).where(F.col("variant").isNotNull())


def exact_title_match(entries: DataFrame, dishes: DataFrame, people: Sequence[str] = ()) -> DataFrame:
    """Titles one of whose readings equals a recipe title, ``(title, recipe_id)``.

    Among several, the recipe first in listing order wins, then the reading first in text order.
    """
    hits = _variants(entries, P.title_variants(F.col("title"), people)).join(
        _known_titles(dishes), F.col("variant") == F.col("norm")
    )
    return hits.groupBy("title").agg(
        F.min_by("recipe_id", F.struct("listing_order", "variant")).alias("recipe_id")
    )


def character_counts(texts: Sequence[str]) -> np.ndarray:
    """How often each character occurs in each text: one row of 16-bit counts a text."""
    flat = np.array([ord(c) for t in texts for c in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    seen, column = np.unique(flat, return_inverse=True)
    return np.bincount(owner * len(seen) + column, minlength=len(texts) * len(seen)).reshape(len(texts), -1).astype(np.int32)


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series, needed: pd.Series) -> pd.Series:
    """Similarity of two strings by matching blocks, or a bound of it that is below ``needed``.

    Matching blocks hold no more of a character than the string that has fewer of it. That bound is worked out for
    a whole batch at once, over one count vector for each distinct string; only pairs it leaves are measured.
    """
    result = np.zeros(len(left))
    for at in range(0, len(left), 4096):
        one, two, least = (x.iloc[at : at + 4096].to_numpy() for x in (left, right, needed))
        texts, place = np.unique(np.concatenate([one, two]).astype(object), return_inverse=True)
        counts = character_counts(texts)
        a, b = place[: len(one)], place[len(one) :]
        lengths = counts.sum(axis=1)
        bound = 2.0 * np.minimum(counts[a], counts[b]).sum(axis=1) / np.maximum(lengths[a] + lengths[b], 1)
        for i in np.flatnonzero(bound >= least - 1e-9):
            bound[i] = SequenceMatcher(None, one[i], two[i]).ratio()
        result[at : at + len(one)] = bound
    return pd.Series(result)


def _token_pairs(tokens: Column) -> Column:
    """Keys of all pairs of distinct tokens, each in text order; a token holds no blank."""
    return F.flatten(
        F.transform(
            tokens,
            lambda a, i: F.transform(
                F.slice(tokens, i + 2, F.size(tokens)), lambda b: F.concat_ws(" ", F.least(a, b), F.greatest(a, b))
            ),
        )
    )


def _token_bits(tokens: Column) -> Column:
    """A set of tokens as 64 bits, one bit a token; tokens may share a bit."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(
        tokens, F.lit(0).cast("bigint"),
        lambda bits, t: bits.bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))),
    )


def _token_candidates(
    variants: DataFrame, titles: DataFrame, least_coverage: float, tokens_of: Callable[[Column], Column],
    least_apart: float | None = None, shape: Callable[[Column], Column] | None = None,
    bound: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Pairs (variant, norm) that share enough tokens to score, and no other pair can.

    A pair below ``least_coverage`` cannot reach the threshold, and one of which neither text holds the other
    not below ``least_apart`` (the same unless given). A pair that can shares at
    least ``m`` of a variant's ``n`` tokens, hence one of its ``n - m + 1`` rarest and two of its
    ``n - m + 2`` rarest. A rare token leads to its titles alone; common ones lead to them two
    at a time, unless one is enough. A pair comes only by the rarest tokens that it shares, so
    none comes twice, and pairs that share too few end in the join's own tasks, most of them by the bits of
    their tokens. There ``bound`` may end others: of the most tokens that a pair can share and their number in the variant, with
    ``variant_shape`` and ``norm_shape`` made by ``shape``. A title is
    normalised already; ``tokens_of`` splits a variant as its matcher does.
    """
    apart = least_coverage if least_apart is None else least_apart
    drawn = shape or (lambda c: F.lit(0))
    words = titles.select("norm", F.array_distinct(F.split("norm", " ")).alias("norm_tokens"))
    told = words.select(
        "norm", "norm_tokens", F.size("norm_tokens").alias("n_norm"), _token_bits(F.col("norm_tokens")).alias("norm_bits"),
        drawn(F.col("norm")).alias("norm_shape"),
    )
    # Tokens go to the join inside their text only.
    known = ("norm", "n_norm", "norm_bits", "norm_shape")
    postings = told.select(*known, F.explode("norm_tokens").alias("key"))
    frequency = words.select(F.explode("norm_tokens").alias("key")).groupBy("key").agg(F.count("*").alias("uses"))
    common = frequency.where(F.col("uses") > RARE_USES).select("key")
    doubles = (
        postings.join(common, "key")
        .groupBy("norm")
        .agg(*[F.first(c).alias(c) for c in known[1:]], F.collect_list("key").alias("held"))
        .select(*known, F.explode(_token_pairs(F.col("held"))).alias("key"))
    )
    asked = variants.select("variant").distinct().select(
        "variant", F.array_distinct(tokens_of(F.col("variant"))).alias("tokens")
    )
    n, m = F.size("by_use"), F.col("shares")
    least = F.when(n * F.lit(least_coverage) <= SHORT_SHARE - 1, F.lit(least_coverage)).otherwise(F.lit(apart))
    ordered = (
        asked.select("variant", F.explode("tokens").alias("key"))
        .join(frequency, "key", "left")
        .groupBy("variant")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "key"))).alias("by_use"))
        .withColumn("shares", F.greatest(F.ceil(n * least - 1e-9), F.lit(1)).cast("int"))
    )
    alone = F.filter(
        F.slice("by_use", 1, n - m + 1), lambda t: (t["uses"] > 0) & ((t["uses"] <= RARE_USES) | (m == 1))
    )
    together = F.filter(F.slice("by_use", 1, n - m + 2), lambda t: (t["uses"] > RARE_USES) & (m > 1))
    keys = F.concat(F.transform(alone, lambda t: t["key"]), _token_pairs(F.transform(together, lambda t: t["key"])))
    # The keys are spread last: what is worked out of a variant is not worked out for each of them.
    probes = ordered.select(
        "variant", "shares", F.transform("by_use", lambda t: t["key"]).alias("tokens"), keys.alias("keys")
    ).select(
        "variant", "shares", F.array_join("tokens", " ").alias("by_use"), F.size("tokens").alias("n_tokens"),
        _token_bits(F.col("tokens")).alias("bits"), drawn(F.col("variant")).alias("variant_shape"), "keys",
    )
    probes = probes.select("*", F.explode("keys").alias("key")).drop("keys")

    def led(shared: Column) -> Column:
        """Whether the key is made of the rarest tokens shared, and they are enough."""
        one, two = F.get(shared, F.lit(0)), F.get(shared, F.lit(1))
        by_two = F.concat_ws(" ", F.least(one, two), F.greatest(one, two))
        return (F.size(shared) >= m) & (F.col("key") == F.when(F.contains("key", F.lit(" ")), by_two).otherwise(one))

    # Shared tokens have shared bits; those that share one are at most as many as the variant's tokens that do.
    n = F.col("n_tokens")
    most = F.least(n, F.bit_count(F.col("bits").bitwiseAND(F.col("norm_bits"))) + n - F.bit_count("bits"))
    hopeful = most >= m
    if bound is not None:
        hopeful = hopeful & bound(most, n)
    tokens, norm_tokens = F.split("by_use", " "), F.array_distinct(F.split("norm", " "))
    met = probes.join(postings.unionByName(doubles), "key")
    met = met.where(F.when(hopeful, led(F.array_intersect(tokens, norm_tokens))).otherwise(False))
    return _shares(met.select("variant", "norm", tokens.alias("tokens"), norm_tokens.alias("norm_tokens")))


# Shared tokens from which on texts that hold one another are found by their runs of tokens: the text inside has four tokens or more.
SHORT_SHARE = 4


def _shares(pairs: DataFrame) -> DataFrame:
    """What a pair's score is made of, from its ``tokens`` and ``norm_tokens``; filters on it are not worked out before a join's own."""
    counted = computed_once(pairs, "shared", F.size(F.array_intersect("tokens", "norm_tokens")))
    shared = F.col("shared")
    return counted.select(
        "variant", "norm",
        F.size("tokens").alias("n_tokens"),
        (shared / F.greatest(F.size("tokens"), F.size("norm_tokens"))).alias("overlap"),
        (shared / F.size("tokens")).alias("coverage"),
        (F.contains("norm", F.col("variant")) | F.contains("variant", F.col("norm"))).alias("inside"),
    )


def _inside_candidates(
    variants: DataFrame, titles: DataFrame, least_coverage: float, least_apart: float, tokens_of: Callable[[Column], Column]
) -> DataFrame:
    """Pairs of which one text holds the other and that share less than ``least_apart``, but not less than ``least_coverage``.

    Variants of so few tokens that ``SHORT_SHARE`` need not be shared are left to ``_token_candidates``. The text inside
    has at least so many tokens; all but its first and last are whole in the other text, in a row. So a run of them leads there.
    """
    tokens, norm_tokens = F.array_distinct(tokens_of(F.col("variant"))), F.array_distinct(F.split("norm", " "))
    n = F.size(tokens)
    asked = variants.select("variant").distinct().where(n * F.lit(least_coverage) > SHORT_SHARE - 1)
    words = titles.select("norm").where(F.size(norm_tokens) >= SHORT_SHARE)

    def inner(c: str) -> Column:
        return bind(F.split(c, " "), lambda w: F.array_join(F.slice(w, 2, F.greatest(F.least(F.size(w) - 2, F.lit(3)), F.lit(0))), " "))

    def of_length(w: Column, k: int) -> Column:
        starts = F.slice(F.sequence(F.lit(1), F.size(w)), 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " "))

    def runs(c: str) -> Column:
        return bind(F.split(c, " "), lambda w: F.array_distinct(F.concat(of_length(w, 2), of_length(w, 3))))

    few = F.ceil(n * F.lit(least_apart) - 1e-9)
    # A variant inside a title lacks its first and last token there, and one that its matcher reads in another way, at most.
    sides = (
        (words.withColumn("key", inner("norm")), asked.withColumn("key", F.explode(runs("variant"))), "norm", "variant"),
        (asked.where(n - 3 < few).withColumn("key", inner("variant")), words.withColumn("key", F.explode(runs("norm"))), "variant", "norm"),
    )
    held = [short.join(long, "key").where(F.contains(two, F.col(one))) for short, long, one, two in sides]
    held = reduce(DataFrame.unionByName, held)
    pairs = _shares(held.select("variant", "norm", tokens.alias("tokens"), norm_tokens.alias("norm_tokens")))
    few = F.ceil(F.col("n_tokens") * F.lit(least_apart) - 1e-9) - 0.5
    shared = F.col("coverage") * F.col("n_tokens")
    return pairs.where((shared < few) & (F.col("coverage") > F.lit(least_coverage) - 1e-9))


# Characters of a normalised title, and how many of each have a bit of their own.
_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
_LEVELS = 6


def character_bits(c: Column) -> Column:
    """Four numbers with a bit for each of the first six uses of a character, the uses beyond, and the length.

    Of two texts the bits that both have, and the lesser number of uses beyond, are at least as many as the characters
    that any matching of the two can hold.
    """
    def uses(character: str) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit(character), F.lit("")))

    one = F.lit(1).cast("bigint")
    parts = []
    for at in range(0, len(_CHARACTERS), 10):
        some = [F.call_function("shiftleft", one, F.least(uses(x), F.lit(_LEVELS))) - 1 for x in _CHARACTERS[at : at + 10]]
        parts.append(reduce(Column.__add__, [F.call_function("shiftleft", b, F.lit(_LEVELS * i)) for i, b in enumerate(some)]))
    names = [f"b{i}" for i in range(len(parts))]
    return bind(
        F.struct(*[p.alias(x) for p, x in zip(parts, names, strict=True)], F.length(c).alias("length")),
        lambda s: F.struct(
            *[s[x].alias(x) for x in names],
            (s["length"] - reduce(Column.__add__, [F.bit_count(s[x]) for x in names])).alias("beyond"),
            s["length"].alias("length"),
        ),
    )


def most_matched(left: Column, right: Column) -> Column:
    """The most characters that a matching of two texts can hold, from their ``character_bits``."""
    both = [F.bit_count(left[f"b{i}"].bitwiseAND(right[f"b{i}"])) for i in range(-(-len(_CHARACTERS) // 10))]
    return reduce(Column.__add__, both) + F.least(left["beyond"], right["beyond"])


def best_with_margin(scored: DataFrame, accept: float, margin: float) -> DataFrame:
    """The best scored recipe per title, if it is good enough and clearly ahead.

    ``scored`` holds ``(title, recipe_id, score, copies)``; copies of the best title tie with it.
    A title may have many candidates: only their maximum and a count are aggregated.
    """
    best = scored.groupBy("title").agg(
        F.max("score").alias("best"), F.max_by("recipe_id", "score").alias("recipe_id")
    )
    near = (
        scored.join(best.select("title", "best"), "title")
        .where(F.col("best") - F.col("score") < margin)
        .groupBy("title")
        .agg(F.sum("copies").alias("near"))
    )
    return (
        best.where(F.col("best") >= accept)
        .join(near.where(F.col("near") == 1), "title")
        .select("title", "recipe_id", F.col("best").alias("score"))
    )


def _per_title(variants: DataFrame, pairs: DataFrame, titles: DataFrame, floor: float) -> DataFrame:
    """The best score of each title and recipe title that is no lower than ``floor``; written once, for it is read twice."""
    good = pairs.where(F.col("score") >= floor)
    scored = variants.join(good, "variant").groupBy("title", "norm").agg(F.max("score").alias("score"))
    return cut_lineage(scored.join(titles, "norm").select("title", "recipe_id", "score", "copies"))


def fuzzy_title_match(
    entries: DataFrame, dishes: DataFrame, floor: float = 0.74, accept: float = 0.81, margin: float = 0.035,
    people: Sequence[str] = (),
) -> DataFrame:
    """Titles with one clearly best recipe by string ratio, token overlap and coverage.

    Only scores above ``max(floor, accept - margin)`` can change the outcome, which bounds the
    coverage a pair needs: without full coverage the other parts give 0.54 at most.
    """
    titles = cut_lineage(_known_titles(dishes))
    variants = cut_lineage(_variants(entries, P.title_variants(F.col("title"), people)))
    least = max(floor, accept - margin)
    # Without full coverage the parts give 0.46 beside the tokens' 0.54, and 0.08 more if one text holds the other.
    coverage = max(least - 0.54, 0.0) / 0.54, min(max(least - 0.46, 0.0) / 0.54, 1.0)

    def reachable(most: Column, n: Column) -> Column:
        """Whether a pair that shares at most so many tokens can be good enough, by its characters."""
        one, two = F.col("variant_shape"), F.col("norm_shape")
        matched = most_matched(one, two)
        inside = F.when(matched >= F.least(one["length"], two["length"]), 0.08).otherwise(0.0)
        tokens = most / F.greatest(n, F.col("n_norm")) * 0.22 + most / n * 0.32 + F.when(most == n, 0.08).otherwise(0.0)
        return matched * 2.0 / (one["length"] + two["length"]) * 0.46 + tokens + inside > least - 1e-9

    pairs = _token_candidates(variants, titles, coverage[0], P.meal_tokens, coverage[1], character_bits, reachable)
    if coverage[0] > 0:
        pairs = pairs.unionByName(_inside_candidates(variants, titles, *coverage, P.meal_tokens))
    longest = F.greatest(F.length("variant") + F.length("norm"), F.lit(1))
    ceiling = 2.0 * F.least(F.length("variant"), F.length("norm")) / longest
    whole = F.col("coverage") == 1.0

    def total(ratio: Column) -> Column:
        score = ratio * 0.46 + F.col("overlap") * 0.22 + F.col("coverage") * 0.32
        score = score + F.when(F.col("inside"), 0.08).otherwise(0.0) + F.when(whole, 0.08).otherwise(0.0)
        return score - F.when((F.col("n_tokens") == 1) & (ratio < 0.7), 0.12).otherwise(0.0)

    # The ratio cannot exceed what the lengths allow; hopeless pairs never reach Python.
    hopeful = pairs.where((F.col("variant") == F.col("norm")) | (total(ceiling) > least - 1e-9))
    # The least ratio with which a pair of these parts is good enough; the penalty only lowers a score.
    needed = (F.lit(least) - (total(F.lit(1.0)) - 0.46)) / 0.46
    # Once for each pair, and not for a filter on its score as well.
    measured = computed_once(hopeful, "ratio", sequence_ratio("variant", "norm", needed))
    scored = measured.select(
        "variant", "norm", F.when(F.col("variant") == F.col("norm"), 1.0).otherwise(total(F.col("ratio"))).alias("score")
    )
    best = best_with_margin(_per_title(variants, scored, titles, floor), accept, margin)
    return best.withColumn("score", F.round("score", 4))


def client_variants(title: Column) -> Column:
    """Readings of a title as typed in the browser form."""
    raw = strip(title)
    readings = F.concat(
        F.array(
            raw,
            F.regexp_replace(raw, r"\([^)]*\)", " "),
            F.regexp_replace(raw, rf"(?i)^(?:{P.WEEKDAY})\s*[-:]?\s*", ""),
            F.regexp_replace(raw, r"(?i)^(?:breakfast|lunch|dinner)\s*[-:]?\s*", ""),
        ),
        F.regexp_extract_all(raw, F.lit(r"\(([^)]*)\)"), F.lit(1)),
    )
    return F.array_distinct(F.filter(F.transform(readings, P.browser_text), lambda v: v != ""))


def client_title_match(
    entries: DataFrame, dishes: DataFrame, floor: float = 0.8, accept: float = 0.81, margin: float = 0.035
) -> DataFrame:
    """The token-only matcher: built-in expressions throughout."""
    titles = cut_lineage(_known_titles(dishes))
    variants = cut_lineage(_variants(entries, client_variants(F.col("title"))))
    # Without full coverage tokens give 0.85 at most, and 0.15 comes only of a text that holds the other.
    coverage = max(floor - 0.15, 0.0) / 0.85, min(floor / 0.85, 1.0)

    def tokens_of(v: Column) -> Column:
        return F.split(v, " ")

    pairs = _token_candidates(variants, titles, coverage[0], tokens_of, coverage[1])
    if coverage[0] > 0:
        pairs = pairs.unionByName(_inside_candidates(variants, titles, *coverage, tokens_of))
    score = (
        F.col("overlap") * 0.5
        + F.col("coverage") * 0.35
        + F.when(F.col("inside"), 0.15).otherwise(0.0)
        + F.when(F.col("coverage") == 1.0, 0.08).otherwise(0.0)
        - F.when((F.col("n_tokens") == 1) & (F.col("coverage") < 1.0), 0.12).otherwise(0.0)
    )
    scored = pairs.select("variant", "norm", F.when(F.col("variant") == F.col("norm"), 1.0).otherwise(score).alias("score"))
    return best_with_margin(_per_title(variants, scored, titles, floor), accept, margin)


def match_titles(entries: DataFrame, dishes: DataFrame, people: Sequence[str] = ()) -> DataFrame:
    """Exact matches first; only titles without one are compared fuzzily."""
    exact = cut_lineage(exact_title_match(entries, dishes, people))
    rest = entries.join(exact, "title", "left_anti")
    return exact.withColumn("score", F.lit(1.0)).unionByName(fuzzy_title_match(rest, dishes, people=people))


def import_plans(texts: DataFrame, dishes: DataFrame, as_of_year: int, people: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Free-text plans as rows of weeks that name their dishes, and the notes of each week.

    ``texts`` is ``(file_id, text)``; ``dishes`` has ``recipe_id``, ``title`` and ``listing_order``. Entries that
    name something to cook are linked, equal titles once: to the dish of the same title, else to the one that is
    clearly nearest. Rows are ranked by weekday from the start of their week, meal and place in the file.
    """
    rows = cut_lineage(plan_rows_from_entries(plan_carry_forward(plan_lines(texts)), as_of_year))
    kept = rows.where("is_row")
    wanted = F.col("is_recipe") & (text(F.col("match_title")) != "")
    titles = kept.where(wanted).select(F.col("match_title").alias("title")).distinct()
    found = match_titles(titles, dishes, people).select(F.col("title").alias("match_title"), "recipe_id", "score")
    linked = kept.withColumn("match_title", F.when(wanted, F.col("match_title"))).join(found, "match_title", "left")
    placed = linked.withColumns(
        {
            "week_id": F.concat_ws("-", F.col("file_id").cast("string"), F.col("section_no").cast("string")),
            "row_seq": F.struct("group_at", "line_no", "slot"),
        }
    )
    return sort_plan_rows(placed).drop("row_seq", "match_title", "is_row", "note"), plan_notes(rows)


def resolve_reference(
    rows: DataFrame, dishes: DataFrame, fuzzy: bool = True, people: Sequence[str] = ()
) -> DataFrame:
    """Recipe of each row ``(row_id, value, fallback_title, explicit_id)``.

    The explicit id wins, then an id in brackets at the end of the value, then the title.
    """
    value = strip(text(F.col("value")))
    asked = rows.select(
        "row_id",
        blank_to_null(strip(text(F.col("explicit_id")))).alias("explicit"),
        blank_to_null(F.regexp_extract(value, P.RECIPE_REFERENCE, 1)).alias("bracketed"),
        F.coalesce(blank_to_null(strip(text(F.col("fallback_title")))), value).alias("title"),
    )
    ids = dishes.select(F.col("recipe_id").cast("string").alias("known"), "recipe_id")
    matched = match_titles(asked, dishes, people) if fuzzy else exact_title_match(asked, dishes, people)
    first = ids.select(F.col("known").alias("explicit"), F.col("recipe_id").alias("by_explicit"))
    second = ids.select(F.col("known").alias("bracketed"), F.col("recipe_id").alias("by_bracket"))
    third = matched.select("title", F.col("recipe_id").alias("by_title"))
    return (
        asked.join(first, "explicit", "left")
        .join(second, "bracketed", "left")
        .join(third, "title", "left")
        .select("row_id", F.coalesce("by_explicit", "by_bracket", "by_title").alias("recipe_id"))
    )


# --- shopping list and statistics ------------------------------------------------------------


def shopping_uses(plan_rows: DataFrame, dishes: DataFrame, lines: DataFrame) -> DataFrame:
    """Uses per (week, ingredient key, label, recipe).

    Each planned row of a live recipe uses every ingredient line of it once. Both sides are
    counted before they meet, so a recipe planned often or a repeated line is one joined row.
    A recipe without a usable line falls back to its stored ingredient names. All sides are dealt by recipe to
    tasks whose number grows with the lines, before a line's key and label are made.
    """
    rows = lines.count()
    plan_rows, dishes, lines = (
        sized(x.where(F.col("recipe_id").isNotNull()), rows, "recipe_id") for x in (plan_rows, dishes, lines)
    )
    planned = plan_rows.groupBy("week_id", "recipe_id").agg(
        F.count("*").alias("times")
    )
    key = index_name(F.col("canonical_name"), F.col("normalized_name"), F.col("raw"))
    keyed = (
        lines.select("recipe_id", key.alias("key"), "raw")
        .where(F.col("key") != "")
        .select("recipe_id", "key", shopping_label(F.col("raw"), F.col("key")).alias("label"))
        .groupBy("recipe_id", "key", "label")
        .agg(F.count("*").alias("lines"))
    )
    titled = dishes.select("recipe_id", F.col("title").alias("recipe_title"))
    if "ingredient_names" in dishes.columns:
        name = F.col("name")
        stored = dishes.select("recipe_id", F.explode("ingredient_names").alias("name")).where(strip(name) != "")
        stored = (
            stored.join(keyed.select("recipe_id"), "recipe_id", "left_anti")
            .select("recipe_id", casefold(strip(name)).alias("key"), strip(name).alias("label"))
            .groupBy("recipe_id", "key", "label")
            .agg(F.count("*").alias("lines"))
        )
        keyed = keyed.union(stored)
    return (
        planned.join(titled, "recipe_id")
        .join(keyed, "recipe_id")
        .select("week_id", "key", "label", "recipe_id", "recipe_title", (F.col("times") * F.col("lines")).alias("uses"))
    )


def shopping_sources(uses: DataFrame) -> DataFrame:
    """One row per (week, item, recipe) with its use count and label ``Title xN``."""
    per_recipe = uses.groupBy("week_id", "key", "recipe_id", "recipe_title").agg(F.sum("uses").alias("use_count"))
    times = F.when(F.col("use_count") > 1, F.concat(F.lit(" x"), F.col("use_count").cast("string"))).otherwise("")
    return per_recipe.withColumn("source_label", F.concat("recipe_title", times))


def shopping_items(uses: DataFrame) -> DataFrame:
    """One row per (week, item): display name, total uses, number of sources, first source.

    The name is the written label when all lines agree on one, else the key.
    """
    totals = uses.groupBy("week_id", "key").agg(
        F.sum("uses").alias("total_uses"),
        F.min("label").alias("least"),
        F.max("label").alias("most"),
    )
    sources = shopping_sources(uses).groupBy("week_id", "key").agg(
        F.count("*").alias("source_count"),
        F.min(F.struct(casefold(F.col("recipe_title")), "recipe_id", "source_label")).alias("first"),
    )
    return totals.join(sources, ["week_id", "key"]).select(
        "week_id",
        "key",
        F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.col("key")).alias("name"),
        "total_uses",
        "source_count",
        F.col("first.source_label").alias("first_source"),
    )


def shopping_list(plan_rows: DataFrame, dishes: DataFrame, lines: DataFrame) -> DataFrame:
    """Shopping items of each week in order of name; equal names go by their first source.

    Sources stay rows (``shopping_sources``): an item that a third of all dishes use never
    becomes one list.
    """
    items = shopping_items(shopping_uses(plan_rows, dishes, lines))
    order = [casefold(F.col("name")), casefold(F.col("first_source")), F.col("key")]
    return ranked(items, order, ["week_id"])


def plan_stats(plan_rows: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Planned, linked and completed rows per week and, as week ``all``, in total."""
    has_title = F.col("title") != ""
    weekly = plan_rows.groupBy("week_id").agg(
        F.count_if(has_title).alias("planned"),
        F.count_if(F.col("recipe_id").isNotNull()).alias("linked"),
        F.count_if(F.col("completed") & has_title).alias("completed"),
    )
    if items is None:
        weekly = weekly.withColumn("shopping_items", F.lit(0).cast("bigint"))
    else:
        counted = items.groupBy("week_id").agg(F.count("*").alias("shopping_items"))
        weekly = weekly.join(counted, "week_id", "left").withColumn(
            "shopping_items", F.coalesce("shopping_items", F.lit(0).cast("bigint"))
        )
    names = ("planned", "linked", "completed", "shopping_items")
    total = weekly.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return weekly.unionByName(total.withColumn("week_id", F.lit("all")))


def recipe_options(dishes: DataFrame) -> DataFrame:
    """Labels ``Title - Cookbook [id]`` in order of title, then cookbook."""
    return dishes.select(
        "recipe_id",
        P.recipe_option(F.col("title"), F.col("cookbook_title"), F.col("recipe_id")).alias("label"),
        casefold(F.col("title")).alias("title_key"),
        casefold(F.col("cookbook_title")).alias("cookbook_key"),
    ).orderBy("title_key", "cookbook_key", "recipe_id")
