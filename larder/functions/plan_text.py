"""Plan text: titles, weekdays, week dates, line tests. Columns in, Columns out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import bind, WORD_END, WORD_START, WS, WS_RUN, blank_to_null, squash, strip, strip_chars, text

# Fixed values.
STOPWORDS = ("a", "an", "and", "for", "fresh", "of", "or", "style", "the", "to", "with")
TOKEN_ALIASES = {"dahl": "daal", "dal": "daal"}
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MEALS = ("Breakfast", "Lunch", "Dinner")
MEAL_PREFIXES = ("breakfast", "lunch", "lunches", "dinner", "dinners")
MEAL_GROUP_TITLES = (
    "meal", "meals", "dinner", "dinners", "lunch", "lunches", "snacks", "dinner recipes",
)
NON_RECIPE_HINTS = (
    "out", "leftover", "leftovers", "snack", "snacks", "soup",
)
NOT_A_TITLE = (
    "friday", "saturday", "sunday", "monday", "tuesday", "wednesday", "thursday",
)
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
)
MONTH = (
    r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|"
    r"jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
DATE_HEADING = rf"(?i)^(?:week(?:\s+of)?\s+)?\d{{1,2}}\s+(?:{MONTH})(?:\s+\d{{2,4}})?$"
WEEK_HEADING = (
    rf"(?i)^week(?:\s+\d{{1,2}})?(?:\s+of)?\s+(?:\d{{1,2}}\s+)?(?:{MONTH})(?:\s+\d{{2,4}})?$"
)
CHECKBOX = r"^-\s*\[([ xX])\]\s*(.+)$"
BULLET = r"^(?:-|•|\*)\s*(.+)$"
URL = r"https?://\S+"
RECIPE_REFERENCE = r"\[([^\[\]]+)\]\s*$"
WEEKDAY = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
SCHEDULE_GAP = r"\t+|\s{2,}"


def meal_tokens(c: Column, links_first: bool = True) -> Column:
    """Search tokens of a title, in order, duplicates kept.

    The browser form spells out ``&`` before it drops links, so an ``&`` ends a link there.
    """
    value = F.lower(text(c))
    if not links_first:
        value = F.replace(value, F.lit("&"), F.lit(" and "))
    value = F.replace(F.regexp_replace(value, URL, " "), F.lit("&"), F.lit(" and "))
    tokens = F.split(F.trim(F.regexp_replace(value, "[^a-z0-9]+", " ")), " ")
    kept = F.filter(tokens, lambda t: (t != "") & ~t.isin(*STOPWORDS))

    def singular(t: Column) -> Column:
        for word, alias in TOKEN_ALIASES.items():
            t = F.when(t == word, alias).otherwise(t)
        one = F.regexp_replace(F.regexp_replace(t, "^(..+)ies$", "$1y"), "^(.{3,}[^su])s$", "$1")
        return F.when(F.endswith(t, F.lit("s")), one).otherwise(t)

    return F.transform(kept, singular)


def meal_text(c: Column) -> Column:
    return F.array_join(meal_tokens(c), " ")


def browser_text(c: Column) -> Column:
    """As ``meal_text``, in the order in which the browser form normalises."""
    return F.array_join(meal_tokens(c, links_first=False), " ")


def display_title(c: Column) -> Column:
    return squash(F.regexp_replace(strip_chars(text(c), " -:\t"), r"(?s)^\((.*)\)$", "$1"))


def clean_entry(c: Column) -> Column:
    return strip_chars(F.regexp_replace(text(c), WS_RUN, " "), " -:\t")


def trim_heading(c: Column) -> Column:
    return strip(F.rtrim(strip(text(c)), F.lit(":")))


def link_label(url: Column) -> Column:
    label = F.rtrim(F.regexp_replace(url, "^https?://", ""), F.lit("/"))
    return F.regexp_replace(label, r"(?s)^(.{61}).{4,}$", "$1...")


def slot_title(c: Column) -> Column:
    title = F.regexp_replace(display_title(c), rf"(?i)^(?:{WEEKDAY})\s*[-:]?\s*", "")
    return display_title(F.regexp_replace(title, rf"(?i)\((?:{WEEKDAY})[^)]*\)", ""))


def _known_label(c: Column, labels: tuple[str, ...]) -> Column:
    known = [label.lower() for label in labels]
    return bind(
        display_title(c), lambda t: F.when(F.lower(t).isin(*known), F.initcap(t)).otherwise(t)
    )


def weekday_label(c: Column) -> Column:
    return _known_label(c, WEEKDAYS)


def meal_label(c: Column) -> Column:
    return _known_label(c, MEALS)


def weekday_in(c: Column) -> Column:
    """First weekday named in a text, as its label; empty when none is."""
    return F.initcap(F.regexp_extract(text(c), f"(?i){WORD_START}({WEEKDAY}){WORD_END}", 1))


def starts_with_weekday(c: Column) -> Column:
    return F.rlike(c, F.lit(f"(?i)^(?:{WEEKDAY}){WORD_END}"))


def title_variants(c: Column, people: Sequence[str] = ()) -> Column:
    """Distinct normalised readings of a planned title, non-empty, in text order.

    An aside that says that one of ``people`` (plain lower-case names) is out is no reading.
    """
    unread = "|".join([*NOT_A_TITLE, *(f"{name} out" for name in people)])
    return bind(display_title(c), lambda base: _variants_of(base, unread))


def _variants_of(base: Column, unread: str) -> Column:
    after_day = F.regexp_extract(base, r"^[^-:]+[-:]\s*(.+)$", 1)
    asides = F.filter(
        F.regexp_extract_all(base, F.lit(r"\(([^)]*)\)"), F.lit(1)),
        lambda p: ~starts_with_weekday(p)
        & ~F.rlike(meal_text(p), F.lit(unread)),
    )
    readings = F.concat(
        F.array(
            base,
            F.regexp_replace(base, r"\([^)]*\)", ""),
            F.regexp_replace(base, rf"(?i)^(?:{WEEKDAY})\s+", ""),
            F.when(starts_with_weekday(base), after_day).otherwise(""),
            F.regexp_extract(base, f"(?i)^(?:{'|'.join(MEAL_PREFIXES)})( .*)$", 1),
        ),
        asides,
    )
    return F.array_sort(F.array_distinct(F.filter(F.transform(readings, meal_text), lambda v: v != "")))


def looks_like_recipe(c: Column) -> Column:
    """False for eating out, leftovers, snacks and schedule headers."""
    return bind(meal_text(c), _names_a_dish)


def _names_a_dish(value: Column) -> Column:
    return ~(
        value.isin("", *NON_RECIPE_HINTS)
        | F.endswith(value, F.lit(" out"))
        | F.startswith(value, F.lit("out "))
        | F.endswith(value, F.lit(" leftover"))
        | F.endswith(value, F.lit(" leftovers"))
        | F.startswith(value, F.lit("day lunch dinner"))
    )


def week_start(c: Column, as_of_year: int) -> Column:
    """ISO date of a week heading, else empty. Dates without a year fall in ``as_of_year``."""
    return bind(display_title(c), lambda cleaned: _start_of(cleaned, as_of_year))


def _start_of(cleaned: Column, as_of_year: int) -> Column:
    rest = strip(F.regexp_replace(cleaned, rf"(?i)^week(?:{WS}+\d+)?(?:{WS}+of)?{WS}+", ""))
    names = "|".join([*MONTHS, *dict.fromkeys(m[:3] for m in MONTHS)])
    pattern = rf"(?i)^(\d{{1,2}}) ({names})(?: (\d{{4}}|\d{{2}}))?$"
    found = bind(rest, lambda r: _day_month_year(r, pattern, as_of_year))
    iso = F.when(F.rlike(cleaned, F.lit(r"^\d{4}-\d{2}-\d{2}$")), cleaned).otherwise(found)
    return text(iso.try_cast("date").cast("string"))


def _day_month_year(rest: Column, pattern: str, as_of_year: int) -> Column:
    day = F.lpad(F.regexp_extract(rest, pattern, 1), 2, "0")
    name = F.lower(F.substring(F.regexp_extract(rest, pattern, 2), 1, 3))
    month = F.lpad(
        F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), name).cast("string"), 2, "0"
    )
    given = F.regexp_extract(rest, pattern, 3)
    year = (
        F.when(given == "", F.lit(str(as_of_year)))
        .when(F.length(given) == 4, given)
        .when(given >= "69", F.concat(F.lit("19"), given))
        .otherwise(F.concat(F.lit("20"), given))
    )
    # Without a year the day must exist in a common year: 29 February does not.
    checked = F.when((given == "") & (month == "02") & (day == "29"), None).otherwise(
        F.concat_ws("-", year, month, day)
    )
    return F.when(F.rlike(rest, F.lit(pattern)), checked)


def week_title(start_on: Column, legacy_title: Column) -> Column:
    start = start_on.try_cast("date")
    dated = F.concat(
        F.lit("Week of "), F.dayofmonth(start).cast("string"), F.lit(" "), F.date_format(start, "MMMM yyyy")
    )
    return F.coalesce(
        dated, blank_to_null(display_title(start_on)), blank_to_null(text(legacy_title)), F.lit("Undated Week")
    )


def is_section_heading(c: Column) -> Column:
    return (
        F.rlike(c, F.lit(DATE_HEADING))
        | F.rlike(c, F.lit(WEEK_HEADING))
        | F.startswith(F.lower(c), F.lit("week "))
    )


def is_group_heading(c: Column) -> Column:
    return F.lower(trim_heading(c)).isin(*MEAL_GROUP_TITLES)


def schedule_parts(c: Column) -> Column:
    """``[day, lunch, dinner]`` of a schedule row, NULL for any other line."""
    found = F.filter(F.transform(F.split(c, SCHEDULE_GAP), strip), lambda p: p != "")
    return bind(
        found,
        lambda parts: F.when(
            (F.size(parts) >= 3) & starts_with_weekday(text(F.get(parts, F.lit(0)))), F.slice(parts, 1, 3)
        ),
    )


def build_entry(body: Column, complete: Column | None = None, day: Column | None = None) -> Column:
    """Title, link and recipe test of one written entry."""
    return bind(clean_entry(body), lambda cleaned: _cleaned_entry(cleaned, body, complete, day))


def _cleaned_entry(cleaned: Column, body: Column, complete: Column | None, day: Column | None) -> Column:
    def without_link(c: Column) -> Column:
        label = link_label(F.regexp_extract(c, URL, 0))
        bare = clean_entry(F.regexp_replace(c, URL, ""))
        return F.when(~F.rlike(c, F.lit(URL)), c).otherwise(
            bind(bare, lambda b: F.when(b == "", label).otherwise(b))
        )

    def before_like(title: Column) -> Column:
        cut = clean_entry(F.regexp_extract(title, rf"(?is)^(.*?){WS}like{WS}", 1))
        return F.when(F.contains(F.lower(title), F.lit(" like ")), cut).otherwise(title)

    shown = display_title(bind(without_link(cleaned), before_like))
    return bind(
        shown,
        lambda title: F.struct(
            title.alias("title"),
            body.alias("raw_text"),
            looks_like_recipe(title).alias("is_recipe"),
            (F.lit(None).cast("boolean") if complete is None else complete).alias("is_complete"),
            (F.lit(None).cast("string") if day is None else day).alias("day"),
            blank_to_null(F.regexp_extract(cleaned, URL, 0)).alias("external_url"),
        ),
    )


def bulleted_entry(c: Column) -> Column:
    """Entry of a checkbox or bullet line, NULL for any other line."""
    state = F.regexp_extract(c, CHECKBOX, 1)
    body = F.coalesce(
        blank_to_null(F.regexp_extract(c, CHECKBOX, 2)), blank_to_null(F.regexp_extract(c, BULLET, 1))
    )
    complete = bind(state, lambda s: F.when(s != "", F.lower(s) == "x"))
    return bind(body, lambda b: F.when(b.isNotNull(), build_entry(b, complete)))


def group_meal(c: Column) -> Column:
    lowered = F.lower(strip(c))
    return (
        F.when(F.contains(lowered, F.lit("breakfast")), "Breakfast")
        .when(F.contains(lowered, F.lit("lunch")), "Lunch")
        .otherwise("Dinner")
    )


def infer_day(day: Column, raw_text: Column, title: Column) -> Column:
    found = [blank_to_null(weekday_in(c)) for c in (day, raw_text, title)]
    return F.coalesce(*found, F.lit(""))


def infer_meal(raw_text: Column, title: Column, default_meal: Column) -> Column:
    both = F.lower(F.concat_ws(" ", blank_to_null(raw_text), blank_to_null(title)))

    def has(word: str) -> Column:
        return F.contains(both, F.lit(word))

    return (
        F.when(has("breakfast"), "Breakfast")
        .when(has("lunch"), "Lunch")
        .when(has("night") | has("dinner"), "Dinner")
        .otherwise(meal_label(default_meal))
    )


def recipe_option(title: Column, cookbook_title: Column, recipe_id: Column) -> Column:
    return F.concat(title, F.lit(" - "), cookbook_title, F.lit(" ["), recipe_id.cast("string"), F.lit("]"))
