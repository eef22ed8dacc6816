"""Recipe metadata: labelled lines, merging, page view. Columns in, Columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import bind, WORD_END, WORD_START, blank_to_null, casefold, squash, strip, text, title_case

# Line prefixes that carry metadata, in the order they are tried.
METADATA_PREFIXES = {
    "serves": "serves",
    "makes": "makes",
    "yield": "yield",
    "prep time": "prep_time",
    "cook time": "cook_time",
    "chilling time": "chilling_time",
    "total time": "total_time",
}
# How lines of a recipe are told apart.
INGREDIENT_LINE = (
    r"(?i)^\s*(?:[-*•]\s+)?(?:\d+(?:[./]\d+)?(?:g|kg|ml|l|oz|lb|lbs|cm)?|\d+/\d+|[¼½¾⅓⅔⅛]|"
    r"one|two|three|four|five)" + WORD_END
)
MEASUREMENT = (
    r"(?i)(?:^|[^\p{L}\p{N}_]|\d)(?:cup|cups|tbsp|tsp|teaspoon|teaspoons|tablespoon|tablespoons|"
    r"g|kg|ml|l|oz|lb|lbs)" + WORD_END
)
# The same for Java alone: a character before a unit is told by one class, most letters by two comparisons.
JAVA_MEASUREMENT = (
    r"(?:[\x00-@\[-`{-\x{10ffff}&&[[^\p{L}\p{N}_]0-9]]|^)"
    r"(?i:cups?|tbsp|tsp|teaspoons?|tablespoons?|k?g|ml|l|oz|lbs?)" + WORD_END
)
METHOD_STEP = r"(?i)^(?:step\s*\d+|\d+[.)])\s*"
NOT_INGREDIENT_OPENERS = ("for the ", "for ", "to serve", "serve with")
PAYLOAD_KEYS = ("intro", "serves", "makes", "yield", "prep_time", "cook_time", "total_time")
PAGE_LABELS = {
    "active_time": "Active Time",
    "author": "Author",
    "cook_time": "Cook Time",
    "description": "Description",
    "headnote": "Headnote",
    "introduction": "Introduction",
    "makes": "Makes",
    "prep_time": "Prep Time",
    "preparation_notes": "Notes",
    "published_at": "Published",
    "serves": "Serves",
    "subtitle": "Subtitle",
    "total_time": "Total Time",
    "updated_at": "Updated",
    "yield": "Yield",
}
PAGE_PRIORITY = ("author", "published_at", "updated_at", "yield", "serves", "makes")
PAGE_TIMING = {"total_time": "Total", "prep_time": "Prep", "cook_time": "Cook"}
PAGE_TEXT_BLOCKS = ("description", "headnote", "introduction", "subtitle")


def starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.startswith(c, F.lit(prefix))
    return hit


def metadata_line(c: Column) -> Column:
    """``struct(key, value)`` of a labelled line such as ``Serves: 4``; NULL for other lines.

    A value that is empty falls back to the whole line.
    """
    return bind(squash(text(c)), lambda line: bind(F.lower(line), lambda lowered: labelled(line, lowered)))


def labelled(line: Column, lowered: Column) -> Column:
    """``metadata_line`` of a squashed line, given in lower case too."""
    found = F.lit(None).cast("struct<key:string,value:string>")
    for prefix, key in reversed(METADATA_PREFIXES.items()):
        value = strip(F.ltrim(F.substr(line, F.lit(len(prefix) + 1)), F.lit(" :.-")))
        found = F.when(
            F.startswith(lowered, F.lit(prefix)),
            F.struct(F.lit(key).alias("key"), F.coalesce(blank_to_null(value), line).alias("value")),
        ).otherwise(found)
    return found


def is_measured(c: Column) -> Column:
    return F.rlike(c, F.lit(INGREDIENT_LINE)) | F.rlike(c, F.lit(JAVA_MEASUREMENT))


def is_ingredient_line(c: Column) -> Column:
    return bind(squash(text(c)), lambda line: bind(F.lower(line), lambda lowered: ingredient_like(line, lowered)))


def ingredient_like(line: Column, lowered: Column) -> Column:
    """``is_ingredient_line`` of a squashed line, given in lower case too.

    No opener has a sharp s or what it folds to, so lower case does for them.
    """
    return (line != "") & ~starts_with_any(lowered, (*METADATA_PREFIXES, *NOT_INGREDIENT_OPENERS)) & is_measured(line)


def embedding_text(title: Column, ingredients: Column, method_steps: Column) -> Column:
    """Text that is embedded for a recipe. ``ingredients`` is the array of stored structs."""
    names = F.transform(
        ingredients,
        lambda i: F.coalesce(
            blank_to_null(i["canonical_name"]), blank_to_null(i["normalized_name"]), text(i["raw"])
        ),
    )
    return strip(
        F.concat(
            title,
            F.lit("\nIngredients: "),
            F.array_join(names, ", "),
            F.lit("\nMethod: "),
            F.array_join(method_steps, " "),
        )
    )


def _present(c: Column) -> Column:
    return F.map_filter(
        F.coalesce(c, F.create_map().cast("map<string,string>")),
        lambda _k, v: v.isNotNull() & ~v.isin("", "[]", "{}"),
    )


def merge_metadata(payload: Column, section: Column) -> Column:
    """Overlay the payload's values with the section's non-empty ones.

    Both are ``map<string,string>``; lists are held as JSON text.
    """
    kept, over = _present(F.transform_values(payload, lambda _k, v: strip(v))), _present(section)
    return F.map_concat(F.map_filter(kept, lambda k, _v: ~F.map_contains_key(over, k)), over)


def paragraphs(c: Column) -> Column:
    value = strip(F.regexp_replace(text(c), "\r\n?", "\n"))
    parts = F.filter(
        F.transform(
            F.split(value, r"\n\s*\n+"), lambda p: strip(F.regexp_replace(p, "[ \t]+", " "))
        ),
        lambda p: p != "",
    )
    compact = squash(value)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array_compact(F.array(blank_to_null(compact))))


def list_items(c: Column) -> Column:
    items = F.coalesce(c, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(items, lambda x: squash(text(x))), lambda x: x != ""))


def page_label(key: Column) -> Column:
    known = F.create_map(*(F.lit(v) for pair in PAGE_LABELS.items() for v in pair))
    return F.coalesce(F.element_at(known, key), title_case(strip(F.translate(key, "_", " "))))


def recipe_page(entries: Column, title: Column, excerpt: Column) -> Column:
    """Ordered blocks of a recipe page.

    ``entries`` is the metadata in stored order, ``array<struct<key, text, items, sections>>``
    with one of the three values set. The result is an array of
    ``struct<block, heading, lines>`` with block ``summary``, ``intro``, ``text``, ``list`` or
    ``section``.
    """
    line_type = "array<struct<block:string,heading:string,lines:array<string>>>"

    def block(kind: str, heading: Column, lines: Column) -> Column:
        return F.struct(F.lit(kind).alias("block"), heading.alias("heading"), lines.alias("lines"))

    def entry(key: str) -> Column:
        return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))

    def scalar(key: str) -> Column:
        return blank_to_null(squash(text(entry(key)["text"])))

    def optional(kind: str, heading: Column, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, block(kind, heading, lines))

    summary = [
        F.when(scalar(k).isNotNull(), block("summary", F.lit(PAGE_LABELS[k]), F.array(scalar(k))))
        for k in PAGE_PRIORITY
    ]
    timing = F.concat_ws(
        " · ", *[F.concat(F.lit(f"{label} "), scalar(k)) for k, label in PAGE_TIMING.items()]
    )
    summary.append(F.when(timing != "", block("summary", F.lit("Timing"), F.array(timing))))

    opening = paragraphs(
        F.coalesce(*[blank_to_null(text(entry(k)["text"])) for k in ("intro", "introduction", "headnote")], F.lit(""))
    )
    shown = squash(text(excerpt))
    fallback = F.when((shown != "") & (casefold(shown) != casefold(strip(title))), F.array(shown)).otherwise(
        F.array().cast("array<string>")
    )
    remarks = list_items(entry("preparation_notes")["items"])
    extras = F.filter(
        F.transform(
            F.coalesce(
                entry("supplemental_sections")["sections"],
                F.array().cast("array<struct<heading:string,lines:array<string>>>"),
            ),
            lambda s: block("section", squash(text(s["heading"])), list_items(s["lines"])),
        ),
        lambda s: (s["heading"] != "") & (F.size(s["lines"]) > 0),
    )

    def leftover(e: Column) -> Column:
        value = squash(text(e["text"]))
        texts = paragraphs(e["text"])
        items = list_items(e["items"])
        return (
            F.when(e["key"].isin(*PAGE_TEXT_BLOCKS) & (F.size(texts) > 0), block("text", page_label(e["key"]), texts))
            .when(value != "", block("summary", page_label(e["key"]), F.array(value)))
            .when(F.size(items) > 0, block("list", page_label(e["key"]), items))
        )

    def page(intro: Column, notes: Column, sections: Column) -> Column:
        has_intro = F.size(intro) > 0
        head = F.array_compact(F.array(
            F.when(has_intro, block("intro", F.lit("Introduction"), intro)).otherwise(
                optional("intro", F.lit("Excerpt"), fallback)
            )
        ))
        def unused(e: Column) -> Column:
            used = e["key"].isin(*PAGE_PRIORITY, *PAGE_TIMING) & (squash(text(e["text"])) != "")
            used = used | (has_intro & e["key"].isin("intro", "introduction", "headnote"))
            used = used | ((e["key"] == "preparation_notes") & (F.size(notes) > 0))
            return ~(used | ((e["key"] == "supplemental_sections") & (F.size(sections) > 0)))

        rest = F.array_compact(F.transform(F.filter(entries, unused), leftover))

        def blocks(rest: Column) -> Column:
            def of(kind: str) -> Column:
                return F.filter(rest, lambda b: b["block"] == kind)

            return F.concat(
                F.array_compact(F.array(*summary)),
                of("summary"),
                head,
                of("text"),
                F.array_compact(F.array(optional("list", F.lit("Notes"), notes))),
                of("list"),
                sections,
            ).cast(line_type)

        return bind(rest, blocks)

    return bind(opening, lambda i: bind(remarks, lambda n: bind(extras, lambda s: page(i, n, s))))
