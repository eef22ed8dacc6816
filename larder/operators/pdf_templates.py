"""Recipe PDFs of four sources, read from positioned text blocks by each source's layout.

A file is one row ``(file_id, file_name, cookbook_title, page_width, page_count, blocks[, words])``
with ``blocks`` an ``array<struct<page, x0, y0, text>>``; everything happens inside that row. A
file that does not fit its layout gets a ``reason`` instead of stopping the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.ingredients import ingredient_payload, source_ingredient_name
from larder.functions.metadata import starts_with_any
from larder.functions.text import bind, blank_to_null, source_file_title, squash, strip, text, title_case, word_count
from larder.operators.documents import no_texts, split_at
from larder.session import computed_once

MANY = 1000000000
SECTIONS = "array<struct<heading:string,lines:array<string>>>"

# Marks and patterns of the layouts.
NYT_EXCLUDED = (
    "Private Notes", "Leave a Private Comment", "Ratings", "Rating (", "What would you rate this recipe",
    "Be the first to rate this recipe", "Have you cooked this",
)
NYT_CREDITS = ("By ", "Published ", "Updated ")
NYT_HEADER = ("Total Time ", "Prep Time ", "Cook Time ", "Yield:")
NUMBERED_STEP = r"(?i)^Step\s+\d+$"
JAMIE_INGREDIENT = (
    r"(?i)^(?:optional:|\d+\s*x\s*\d+|\d|[¼½¾⅓⅔⅛]|(?:one|two|three|four|five|a|an)(?:$|[^\p{L}\p{N}_]))"
)
JAMIE_INLINE_STEP = r"^([A-Z][A-Z0-9 &/'().-]+:?)\s+(\d+)$"
JAMIE_UPPER = r"^[A-Z][A-Z0-9 &/'().-]+:?$"
JAMIE_TIME = r"(?i)(?:^|[^\p{L}\p{N}_])\d+\s*(?:mins?|minutes?|hours?)(?:$|[^\p{L}\p{N}_])"
JAMIE_MAKES = r"(?i)^(?:MAKES|SERVES)\s+(.+)$"
JAMIE_MAKES_ANYWHERE = r"(?i)^(.*?)(?:^|[^\p{L}\p{N}_])(?:MAKES|SERVES)\s+(.+)$"
BBC_MAKES = r"^(Makes\s+.+?)\s+([A-Z][A-Za-z -]+)$"
BBC_TIMES = r"(?i)^Prep:\s*(.+?)\s+Cook:\s*(.+)$"
BBC_INGREDIENT = (
    r"(?i)^(?:\d|\d+\s*/\s*\d+|[¼½¾⅓⅔⅛]|(?:pinch|few|small|medium|large)(?:$|[^\p{L}\p{N}_]))"
)
BBC_NOT_CONTENT = ("Ingredients", "Method", "Try our app")
WAITROSE_LABELS = {
    "serves": r"(?i)^Serves\s+(.+)$",
    "course": r"(?i)^Course\s+(.+)$",
    "prep_time": r"(?i)^Prepare\s+(.+)$",
    "cook_time": r"(?i)^Cook\s+(.+)$",
    "total_time": r"(?i)^Total time\s+(.+)$",
}

# Why a file is rejected.
NYT_REASON = "NYTimes PDF parser could not find both ingredients and preparation steps."
JAMIE = "upload does not match the Jamie Oliver PDF template: expected "
JAMIE_EMPTY = "upload is empty or unreadable as a Jamie Oliver recipe PDF template."
BBC = "upload does not match the BBC Good Food PDF template: expected "
BBC_EMPTY = "upload is empty or unreadable as a BBC Good Food recipe PDF template."
WAITROSE = "upload does not match the Waitrose PDF template: expected "


# --- arrays of blocks ------------------------------------------------------------------------


def ordered_blocks(blocks: Column) -> Column:
    """Blocks with squashed text in order of page, y0 and x0; empty ones dropped."""
    keyed = F.transform(
        blocks,
        lambda b, i: F.struct(
            b["page"].alias("page"), b["y0"].alias("y0"), b["x0"].alias("x0"), i.alias("at"), squash(b["text"]).alias("text")
        ),
    )
    return F.array_sort(F.filter(keyed, lambda b: b["text"] != ""))


def _first(blocks: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(blocks, test), F.lit(0))


def _last(values: Column) -> Column:
    return F.get(values, F.size(values) - 1)


def _place(blocks: Column, test: Callable[[Column], Column]) -> Column:
    return F.array_min(F.array_compact(F.transform(blocks, lambda b, i: F.when(test(b), i))))


def _after(blocks: Column, test: Callable[[Column], Column]) -> Column:
    """Blocks behind the first that fits; none when none does."""
    def behind(a: Column) -> Column:
        return bind(_place(a, test), lambda at: F.when(at.isNotNull(), F.slice(a, at + 2, MANY)).otherwise(F.slice(a, 1, 0)))

    return bind(blocks, behind)


def _before(blocks: Column, test: Callable[[Column], Column]) -> Column:
    return bind(blocks, lambda a: F.slice(a, 1, F.coalesce(_place(a, test), F.size(a))))


def _texts(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: b["text"])


def _says(word: str) -> Callable[[Column], Column]:
    """Whether a block is the word, in any case. Texts of another length are not lowered."""
    return lambda b: (F.length(b["text"]) == len(word)) & (F.lower(b["text"]) == word)


def _without_prefix(c: Column, prefix: str) -> Column:
    return strip(F.substr(c, F.lit(len(prefix) + 1)))


def display_text(c: Column) -> Column:
    """Text in capitals is shown in title case."""
    line = squash(c)
    shouted = F.rlike(line, F.lit(r"\p{Lu}")) & ~F.rlike(line, F.lit(r"\p{Ll}"))
    return F.when(shouted, title_case(line)).otherwise(line)


def _join_wrapped(lines: Column, start: str) -> Column:
    """Ingredient lines with their wrapped parts joined."""
    runs = split_at(lines, lambda x, i: (i == 0) | F.rlike(x, F.lit(start)))
    return F.transform(runs, lambda run: F.array_join(run, " "))


def _sections(runs: Column) -> Column:
    """Supplemental sections of runs that begin with their heading block; empty ones dropped."""
    made = F.transform(
        runs,
        lambda run: F.struct(
            title_case(F.get(run, F.lit(0))["text"]).alias("heading"),
            F.array_distinct(_texts(F.slice(run, 2, MANY))).alias("lines"),
        ),
    )
    return F.filter(made, lambda s: F.size(s["lines"]) > 0).cast(SECTIONS)


def _none() -> Column:
    return F.array().cast(SECTIONS)


def row_cluster(blocks: Column, tolerance: float = 10.0) -> Column:
    """Rows of blocks: a block joins while its y0 is within reach of the row's first, on one page.

    Input is in page and y0 order; each row comes out in x0 order.
    """
    start = F.struct(F.lit(0).alias("row"), F.lit(None).cast("long").alias("page"), F.lit(0.0).alias("y"), F.array().cast("array<int>").alias("rows"))

    def step(acc: Column, b: Column) -> Column:
        same = (acc["page"] == b["page"]) & (F.abs(b["y0"] - acc["y"]) <= tolerance)

        def moved(joins: Column) -> Column:
            row = F.when(joins, acc["row"]).otherwise(acc["row"] + 1).cast("int")
            return F.struct(
                row.alias("row"), b["page"].cast("long").alias("page"),
                F.when(joins, F.least(acc["y"], b["y0"])).otherwise(b["y0"]).cast("double").alias("y"),
                F.array_append(acc["rows"], row).alias("rows"),
            )

        return bind(F.coalesce(same, F.lit(False)), moved)

    numbers = F.aggregate(blocks, start, step, lambda acc: acc["rows"])

    def rows(n: Column) -> Column:
        runs = split_at(F.zip_with(blocks, n, lambda b, r: F.struct(b.alias("b"), r.alias("r"))), lambda x, i: (i == 0) | (x["r"] != F.get(n, F.greatest(i - 1, F.lit(0)))))
        by_x = F.transform(runs, lambda run: F.array_sort(F.transform(run, lambda x: F.struct(x["b"]["x0"].alias("x0"), x["b"]["at"].alias("at"), x["b"]["text"].alias("text")))))
        return by_x

    return bind(numbers, rows)


def _result(
    files: DataFrame, source: str, parsed: Column, metadata: dict[str, Column], reason: Column
) -> DataFrame:
    """Common output: title, fields, drafts' ingredient structs and the reject reason."""
    rows = computed_once(files, "p", parsed)
    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in metadata.items()]),
        lambda e: text(e["value"]) != "",
    )
    named = F.transform(
        "p.ingredients",
        lambda raw: ingredient_payload(raw, F.coalesce(blank_to_null(source_ingredient_name(raw, source)), raw)),
    )
    return rows.select(
        "file_id",
        F.coalesce(blank_to_null(F.col("p.title")), source_file_title(F.col("file_name"), F.col("cookbook_title"), source)).alias("title"),
        F.map_from_entries(entries).alias("metadata"),
        named.alias("ingredients"),
        F.col("p.steps").alias("method_steps"),
        F.col("p.notes").alias("preparation_notes"),
        F.col("p.sections").alias("supplemental_sections"),
        reason.alias("reason"),
    )


# --- layouts ---------------------------------------------------------------------------------


def pdf_nytimes(files: DataFrame) -> DataFrame:
    """Two columns split between the INGREDIENTS and PREPARATION headings."""

    def excluded(b: Column) -> Column:
        return starts_with_any(b["text"], NYT_EXCLUDED)

    def is_heading(b: Column) -> Column:
        return F.rlike(b["text"], F.lit("[A-Za-z]")) & ~F.rlike(b["text"], F.lit("[a-z]")) & (word_count(b["text"]) <= 8)

    def read(blocks: Column, split: Column) -> Column:
        first_page = F.filter(blocks, lambda b: b["page"] == 1)

        def last_with(prefix: str) -> Column:
            return text(_last(F.transform(F.filter(first_page, lambda b: F.startswith(b["text"], F.lit(prefix))), lambda b: _without_prefix(b["text"], prefix))))

        title = _first(first_page, lambda b: (b["y0"] < 95) & ~starts_with_any(b["text"], NYT_CREDITS))["text"]
        author = _without_prefix(text(_first(first_page, lambda b: F.startswith(b["text"], F.lit("By ")))["text"]), "By ")
        left = F.filter(blocks, lambda b: b["x0"] < split)
        right = F.filter(blocks, lambda b: b["x0"] >= split)
        opening = F.filter(
            _before(F.filter(left, lambda b: b["page"] == 1), lambda b: b["text"] == "INGREDIENTS"),
            lambda b: (b["y0"] >= 145) & ~starts_with_any(b["text"], NYT_HEADER + NYT_CREDITS) & ~excluded(b),
        )
        listed = F.filter(_after(left, lambda b: b["text"] == "INGREDIENTS"), lambda b: (b["text"] != "INGREDIENTS") & ~excluded(b))
        yields = F.filter(listed, lambda b: F.startswith(b["text"], F.lit("Yield:")))
        items = F.filter(listed, lambda b: ~F.startswith(b["text"], F.lit("Yield:")))

        def opens_section(b: Column, i: Column) -> Column:
            return (i > 0) & is_heading(b)

        # The first item is an ingredient even in capitals; later headings open sections.
        plain = F.slice(items, 1, F.coalesce(F.array_min(F.array_compact(F.transform(items, lambda b, i: F.when(opens_section(b, i), i)))), F.size(items)))
        method = F.filter(_after(right, lambda b: b["text"] == "PREPARATION"), lambda b: ~excluded(b))

        def is_step(b: Column) -> Column:
            return F.rlike(b["text"], F.lit(NUMBERED_STEP))

        runs = split_at(method, lambda b, i: is_step(b) | is_heading(b))
        steps = F.transform(F.filter(runs, lambda r: is_step(F.get(r, F.lit(0)))), lambda r: F.array_join(_texts(F.slice(r, 2, MANY)), " "))
        asides = F.filter(runs, lambda r: ~is_step(F.get(r, F.lit(0))))
        return F.struct(
            title.alias("title"),
            author.alias("author"),
            F.coalesce(blank_to_null(last_with("Published ")), last_with("Updated ")).alias("published_at"),
            last_with("Updated ").alias("updated_at"),
            last_with("Total Time ").alias("total_time"),
            last_with("Prep Time ").alias("prep_time"),
            last_with("Cook Time ").alias("cook_time"),
            _without_prefix(text(_last(_texts(yields))), "Yield:").alias("yield_text"),
            F.array_join(F.array_distinct(_texts(opening)), "\n\n").alias("intro"),
            F.array_distinct(_texts(plain)).alias("ingredients"),
            F.filter(steps, lambda s: s != "").alias("steps"),
            F.array_distinct(_texts(_before(method, lambda b: is_step(b) | is_heading(b)))).alias("notes"),
            F.concat(_sections(split_at(items, opens_section)), _sections(asides)).alias("sections"),
        )

    parsed = bind(ordered_blocks(F.col("blocks")), lambda b: bind(_split(b, "PREPARATION", 0.38, 220.0), lambda s: read(b, s)))
    keys = ("author", "published_at", "updated_at", "total_time", "prep_time", "cook_time", "intro")
    meta = {k: F.col(f"p.{k}") for k in keys} | {"yield": F.col("p.yield_text")}
    reason = F.when((F.size("p.ingredients") == 0) | (F.size("p.steps") == 0), NYT_REASON)
    return _result(files, "nytimes", parsed, meta, reason)


def _split(blocks: Column, right_heading: str, share: float, default: float) -> Column:
    def heading(word: str) -> Column:
        return _first(blocks, lambda b: (b["page"] == 1) & (b["text"] == word))["x0"]

    left, right = heading("INGREDIENTS"), heading(right_heading)
    fallback = F.when(F.col("page_width") > 0, F.col("page_width") * share).otherwise(default)
    return F.when(right > left, (left + right) / 2).otherwise(fallback)


def _jamie_header(lines: Column) -> Column:
    """Time, difficulty and servings of the header lines, recombined when they share a line."""

    def words(c: Column) -> Column:
        return display_text(text(c))

    def is_time(x: Column) -> Column:
        return F.rlike(x, F.lit(JAMIE_TIME))

    def is_makes(x: Column) -> Column:
        return F.rlike(x, F.lit(JAMIE_MAKES))

    # First time line, then the first servings line that is not it, then the first other line.
    time_at = _place_of(lines, is_time)
    makes_at = _place_of(lines, lambda x, i=None: is_makes(x), skip=time_at)
    other_at = F.array_min(F.array_compact(F.transform(lines, lambda x, i: F.when(
        ~i.eqNullSafe(time_at) & ~i.eqNullSafe(makes_at), i))))
    together = F.array_join(lines, " ")
    restart = (F.size(lines) == 1) | F.rlike(text(F.get(lines, F.lit(0))), F.lit(r"(?i)(?:^|[^\p{L}\p{N}_])(?:MAKES|SERVES)(?:$|[^\p{L}\p{N}_])"))

    def unless_restart(c: Column) -> Column:
        return F.when(restart, "").otherwise(c)

    time0 = unless_restart(words(F.get(lines, time_at)))
    makes0 = unless_restart(words(F.regexp_extract(text(F.get(lines, makes_at)), JAMIE_MAKES, 1)))
    other0 = unless_restart(words(F.get(lines, other_at)))
    found = F.rlike(together, F.lit(JAMIE_MAKES_ANYWHERE))
    makes = F.when(found, words(F.regexp_extract(together, JAMIE_MAKES_ANYWHERE, 2))).otherwise(makes0)
    rest = F.when(found, strip(F.regexp_extract(together, JAMIE_MAKES_ANYWHERE, 1))).otherwise(together)
    by_word = r"(?i)^(.+?(?<![\p{L}\p{N}_])TIME)(?![\p{L}\p{N}_])\s*(.*)$"
    by_unit = r"(?i)^(.+?(?<![\p{L}\p{N}_])(?:MINS?|MINUTES?|HOURS?)(?![\p{L}\p{N}_]))(?:\s+(.+))?$"

    def final(r: Column) -> Column:
        pattern_hit = F.when(F.rlike(r, F.lit(by_word)), 1).when(F.rlike(r, F.lit(by_unit)), 2).otherwise(0)
        value = F.when(pattern_hit == 1, F.regexp_extract(r, by_word, 1)).otherwise(F.regexp_extract(r, by_unit, 1))
        left = F.when(pattern_hit == 1, F.regexp_extract(r, by_word, 2)).when(pattern_hit == 2, F.regexp_extract(r, by_unit, 2)).otherwise(r)
        return F.struct(
            F.when(pattern_hit > 0, words(value)).otherwise(time0).alias("total_time"),
            F.coalesce(blank_to_null(words(strip(left))), other0).alias("difficulty"),
            makes.alias("makes"),
        )

    nothing = F.struct(F.lit("").alias("total_time"), F.lit("").alias("difficulty"), F.lit("").alias("makes"))
    return F.when(F.size(lines) == 0, nothing).otherwise(bind(rest, final))


def _place_of(lines: Column, test, skip: Column | None = None) -> Column:
    def hit(x: Column, i: Column) -> Column:
        return F.when(test(x) if skip is None else test(x) & ~i.eqNullSafe(skip), i)

    return F.array_min(F.array_compact(F.transform(lines, hit)))


def _embedded_step(x: Column) -> Column:
    """Sentence of a block that carries its one-digit step number before or after it."""
    lead, trail = r"^(\d)\s+(.+[.!?])$", r"^(.+?[.!?])\s+(\d)$"
    leading = F.regexp_extract(x, lead, 2)
    begins_with_number = F.rlike(x, F.lit(r"^\d+\s+."))
    candidate = F.when(begins_with_number, leading).otherwise(F.regexp_extract(x, trail, 1))
    shouted = ~F.rlike(candidate, F.lit(r"\p{Ll}")) & F.rlike(candidate, F.lit(r"\p{Lu}"))
    return F.when((candidate != "") & ~shouted & ~F.rlike(x, F.lit(JAMIE_INLINE_STEP)), strip(candidate))


def pdf_jamie(files: DataFrame) -> DataFrame:
    """Two columns; steps are numbered on their own, inline or inside a row."""

    def is_number(x: Column) -> Column:
        return F.rlike(x, F.lit(r"^\d+$"))

    def is_note_heading(x: Column) -> Column:
        return F.rlike(x, F.lit(JAMIE_UPPER)) | F.rlike(F.lower(x), F.lit("method:?$"))

    def row_of(row: Column) -> Column:
        texts = _texts(row)
        inline = F.get(F.filter(texts, lambda x: F.rlike(x, F.lit(JAMIE_INLINE_STEP))), F.lit(0))
        embedded = F.get(F.filter(F.transform(texts, _embedded_step), lambda x: x.isNotNull()), F.lit(0))
        kept = F.array_join(F.filter(texts, lambda x: ~is_number(x) & ~F.rlike(x, F.lit(JAMIE_INLINE_STEP))), " ")
        said = F.coalesce(embedded, kept)
        note = F.when(inline.isNotNull(), display_text(F.regexp_replace(F.regexp_extract(inline, JAMIE_INLINE_STEP, 1), ":+$", "")))
        return F.struct(
            (inline.isNotNull() | embedded.isNotNull() | F.exists(texts, is_number)).alias("is_step"),
            note.alias("note"),
            said.alias("said"),
            (is_note_heading(said) & (said != "")).alias("is_heading"),
        )

    def method(rows: Column) -> Column:
        # A heading row closes the steps; a step row after it opens them again.
        start = F.struct(F.lit(False).alias("cooking"), F.lit(0).alias("step"), F.array().cast("array<struct<step:int,text:string>>").alias("out"))

        def entry(step: Column, said: Column) -> Column:
            return F.array(F.struct(step.cast("int").alias("step"), said.alias("text")))

        def move(acc: Column, r: Column) -> Column:
            step = acc["step"] + F.when(r["is_step"], 1).otherwise(0)
            cooking = (acc["cooking"] | r["is_step"]) & ~r["is_heading"]
            body = (
                F.when(r["said"] == "", F.slice(acc["out"], 1, 0))
                .when(r["is_heading"], entry(F.lit(0), display_text(F.regexp_replace(r["said"], ":+$", ""))))
                .when(cooking, entry(step, r["said"]))
                .otherwise(entry(F.lit(0), r["said"]))
            )
            noted = F.when(r["note"].isNotNull(), entry(F.lit(0), r["note"])).otherwise(F.slice(acc["out"], 1, 0))
            # A heading also ends the step that was open, so what follows is another one.
            return F.struct(
                cooking.alias("cooking"), (step + F.when(r["is_heading"], 1).otherwise(0)).cast("int").alias("step"),
                F.concat(acc["out"], noted, body).alias("out"),
            )

        return F.aggregate(rows, start, move, lambda acc: acc["out"])

    def notes_of(lines: Column) -> Column:
        runs = split_at(lines, lambda x, i: (i == 0) | is_note_heading(x))
        return F.transform(
            runs,
            lambda run: F.array_join(F.transform(run, lambda x, i: F.when((i == 0) & is_note_heading(x), display_text(F.regexp_replace(x, ":+$", ""))).otherwise(x)), " "),
        )

    def read(blocks: Column, split: Column) -> Column:
        first_page = F.filter(blocks, lambda b: b["page"] == 1)
        heading_y = F.coalesce(_first(first_page, lambda b: b["text"] == "INGREDIENTS")["y0"], F.lit(190.0))
        header = bind(
            heading_y,
            lambda y: _texts(F.filter(first_page, lambda b: (b["y0"] >= 80) & (b["y0"] < y) & ~b["text"].isin("INGREDIENTS", "METHOD"))),
        )
        title = display_text(text(_first(first_page, lambda b: (b["y0"] < 90) & ~b["text"].isin("INGREDIENTS", "METHOD"))["text"]))
        left = _after(F.filter(first_page, lambda b: b["x0"] < split), lambda b: b["text"] == "INGREDIENTS")

        def is_tip(b: Column) -> Column:
            return F.startswith(b["text"], F.lit("TOP TIP"))

        tip_at = _place(left, is_tip)
        tip_lines = F.transform(
            F.when(tip_at.isNotNull(), F.slice(left, tip_at + 1, MANY)).otherwise(F.slice(left, 1, 0)),
            lambda b: F.when(is_tip(b), F.btrim(_without_prefix(b["text"], "TOP TIP"), F.lit(" :-"))).otherwise(b["text"]),
        )
        tip = F.array_join(F.filter(tip_lines, lambda x: x != ""), " ")
        right = _after(F.filter(blocks, lambda b: b["x0"] >= split), lambda b: b["text"] == "METHOD")
        told = bind(F.transform(row_cluster(right), row_of), method)

        def built(out: Column) -> Column:
            numbers = F.array_distinct(F.transform(F.filter(out, lambda e: e["step"] > 0), lambda e: e["step"]))
            steps = F.transform(numbers, lambda n: F.array_join(F.transform(F.filter(out, lambda e: e["step"] == n), lambda e: e["text"]), " "))
            return F.struct(
                title.alias("title"),
                bind(header, _jamie_header).alias("header"),
                _join_wrapped(_texts(_before(left, is_tip)), JAMIE_INGREDIENT).alias("ingredients"),
                steps.alias("steps"),
                notes_of(F.transform(F.filter(out, lambda e: e["step"] == 0), lambda e: e["text"])).alias("notes"),
                F.when(tip != "", F.array(F.struct(F.lit("Top Tip").alias("heading"), F.array(tip).alias("lines")))).otherwise(_none()).alias("sections"),
            )

        return bind(told, built)

    parsed = bind(ordered_blocks(F.col("blocks")), lambda b: bind(_split(b, "METHOD", 0.34, 200.0), lambda s: read(b, s)))
    fields = ("total_time", "difficulty", "makes")
    meta = {"author": F.lit("Jamie Oliver")} | {k: F.col(f"p.header.{k}") for k in fields}
    lacking = F.lit(False)
    for k in fields:
        lacking = lacking | (F.col(f"p.header.{k}") == "")
    reason = (
        F.when(F.col("page_count") == 0, JAMIE_EMPTY)
        .when(lacking, JAMIE + "time, difficulty, and makes/serves metadata.")
        .when(F.size("p.ingredients") == 0, JAMIE + "an INGREDIENTS section.")
        .when(F.size("p.steps") == 0, JAMIE + "a METHOD section with numbered steps.")
    )
    return _result(files, "jamie-oliver", parsed, meta, reason)


def pdf_bbc(files: DataFrame) -> DataFrame:
    """One column of fixed bands by height on the first page, then numbered steps."""

    def read(blocks: Column) -> Column:
        def with_title(first_page: Column, method_y: Column) -> Column:
            title = text(_first(first_page, lambda b: b["y0"] < 120)["text"])
            return bind(title, lambda t: built(blocks, first_page, method_y, t))

        # Values that a filter compares with every block are bound: they are computed once.
        return bind(
            F.filter(blocks, lambda b: b["page"] == 1),
            lambda page: bind(_first(page, _says("method"))["y0"], lambda y: with_title(page, y)),
        )

    def built(blocks: Column, first_page: Column, method_y: Column, title: Column) -> Column:
        def band(low: float, high: Column | float) -> Column:
            return F.filter(first_page, lambda b: (b["y0"] >= low) & (b["y0"] < high))

        author = text(_first(band(120, 145), lambda b: b["text"] != title)["text"])
        makes = text(_first(first_page, lambda b: F.rlike(b["text"], F.lit(BBC_MAKES)))["text"])
        times_at = _place(first_page, lambda b: F.rlike(b["text"], F.lit(BBC_TIMES)))
        times = text(_last(F.filter(F.transform(first_page, lambda b: b["text"]), lambda x: F.rlike(x, F.lit(BBC_TIMES)))))
        extra = _first(
            F.slice(first_page, times_at + 2, MANY),
            lambda b: (b["y0"] < 220) & ~b["text"].isin(*BBC_NOT_CONTENT) & ~F.rlike(b["text"], F.lit(BBC_TIMES)),
        )["text"]
        listed = F.filter(_texts(band(380, F.coalesce(method_y, F.lit(10000.0)))), lambda x: ~x.isin(*BBC_NOT_CONTENT))
        told = F.filter(blocks, lambda b: method_y.isNotNull() & ((b["page"] > 1) | (b["y0"] > method_y)))
        steps = F.transform(
            split_at(told, lambda b, i: F.rlike(b["text"], F.lit(NUMBERED_STEP))),
            lambda run: F.array_join(_texts(F.slice(run, 2, MANY)), " "),
        )
        return F.struct(
            title.alias("title"),
            author.alias("author"),
            strip(F.regexp_replace(F.regexp_extract(makes, BBC_MAKES, 1), "^Makes", "")).alias("makes"),
            F.regexp_extract(makes, BBC_MAKES, 2).alias("difficulty"),
            F.regexp_extract(times, BBC_TIMES, 1).alias("prep_time"),
            F.regexp_extract(times, BBC_TIMES, 2).alias("cook_time"),
            F.array_join(F.filter(_texts(band(215, 262)), lambda x: ~x.isin(*BBC_NOT_CONTENT)), " ").alias("intro"),
            F.array_join(F.filter(_texts(band(262, 305)), lambda x: x != "Try our app"), "|").alias("tags"),
            _join_wrapped(listed, BBC_INGREDIENT).alias("ingredients"),
            F.coalesce(F.filter(steps, lambda s: s != ""), no_texts()).alias("steps"),
            F.array_compact(F.array(extra)).alias("notes"),
            _none().alias("sections"),
        )

    parsed = bind(ordered_blocks(F.col("blocks")), read)
    keys = ("author", "makes", "difficulty", "prep_time", "cook_time", "intro", "tags")

    def lacks(*names: str) -> Column:
        hit = F.lit(False)
        for name in names:
            hit = hit | (F.col(f"p.{name}") == "")
        return hit

    reason = (
        F.when(F.col("page_count") == 0, BBC_EMPTY)
        .when(lacks("author"), BBC + "an author line beneath the recipe title.")
        .when(lacks("makes", "difficulty"), BBC + "makes and difficulty metadata.")
        .when(lacks("prep_time", "cook_time"), BBC + "prep and cook timing metadata.")
        .when(F.size("p.ingredients") == 0, BBC + "an ingredients section.")
        .when(F.size("p.steps") == 0, BBC + "a Method section with Step headings.")
    )
    return _result(files, "bbc-goodfood", parsed, {k: F.col(f"p.{k}") for k in keys}, reason)


def pdf_waitrose(files: DataFrame) -> DataFrame:
    """Labelled first page; ingredients by column; steps from the words of page two."""

    def read(blocks: Column) -> Column:
        second = F.filter(blocks, lambda b: b["page"] == 2)
        bounds = F.struct(
            _first(second, _says("method"))["y0"].alias("method_y"),
            F.coalesce(_first(second, _says("nutritional"))["y0"], F.lit(10000.0)).alias("end_y"),
        )
        return bind(
            F.filter(blocks, lambda b: b["page"] == 1), lambda page: bind(bounds, lambda b: with_labels(blocks, page, b["method_y"], b["end_y"]))
        )

    def with_labels(blocks: Column, first_page: Column, method_y: Column, end_y: Column) -> Column:
        middle = F.col("page_width") / 2

        def label_of(x: Column) -> Column:
            return F.coalesce(*[F.when(F.rlike(x, F.lit(p)), F.lit(k)) for k, p in WAITROSE_LABELS.items()])

        def labelled(name: str) -> Column:
            hit = _first(first_page, lambda b: label_of(b["text"]) == name)["text"]
            return strip(F.regexp_extract(text(hit), WAITROSE_LABELS[name], 1))

        lowest = F.coalesce(
            F.array_min(F.transform(F.filter(first_page, lambda b: label_of(b["text"]).isin("serves", "course")), lambda b: b["y0"])), F.lit(620.0)
        )
        listed = _before(
            _after(blocks, _says("ingredients")),
            lambda b: _says("method")(b) | F.startswith(b["text"], F.lit("Typical values per serving")),
        )
        by_column = F.array_sort(
            F.transform(
                F.filter(listed, lambda b: ~(_says("nutritional")(b) | _says("ingredients")(b))),
                lambda b: F.struct(
                    b["page"].alias("page"), F.when(middle > 0, (b["x0"] >= middle).cast("int")).otherwise(0).alias("column"),
                    b["y0"].alias("y0"), b["x0"].alias("x0"), b["at"].alias("at"), b["text"].alias("text"),
                ),
            )
        )
        words = F.array_sort(
            F.transform(
                F.filter("words", lambda w: (w["page"] == 2) & (w["y0"] > method_y) & (w["y0"] < end_y)),
                lambda w, i: F.struct(
                    (w["x0"] >= middle).cast("int").alias("column"), F.bround(w["y0"], 1).alias("y"), w["x0"].alias("x0"),
                    i.alias("at"), w["text"].alias("text"),
                ),
            )
        )

        def numbered(a: Column) -> Column:
            def runs(column: int) -> Column:
                mine = F.filter(a, lambda w: w["column"] == column)

                def cut(edge: Column) -> Column:
                    return split_at(mine, lambda w, i: F.rlike(w["text"], F.lit(r"^\d+$")) & (w["x0"] <= edge + 24))

                return bind(F.array_min(F.transform(mine, lambda w: w["x0"])), cut)

            return F.transform(
                F.concat(runs(0), runs(1)),
                lambda run: F.struct(
                    F.get(run, F.lit(0))["text"].cast("int").alias("number"), F.array_join(_texts(F.slice(run, 2, MANY)), " ").alias("text")
                ),
            )

        def steps(found: Column) -> Column:
            """Texts of equal numbers joined in page order: they meet by sorting, so no number reads the others' texts."""
            numbered = F.filter(found, lambda s: s["number"].isNotNull())
            by_number = F.array_sort(
                F.transform(numbered, lambda s, i: F.struct(s["number"].alias("number"), i.alias("at"), s["text"].alias("text")))
            )

            def joined(a: Column) -> Column:
                runs = split_at(a, lambda s, i: (i == 0) | (s["number"] != F.get(a, F.greatest(i - 1, F.lit(0)))["number"]))
                return F.transform(runs, lambda run: strip(F.array_join(_texts(run), " ")))

            return bind(by_number, joined)

        told = bind(bind(words, numbered), steps)
        return F.struct(
            text(_first(first_page, lambda b: (b["y0"] >= 380) & (b["y0"] <= 460))["text"]).alias("title"),
            *[labelled(k).alias(k) for k in WAITROSE_LABELS],
            bind(
                lowest,
                lambda y: F.array_join(_texts(F.filter(first_page, lambda b: (b["y0"] >= 460) & (b["y0"] < y))), " "),
            ).alias("intro"),
            _texts(by_column).alias("ingredients"),
            F.coalesce(F.when(method_y.isNotNull(), F.filter(told, lambda s: s != "")), no_texts()).alias("steps"),
            no_texts().alias("notes"),
            _none().alias("sections"),
        )

    parsed = bind(ordered_blocks(F.col("blocks")), read)

    def lacks(*names: str) -> Column:
        hit = F.lit(False)
        for name in names:
            hit = hit | (F.col(f"p.{name}") == "")
        return hit

    reason = (
        F.when(F.col("page_count") < 2, WAITROSE + "a 2-page recipe PDF.")
        .when(lacks("serves", "course"), WAITROSE + "serves and course metadata on page 1.")
        .when(lacks("prep_time", "cook_time", "total_time"), WAITROSE + "prepare, cook, and total time metadata on page 1.")
        .when(F.size("p.ingredients") == 0, WAITROSE + "a 2-column Ingredients section on page 2.")
        .when(F.size("p.steps") == 0, WAITROSE + "a 2-column Method section with numbered steps on page 2.")
    )
    meta = {k: F.col(f"p.{k}") for k in (*WAITROSE_LABELS, "intro")}
    return _result(files, "waitrose-recipes", parsed, meta, reason)


TEMPLATES = {
    "nytimes": pdf_nytimes,
    "jamie-oliver": pdf_jamie,
    "bbc-goodfood": pdf_bbc,
    "waitrose-recipes": pdf_waitrose,
}


def template_rejects(parsed: DataFrame, source: str) -> DataFrame:
    """Files that do not fit, with what becomes of them: dropped, or kept and marked failed."""
    outcome = "failed" if source == "nytimes" else "dropped"
    return parsed.where(F.col("reason").isNotNull()).select("file_id", F.lit(outcome).alias("outcome"), "reason")


def bulk_reprocess_report(parsed: DataFrame) -> DataFrame:
    """One row per file: its title and counts, or why it was rejected."""
    return parsed.select(
        "file_id",
        "title",
        F.when(F.col("reason").isNull(), F.size("ingredients")).otherwise(0).alias("ingredients"),
        F.when(F.col("reason").isNull(), F.size("method_steps")).otherwise(0).alias("steps"),
        "reason",
    )
