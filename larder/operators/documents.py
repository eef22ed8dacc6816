"""Documents to recipe drafts: sections, their fields, candidates, drafts.

A document arrives as one row and is taken apart with array functions, so its whole text stays
in that row's task and nothing is shuffled until drafts are stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.ingredients import parse_ingredient_line
from larder.functions.metadata import (
    METHOD_STEP,
    ingredient_like,
    is_measured,
    labelled,
    merge_metadata,
    starts_with_any,
)
from larder.functions.text import (
    bind,
    blank_to_null,
    casefold,
    excerpt,
    inferred_title,
    squash,
    strip,
    text,
    text_lines,
    title_token,
    word_count,
)
from larder.operators.catalogue import append_new_anchors
from larder.operators.ordering import ranked
from larder.session import computed_once, cut_lineage
from larder.sources.html import node_array

# Fixed values.
NON_RECIPE_TITLES = (
    "about the author",
    "about the authors",
    "about the book",
    "acknowledgements",
    "a short note about ingredients",
    "contents",
    "copyright",
    "dedication",
    "foreword",
    "how to use this book",
    "index",
    "introduction",
    "ottolenghi",
    "praise for salt fat acid heat",
    "recipe list",
    "table of contents",
    "thank you",
    "our histories",
    "our shared history",
)
NON_RECIPE_PATHS = (
    "about_", "acknowledg", "contents", "copyright", "dedication", "foreword", "intro", "our_histor", "ottolenghi",
    "title", "toc",
)
METHOD_CUES = ("method", "directions", "steps", "instructions")
RECIPE_CUES = ("ingredients", "serves", "yield", "prep", "cook time", "makes")
INGREDIENT_HEADINGS = ("ingredient", "ingredients")
METHOD_HEADINGS = ("method", "methods", "directions", "instructions", "preparation", "steps")
HEADINGS = ("h1", "h2", "h3", "h4")
LEAST_CONFIDENCE = 0.78
RULE_CONFIDENCE = 0.99
RULE_NOTE = "deterministic_profile_extraction"

TEXTS = "array<string>"
FAR = 1000000000  # longer than any array


def no_texts() -> Column:
    return F.array().cast(TEXTS)


def split_at(items: Column, is_start: Callable[[Column, Column], Column]) -> Column:
    """Runs of an array that begin where ``is_start(item, index)`` holds.

    Items before the first start belong to no run.
    """

    def cut(a: Column) -> Column:
        def runs(found: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(found, k + 1), F.size(a))
                return F.slice(a, start + 1, end - start)

            return F.transform(found, run)

        places = F.transform(a, lambda x, i: F.when(is_start(x, i), i))
        return bind(F.array_compact(places), runs)

    # Every run reads the items: they are made once, not once a run.
    return bind(items, cut)


def dedupe_consecutive(lines: Column) -> Column:
    """Squashed lines without blanks and without a line equal to the one before it."""
    return dedupe_squashed(F.transform(lines, squash))


def dedupe_squashed(lines: Column) -> Column:
    """``dedupe_consecutive`` of lines that are squashed already, as the texts of nodes are."""
    return lines_of(without_repeats(keyed_lines(lines)))


def keyed_lines(lines: Column) -> Column:
    """Squashed lines without blanks, each with its lower case and the ``key`` it is compared by, worked out once."""

    def keyed(line: Column) -> Column:
        return bind(
            F.lower(line),
            lambda low: F.struct(
                line.alias("line"),
                low.alias("low"),
                F.when(F.contains(low, F.lit("ß")), F.replace(low, F.lit("ß"), F.lit("ss"))).otherwise(low).alias("key"),
            ),
        )

    return F.transform(F.filter(lines, lambda x: x != ""), keyed)


def without_repeats(lines: Column) -> Column:
    """Keyed lines without those equal to the one before them."""
    return bind(lines, lambda a: F.filter(a, lambda x, i: (i == 0) | (x["key"] != F.get(a, i - 1)["key"])))


def lines_of(items: Column) -> Column:
    return F.transform(items, lambda x: x["line"])


def method_steps(lines: Column) -> Column:
    """Steps of method lines: ``Step n`` alone or a numbered line begins a step."""
    return squashed_steps(F.filter(F.transform(lines, squash), lambda x: x != ""))


def squashed_steps(lines: Column) -> Column:
    """``method_steps`` of lines that are squashed and not blank."""
    alone = r"(?i)^step\s+\d+$"

    def steps(a: Column) -> Column:
        def starts(x: Column, i: Column) -> Column:
            after_alone = F.rlike(text(F.get(a, F.greatest(i - 1, F.lit(0)))), F.lit(alone))
            return ~F.rlike(x, F.lit(alone)) & (F.rlike(x, F.lit(METHOD_STEP)) | (i == 0) | after_alone)

        def body(x: Column) -> Column:
            return F.coalesce(blank_to_null(strip(F.regexp_replace(x, METHOD_STEP, ""))), x)

        return F.transform(
            split_at(a, starts),
            lambda run: F.array_join(F.transform(F.filter(run, lambda x: ~F.rlike(x, F.lit(alone))), body), " "),
        )

    return bind(lines, steps)


# --- sections --------------------------------------------------------------------------------


def nav_html_skip(docs: DataFrame, name: str = "doc") -> DataFrame:
    """Documents other than navigation files."""
    return docs.where(~F.rlike(F.lower(name), F.lit(r"^nav\.|nav\.x?html$")))


def sectionize(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """Sections of each page: a heading begins one when lines are pending.

    Images before the first line belong to the first section.
    """
    return node_sections(pages.select(doc, node_array(F.col(html)).alias("nodes")), [doc])


def node_sections(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """``sectionize`` of pages read before: ``keep`` and the sections of each page's ``nodes``."""
    nodes = F.filter(
        "nodes",
        lambda n: n["tag"].isin(*HEADINGS) | ((n["tag"] == "img") & n["src"].isNotNull()) | (n["text"] != ""),
    )

    def is_line(n: Column) -> Column:
        return n["tag"] != "img"

    def sections(a: Column) -> Column:
        first_line = F.coalesce(
            F.array_min(F.array_compact(F.transform(a, lambda n, i: F.when(is_line(n), i)))), F.lit(2147483647)
        )
        return bind(first_line, lambda f: split_at(a, lambda n, i: (i == 0) | (n["tag"].isin(*HEADINGS) & (i > f))))

    rows = parsed.select(*keep, F.posexplode(bind(nodes, sections)).alias("at", "nodes"))
    heads = F.filter("nodes", lambda n: n["tag"].isin(*HEADINGS))
    lines = F.transform(F.filter("nodes", is_line), lambda n: n["text"])
    return rows.select(
        *keep,
        (F.col("at") + 1).alias("section_no"),
        F.get(heads, F.lit(0))["text"].alias("heading"),
        lines.alias("lines"),
        F.transform(F.filter("nodes", lambda n: ~is_line(n)), lambda n: n["src"]).alias("images"),
    ).where(F.size("lines") > 0)


def html_sections(pages: DataFrame, doc: str = "page_id", html: str = "html") -> DataFrame:
    """Generic sections with title, text, excerpt and anchor ``doc#n``."""
    return generic_sections(sectionize(pages, doc, html), doc, [doc])


def generic_sections(rows: DataFrame, doc: str, keep: list[str]) -> DataFrame:
    """Sections of ``sectionize`` with title, text, excerpt and anchor."""
    lines = dedupe_squashed(F.col("lines"))
    key = F.concat(F.col(doc).cast("string"), F.lit("#"), F.col("section_no").cast("string"))
    return rows.withColumn("lines", lines).where(F.size("lines") > 0).select(
        *keep,
        "section_no",
        key.alias("section_key"),
        key.alias("anchor"),
        F.coalesce(blank_to_null(F.col("heading")), inferred_title(F.col("lines"))).alias("chapter_title"),
        F.col("heading").isNotNull().alias("has_heading"),
        F.array_join("lines", "\n").alias("text"),
        excerpt(F.col("lines")).alias("excerpt"),
        "images",
    )


def caption_attach(sections: DataFrame, keys: list[str], order: list[Column], ids: list[str]) -> DataFrame:
    """Give the images of caption pages to the section before them and drop those pages.

    A caption page has images, no heading, and the previous section's title as its text. A run
    of pages with the same text follows its first page. ``ids`` identify a section within ``keys``, and
    ``order`` is made of them: only these, titles and images are ranked, and texts meet what came of it by key.
    """
    shape = ~F.col("has_heading") & (F.size("images") > 0) & (title_token(F.col("excerpt")) != "")
    own = sections.select(
        *keys, *ids, shape.alias("shape"), F.when(shape, title_token(F.col("excerpt"))).alias("caption"),
        title_token(F.col("chapter_title")).alias("title_key"), F.when(shape, F.col("images")).alias("images"),
    )
    # Ranking samples its input first: titles are compared in one form, made once.
    placed = ranked(cut_lineage(own), order, keys)
    before = placed.select(*keys, (F.col("rank") + 1).alias("rank"), F.col("title_key").alias("before_key"))
    shaped = placed.where("shape").join(before, [*keys, "rank"], "left")
    same = Window.partitionBy(*keys, "caption").orderBy("rank")
    run = shaped.withColumn("run", F.col("rank") - F.row_number().over(same))
    in_run = Window.partitionBy(*keys, "caption", "run").orderBy("rank")
    first = F.first(F.coalesce(F.col("before_key") == F.col("caption"), F.lit(False))).over(in_run)
    own_title = F.first(F.col("title_key") == F.col("caption")).over(in_run)
    nth = F.row_number().over(in_run)
    moved = run.withColumns({"first": first, "own_title": own_title, "nth": nth, "head": F.min("rank").over(in_run)}).where(
        "first OR (nth > 1 AND own_title)"
    )
    target = F.when(F.col("first"), F.col("head") - 1).otherwise(F.col("head"))
    gifts = cut_lineage(moved.select(*keys, *ids, "rank", target.alias("target"), "images"))
    given = gifts.groupBy(*keys, F.col("target").alias("rank")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "images"))), lambda g: g["images"])).alias("extra")
    )
    extra = placed.select(*keys, *ids, "rank").join(given, [*keys, "rank"]).select(*keys, *ids, "extra")
    return (
        sections.join(gifts.select(*keys, *ids), [*keys, *ids], "left_anti")
        .join(extra, [*keys, *ids], "left")
        .withColumn("images", F.concat("images", F.coalesce("extra", no_texts())))
        .drop("extra")
    )


def section_fields(sections: DataFrame) -> DataFrame:
    """Intro, ingredient and method lines and metadata of each section.

    Lines are read in order. Before any heading, lines are the intro until the first that looks
    like an ingredient, which opens the ingredients; from then on only headings change the part.
    Metadata lines peel off anywhere. Headings cut the lines into runs, each of one part, so no state is
    carried from line to line; whether a line looks like an ingredient is asked only until one does.
    """

    def marked(x: Column) -> Column:
        heading = strip(F.rtrim(x["low"], F.lit(":")))
        turn = bind(
            heading,
            lambda h: F.when(h.isin(*INGREDIENT_HEADINGS), "ingredients").when(h.isin(*METHOD_HEADINGS), "method"),
        )
        return bind(
            turn,
            lambda t: F.struct(
                x["line"].alias("line"), x["low"].alias("low"), x["key"].alias("key"), t.alias("turn"),
                F.when(t.isNull(), labelled(x["line"], x["low"])).alias("meta"),
            ),
        )

    def rest(items: Column, start: Column | int) -> Column:
        return F.slice(items, start, FAR)

    def plain(items: Column) -> Column:
        return F.filter(items, lambda x: x["meta"].isNull())

    def first_ingredient(head: Column) -> Column:
        """Index of the first line that looks like an ingredient; negative without one."""

        def step(n: Column, x: Column) -> Column:
            hit = x["meta"].isNull() & ingredient_like(x["line"], x["low"])
            return F.when(n >= 0, n).when(hit, -n - 1).otherwise(n - 1)

        return F.aggregate(head, F.lit(-1), step)

    def parts(a: Column, head: Column, runs: Column, opened: Column) -> Column:
        def under(turn: str) -> Column:
            found = F.filter(runs, lambda run: F.get(run, F.lit(0))["turn"] == turn)
            return F.flatten(F.transform(found, lambda run: rest(run, 2)))

        begun = opened >= 0
        meta = F.transform(F.filter(a, lambda x: x["meta"].isNotNull()), lambda x: x["meta"])
        intro = plain(F.when(begun, F.slice(head, 1, opened)).otherwise(head))
        ingredients = plain(F.concat(F.when(begun, rest(head, opened + 1)).otherwise(F.slice(head, 1, 0)), under("ingredients")))
        return F.struct(
            deduped_metadata(meta, lines_of(without_repeats(intro))).alias("metadata"),
            lines_of(without_repeats(ingredients)).alias("ingredient_lines"),
            squashed_steps(lines_of(without_repeats(plain(under("method"))))).alias("method_lines"),
        )

    def fields(a: Column) -> Column:
        turns = F.transform(a, lambda x, i: F.when(x["turn"].isNotNull(), i))
        first = F.coalesce(F.array_min(F.array_compact(turns)), F.size(a))
        return bind(
            F.slice(a, 1, first),
            lambda head: bind(
                split_at(a, lambda x, i: x["turn"].isNotNull()),
                lambda runs: bind(first_ingredient(head), lambda opened: parts(a, head, runs, opened)),
            ),
        )

    title = casefold(strip(text(F.col("chapter_title"))))
    lines = bind(
        without_repeats(keyed_lines(F.transform(F.split("text", "\n"), squash))),
        lambda a: F.when(F.get(a, F.lit(0))["key"] == title, rest(a, 2)).otherwise(a),
    )
    found = bind(F.transform(lines, marked), fields)
    return computed_once(sections, "f", found).select("*", "f.*").drop("f")


def final_metadata(meta: Column, intro: Column) -> Column:
    """Metadata map: the last value of a key wins; intro paragraphs are joined by a blank line."""
    return deduped_metadata(meta, dedupe_consecutive(intro))


def deduped_metadata(meta: Column, intro: Column) -> Column:
    """``final_metadata`` with the intro's lines squashed and without repeats."""
    last = F.filter(meta, lambda e, i: ~F.exists(F.slice(meta, i + 2, FAR), lambda later: later["key"] == e["key"]))
    opening = F.array_join(intro, "\n\n")
    return F.map_filter(
        F.map_concat(F.map_from_entries(last), F.create_map(F.lit("intro"), opening)), lambda _k, v: strip(v) != ""
    )


# --- candidates and drafts -------------------------------------------------------------------


def recipe_candidate(title: Column, source_ref: Column, body: Column) -> Column:
    """Whether a section can be a recipe."""

    def decide(lines: Column, lowered: Column) -> Column:
        def contains_any(words: tuple[str, ...]) -> Column:
            hit = F.lit(False)
            for word in words:
                hit = hit | F.contains(lowered, F.lit(word))
            return hit

        # No rule asks for more than three, so no line is read after the third.
        measured = F.aggregate(lines, F.lit(0), lambda n, x: F.when(n >= 3, n).when(is_measured(x), n + 1).otherwise(n))
        servings = F.size(F.filter(lines, lambda x: starts_with_any(F.lower(x), ("serves", "makes"))))
        untitled = text(title) == ""
        cued = contains_any(RECIPE_CUES + METHOD_CUES)
        titled = ~untitled & (word_count(title) <= 12)
        blocked = (
            F.lower(strip(text(title))).isin(*NON_RECIPE_TITLES)
            | F.rlike(F.lower(strip(text(source_ref))), F.lit("|".join(NON_RECIPE_PATHS)))
            | (F.contains(lowered, F.lit("recipe list")) & ~contains_any(("ingredients", "method")))
            | (untitled & (servings > 1))
        )
        enough = bind(
            measured,
            lambda n: (n >= 3)
            | ((n >= 2) & titled & (F.size(lines) <= 40))
            | ((n >= 2) & cued)
            | ((n >= 1) & contains_any(("serves", "makes", "yield")))
            | (titled & cued & (F.size(lines) <= 80)),
        )
        return ~blocked & enough

    return bind(text_lines(body), lambda lines: bind(F.lower(body), lambda lowered: decide(lines, lowered)))


def candidate_sections(sections: DataFrame) -> DataFrame:
    return sections.where(
        recipe_candidate(F.col("chapter_title"), F.coalesce("anchor", "section_key"), F.col("text"))
    )


def gate_path(sections: DataFrame) -> DataFrame:
    """Sections with the ``path`` that reads them: ``rules`` with both ingredient and method lines, else ``model``."""
    complete = (F.size("ingredient_lines") > 0) & (F.size("method_lines") > 0)
    return sections.withColumn("path", F.when(complete, "rules").when(~complete, "model"))


def deterministic_gate(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections with both ingredient and method lines, and the others.

    To read both, take ``gate_path``, which makes the sections once.
    """
    gated = gate_path(sections)
    return gated.where("path = 'rules'").drop("path"), gated.where("path = 'model'").drop("path")


def review_reasons(confidence: Column, ingredients: Column, steps: Column, images: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(confidence < LEAST_CONFIDENCE, "low_model_confidence"),
            F.when(F.size(ingredients) < 2, "too_few_ingredients"),
            F.when(F.size(steps) == 0, "missing_method_steps"),
            F.when(F.size(images) > 1, "multiple_candidate_images"),
        )
    )


def review_flags(drafts: DataFrame) -> DataFrame:
    """Review reasons of each draft; any reason asks for a review."""
    reasons = review_reasons(*(F.col(c) for c in ("confidence", "ingredients", "method_steps", "images")))
    return drafts.withColumn("review_reasons", reasons).withColumn(
        "review_status", F.when(F.size("review_reasons") > 0, "needs_review").otherwise("pending_review")
    )


def deterministic_drafts(sections: DataFrame) -> DataFrame:
    """Draft dishes of the candidate sections that rules alone can read."""
    ready, _rest = deterministic_gate(candidate_sections(sections))
    lines = F.filter("ingredient_lines", lambda x: strip(x) != "")
    steps = F.filter(F.transform("method_lines", strip), lambda x: x != "")
    drafts = ready.withColumns(
        {
            "title": F.coalesce(blank_to_null(strip(text(F.col("chapter_title")))), F.lit("Untitled Recipe")),
            "ingredients": F.transform(lines, parse_ingredient_line),
            "method_steps": steps,
            "confidence": F.lit(RULE_CONFIDENCE),
            "notes": F.array(F.lit(RULE_NOTE)),
            "metadata": merge_metadata(F.col("metadata"), F.col("metadata")),
        }
    )
    return review_flags(drafts).withColumn("images", F.slice("images", 1, 4)).drop("ingredient_lines", "method_lines")


def targeted_reextract(
    sections: DataFrame, anchors: DataFrame, existing: DataFrame, order: list[Column], ids: list[str] | None = None
) -> DataFrame:
    """Read only the asked anchors again and append the drafts that are new; ``ids`` as in ``positions``."""
    asked = sections.join(anchors.select("cookbook_id", "anchor").distinct(), ["cookbook_id", "anchor"], "left_semi")
    # Drafts are dear to make and are stored anyway: write them once before numbering.
    return append_new_anchors(cut_lineage(deterministic_drafts(asked)), existing, order, ids or ())


def anchor_text(pages: DataFrame, anchors: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """Raw text of ``(recipe_id, doc, fragment)``: from the node with the id to the next heading
    that has an id; the whole document when the fragment is empty or unknown.
    """
    asked = anchors.join(pages, doc)
    nodes = node_array(F.col(html))

    def cut(a: Column) -> Column:
        at = F.array_position(F.transform(a, lambda n: text(n["id"])), F.col("fragment")).cast("int")
        ends = F.transform(a, lambda n, i: F.when((i >= at) & n["tag"].isin(*HEADINGS) & n["id"].isNotNull(), i))
        end = F.coalesce(F.array_min(F.array_compact(ends)), F.size(a))
        hit = (text(F.col("fragment")) != "") & (at > 0)
        return F.when(hit, F.slice(a, at, F.greatest(end - at + 1, F.lit(1)))).otherwise(a)

    lines = F.filter(F.transform(bind(nodes, cut), lambda n: n["text"]), lambda x: x != "")
    return asked.select("recipe_id", F.array_join(lines, "\n").alias("text"))
