"""Queries on the text functions, over whole document lines and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import ingredients as I
from larder.functions import metadata as M
from larder.functions import text as T
from larder.sources import views


def _lines(spark, d):
    return views.documents(spark, d).select("recipe_id", F.posexplode("lines").alias("line_no", "line"))


def _written(spark, d):
    """Document lines in the ways ingredient lines are written."""
    form, line = (F.col("recipe_id") + F.col("line_no")) % 12, F.col("line")
    shape = F.element_at(F.array(*[F.lit(s) for s in I.PASTA_SHAPES]), (F.col("recipe_id") % 13 + 1).cast("int"))
    cheese = F.element_at(F.array(*[F.lit(s) for s in I.CHEESES_WITHOUT_SUFFIX]), (F.col("recipe_id") % 8 + 1).cast("int"))
    raw = (
        F.when(form == 0, F.concat(F.lit("200g "), line))
        .when(form == 1, F.concat(F.lit("1 1/2 cups "), line))
        .when(form == 2, F.concat(F.lit("Optional: the "), line, F.lit(" (chopped)")))
        .when(form == 3, F.concat(F.lit("½ tsp of "), line, F.lit(", finely sliced")))
        .when(form == 4, F.concat(F.lit("2 x 400g tins "), line))
        .when(form == 5, F.concat(F.lit("a "), line))
        .when(form == 6, F.lit("The Goat's cheese"))
        .when(form == 7, F.concat(shape, F.lit(" Pasta ("), line, F.lit(")")))
        .when(form == 8, F.concat(F.lit("about 3-4 tablespoons "), line, F.lit(" plus extra for frying")))
        .when(form == 9, F.concat(cheese, F.lit("  Cheese")))
        .when(form == 10, F.concat(F.lit("pinch "), line))
        .otherwise(line)
    )
    return _lines(spark, d).select("recipe_id", "line_no", raw.alias("raw"))


def normalize_ingredient(spark, d):
    return _written(spark, d).select("recipe_id", "line_no", I.normalize_ingredient(F.col("raw")).alias("name"))


def canonical_ingredient(spark, d):
    return _written(spark, d).select("recipe_id", "line_no", I.canonical_ingredient(F.col("raw")).alias("name"))


def ingredient_payload(spark, d):
    item = F.when(F.col("line_no") % 2 == 0, F.col("raw"))
    payload = I.ingredient_payload(F.concat(F.lit(" "), "raw"), F.lit(""), item=item)
    return _written(spark, d).select("recipe_id", "line_no", payload.alias("p")).select("recipe_id", "line_no", "p.*")


def index_name(spark, d):
    canonical = F.when(F.col("line_no") % 3 == 0, F.col("raw"))
    normalized = F.when(F.col("line_no") % 3 == 1, F.col("raw"))
    return _written(spark, d).select("recipe_id", "line_no", I.index_name(canonical, normalized, F.col("raw")).alias("name"))


def parse_ingredient_line(spark, d):
    return _written(spark, d).select("recipe_id", "line_no", I.parse_ingredient_line(F.col("raw")).alias("p")).select(
        "recipe_id", "line_no", "p.*"
    )


def _source_name(source):
    def query(spark, d):
        return _written(spark, d).select("recipe_id", "line_no", I.source_ingredient_name(F.col("raw"), source).alias("name"))

    return query


def _dirty(spark, d):
    docs = views.documents(spark, d)
    form, title = F.col("recipe_id") % 6, F.col("title")
    dirty = (
        F.when(form == 0, F.concat(title, F.lit(" (Z-Library)")))
        .when(form == 1, F.concat(title, F.lit(" [1Lib.sk, z-lib.org] (kept) ")))
        .when(form == 2, F.concat(title, F.lit(" - z library.sk and more")))
        .when(form == 3, F.concat(F.lit(" -"), title, F.lit(":; ")))
        .when(form == 4, F.lit(" (z library) "))
        .otherwise(title)
    )
    return docs.select("recipe_id", title, dirty.alias("dirty"))


def clean_metadata(spark, d):
    return _dirty(spark, d).select("recipe_id", T.clean_metadata(F.col("dirty")).alias("cleaned"))


def display_title_from_file(spark, d):
    name = F.concat(F.lit("a/b/"), F.translate(F.replace("title", F.lit("/"), F.lit("")), " ", "_"), F.lit("-(ZLibrary.sk)-[1Lib.sk].epub"))
    waitrose = F.concat("title", F.lit(" recipe | Waitrose & Partners.pdf"))
    return _dirty(spark, d).select(
        "recipe_id",
        T.display_title_from_file(name).alias("title"),
        T.source_file_title(waitrose, F.lit("Book"), "waitrose-recipes").alias("source_title"),
    )


def derive_cuisine(spark, d):
    subjects = F.array(F.lit(" (z library)"), F.lit(""), F.col("dirty"), F.lit("lemon-herb o'neil"))
    return _dirty(spark, d).select("recipe_id", T.derive_cuisine(subjects).alias("cuisine"))


def published_at(spark, d):
    dishes = views.dishes(spark, d)
    form, day = F.col("recipe_id") % 6, F.col("created_on")
    given = (
        F.when(form == 0, F.concat(F.lit("D:"), F.date_format(day, "yyyyMMdd"), F.lit("120000")))
        .when(form == 1, F.date_format(day, "MMMM d, yyyy"))
        .when(form == 2, F.date_format(day, "yyyy/MM/dd"))
        .when(form == 3, F.concat(F.lit("c. "), F.date_format(day, "yyyyMM")))
        .when(form == 4, F.lit("1st edition"))
        .otherwise(F.date_format(day, "yyyy-MM"))
    )
    return dishes.select("recipe_id", T.published_at(given).alias("published_at"))


def sort_key(spark, d):
    return _dirty(spark, d).select("recipe_id", T.sort_key(F.col("dirty")).alias("sort_key"))


def _labelled(spark, d):
    form, line = (F.col("recipe_id") + F.col("line_no")) % 9, F.col("line")
    prefixes = ("Serves: ", "makes", "Yield - ", "PREP TIME: ", "Cook time. ", "Chilling  time ", "total time:", "Serves")
    labelled = line
    for i, prefix in enumerate(prefixes):
        value = F.lit(prefix) if prefix == "Serves" else F.concat(F.lit(prefix), line)
        labelled = F.when(form == i, value).otherwise(labelled)
    return _lines(spark, d).select("recipe_id", "line_no", labelled.alias("line"))


def metadata_line(spark, d):
    return _labelled(spark, d).select("recipe_id", "line_no", M.metadata_line(F.col("line")).alias("m")).select(
        "recipe_id", "line_no", "m.key", "m.value"
    )


def merge_metadata(spark, d):
    docs = views.documents(spark, d)
    key = F.col("recipe_id")
    payload = F.create_map(
        F.lit("intro"), F.concat(F.lit(" "), "title"), F.lit("serves"), F.lit("4"), F.lit("makes"), F.lit("  ")
    )
    section = F.create_map(
        F.lit("serves"), F.when(key % 2 == 0, "6").otherwise(""), F.lit("yield"), F.when(key % 3 == 0, F.col("lang")),
        F.lit("supplemental_sections"), F.when(key % 5 == 0, '[{"heading":"Tip"}]').otherwise("[]"),
    )
    merged = F.array_sort(F.transform(F.map_entries(M.merge_metadata(payload, section)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return docs.select(key, F.array_join(merged, "|").alias("metadata"))


def recipe_page_metadata(spark, d):
    docs = views.documents(spark, d)
    key = F.col("recipe_id")
    none = F.lit(None)

    def entry(name, text=none, items=none, sections=none):
        return F.struct(
            F.lit(name).alias("key"), text.cast("string").alias("text"), items.cast("array<string>").alias("items"),
            sections.cast("array<struct<heading:string,lines:array<string>>>").alias("sections"),
        )

    entries = F.array(
        entry("tags", items=F.array("lang", "cookbook_title", "lang")),
        entry("cook_time", F.lit("20  mins")),
        entry("difficulty", F.lit(" Easy ")),
        entry("author", F.col("cookbook_title")),
        entry("intro", F.when(key % 2 == 0, F.concat("title", F.lit("\n\n"), "title"))),
        entry("description", F.concat(F.lit("About "), "title")),
        entry("prep_time", F.when(key % 3 == 0, "5 mins")),
        entry("preparation_notes", items=F.array(F.lit("note"), F.lit(" "), F.lit("note"))),
        entry("supplemental_sections", sections=F.array(
            F.struct(F.lit("Tip").alias("heading"), F.array("title").alias("lines")),
            F.struct(F.lit("").alias("heading"), F.array("title").alias("lines")),
        )),
    )
    excerpt = F.when(key % 3 == 0, F.upper("lang")).otherwise(F.col("title"))
    blocks = docs.select(key, F.posexplode(M.recipe_page(entries, F.col("title"), excerpt)).alias("place", "b"))
    return blocks.select(key, "place", "b.block", "b.heading", F.array_join("b.lines", "|").alias("lines"))


def embedding_text(spark, d):
    docs = views.documents(spark, d)
    items = F.transform(
        "lines", lambda x: F.struct(F.lit("").alias("canonical_name"), F.lit(None).cast("string").alias("normalized_name"), x.alias("raw"))
    )
    return docs.select("recipe_id", M.embedding_text(F.col("title"), items, F.col("lines")).alias("text"))


def excerpt(spark, d):
    docs = views.documents(spark, d)
    return docs.select("recipe_id", T.excerpt(T.text_lines(F.col("text"))).alias("excerpt"))


def inferred_title(spark, d):
    docs = views.documents(spark, d)
    return docs.select("recipe_id", T.inferred_title(F.col("lines")).alias("title"))


def json_in_text(spark, d):
    docs = views.documents(spark, d)
    body = F.to_json(F.struct(F.lit(True).alias("is_recipe"), F.col("text").alias("title")))
    said = F.concat(F.lit("Result: "), body, F.lit(" and no more"))
    parsed = F.from_json(T.json_object_text(said), "is_recipe boolean, title string")
    return docs.select("recipe_id", parsed.alias("p")).select("recipe_id", "p.is_recipe", "p.title")


def epub_path(spark, d):
    pages = views.table(spark, d, "pages")
    key, name = F.col("page_id"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".xhtml"))
    form = key % 8
    href = (
        F.when(form == 0, F.concat(F.lit("../text/"), name, F.lit("#a")))
        .when(form == 1, F.concat(F.lit("/OEBPS/./"), name))
        .when(form == 2, F.lit("#only"))
        .when(form == 3, F.concat(name, F.lit("?q=1")))
        .when(form == 4, F.lit("  "))
        .when(form == 5, F.concat(F.lit("../../../x/../"), name))
        .when(form == 6, F.col("url"))
        .otherwise(F.concat(F.lit("a//b/../"), name))
    )
    return pages.select(
        key, T.epub_path(href, F.lit("OEBPS/nav/toc.xhtml#x")).alias("relative"), T.epub_path(href).alias("bare")
    )


def chapter_label_test(spark, d):
    docs = views.documents(spark, d)
    form, title = F.col("recipe_id") % 7, F.col("title")
    label = (
        F.when(form == 0, F.translate(F.upper("lang"), "", ""))
        .when(form == 1, F.concat(F.lit("Chapter "), title))
        .when(form == 2, F.concat(F.lit("3. "), title))
        .when(form == 3, F.concat(F.lit("12 - "), title))
        .when(form == 4, F.lit(" Index: "))
        .when(form == 5, F.lit("1234"))
        .otherwise(title)
    )
    return docs.select(
        "recipe_id", T.is_ignored_chapter_label(label).alias("ignored"), T.looks_like_chapter_label(label).alias("chapter")
    )


QUERIES = {
    f.__name__: f
    for f in (
        normalize_ingredient, canonical_ingredient, ingredient_payload, index_name, parse_ingredient_line,
        clean_metadata, display_title_from_file, derive_cuisine, published_at, sort_key, metadata_line,
        merge_metadata, recipe_page_metadata, embedding_text, excerpt, inferred_title, json_in_text, epub_path,
        chapter_label_test,
    )
}
QUERIES |= {
    "name_nytimes": _source_name("nytimes"),
    "name_jamie": _source_name("jamie-oliver"),
    "name_bbc": _source_name("bbc-goodfood"),
    "name_waitrose": _source_name("waitrose-recipes"),
}
