"""Golden cases of the text functions."""

import pytest
from pyspark.sql import functions as F

from larder.functions import ingredients as I
from larder.functions import metadata as M
from larder.functions import plan_text as P
from larder.functions import text as T


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("feta cheese", "feta"), ("orzo pasta", "orzo"), ("mozzarella cheese", "mozzarella"),
        ("cream cheese", "cream cheese"), ("goat cheese", "goat cheese"), ("blue cheese", "blue cheese"),
        ("Goat's cheese", "goat cheese"), ("Optional: the Fusilli Pasta (dried)", "fusilli"), ("Straße", "strasse"),
        ("crème fraîche", "cr me fra che"), ("", ""),
    ],
)
def test_canonical_ingredient(one, raw, want):
    assert one(I.canonical_ingredient(F.lit(raw))) == want


def test_index_name_falls_back(one):
    none = F.lit(None).cast("string")
    assert one(I.index_name(F.lit("feta"), F.lit("feta cheese"), F.lit("200g feta cheese"))) == "feta"
    assert one(I.index_name(none, F.lit("feta cheese"), F.lit("x"))) == "feta"
    assert one(I.index_name(none, F.lit(""), F.lit("orzo pasta"))) == "orzo"


def test_parse_ingredient_line(one):
    got = one(I.parse_ingredient_line(F.lit("  2 tbsp  of olive oil (light), plus extra - optional")))
    assert (got["quantity"], got["unit"], got["item"]) == ("2", "tbsp", "olive oil")
    assert got["preparation"] == "plus extra - optional" and got["optional"]
    assert got["normalized_name"] == "olive oil"
    plain = one(I.parse_ingredient_line(F.lit("salt")))
    assert plain["quantity"] is None and plain["unit"] is None and plain["item"] == "salt"


@pytest.mark.parametrize(
    ("source", "raw", "want"),
    [
        ("nytimes", "1 1/2 cups flour (sifted), packed", "flour"),
        ("nytimes", "2 to 3 tablespoons of honey", "honey"),
        ("jamie-oliver", "2 x 400 g tins chopped tomatoes", "g tins chopped tomatoes"),
        ("jamie-oliver", "Optional: 1 tbsp harissa", "harissa"),
        ("bbc-goodfood", "200g plain flour", "plain flour"),
        ("waitrose-recipes", "Handful basil leaves", "basil leaves"),
    ],
)
def test_source_names(one, source, raw, want):
    assert one(I.source_ingredient_name(F.lit(raw), source)) == want


def test_shopping_label(one):
    choice = "1.5 litres organic chicken, ham or vegetable stock"
    assert one(I.shopping_label(F.lit(choice), F.lit("stock"))) == choice
    assert one(I.shopping_label(F.lit("2 limes"), F.lit("lime"))) == "lime"
    assert one(I.shopping_label(F.lit("LIME"), F.lit("lime"))) == "lime"


def test_library_suffixes(one):
    assert one(T.display_title_from_file(F.lit("the-cookbook-(ZLibrary.sk)-[1Lib.sk].epub"))) == "The Cookbook"
    assert one(T.clean_metadata(F.lit("Thirty Meals (Some Author) (Z Library.Sk, 1Lib.Sk, Z Lib.Sk)"))) == "Thirty Meals (Some Author)"
    assert one(T.title_case(F.lit("lemon-herb o'neil"))) == "Lemon-Herb O'Neil"


@pytest.mark.parametrize(
    ("given", "want"),
    [("D:20190517", "2019-05-17"), ("June 13, 2025", "2025"), ("2019/05", "2019-05"), ("201905", "2019-05"), ("x", ""), (None, "")],
)
def test_published_at(one, given, want):
    assert one(T.published_at(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(
    ("href", "base", "want"),
    [
        ("../text/a.xhtml#x", "OEBPS/nav/toc.xhtml", "OEBPS/text/a.xhtml"), ("/abs/b.html?q", "x/y", "abs/b.html"),
        ("#only", "x/y.html", "x/y.html"), ("http://a/b", "x", ""), ("../../../a", "b/c", "a"), ("", "b", ""), ("a/./b/../c", "", "a/c"),
    ],
)
def test_epub_path(one, href, base, want):
    assert one(T.epub_path(F.lit(href), F.lit(base))) == want


def test_json_in_text(one):
    said = 'Result: {"is_recipe": true, "title": "Soup", "n": {"a": 1}} thanks'
    assert one(F.from_json(T.json_object_text(F.lit(said)), "title string"))["title"] == "Soup"


def test_metadata_line(one):
    assert one(M.metadata_line(F.lit("Serves: 4"))).asDict() == {"key": "serves", "value": "4"}
    assert one(M.metadata_line(F.lit("prep  time - 5 minutes"))).asDict() == {"key": "prep_time", "value": "5 minutes"}
    assert one(M.metadata_line(F.lit("Makes"))).asDict() == {"key": "makes", "value": "Makes"}
    assert one(M.metadata_line(F.lit("Stir well"))) is None


def _entry(key, text=None, items=None, sections=None):
    return (key, text, items, sections)


ENTRIES = "entries array<struct<key:string,text:string,items:array<string>,sections:array<struct<heading:string,lines:array<string>>>>>"


def test_recipe_page(spark):
    rows = [
        ([
            _entry("intro", "First.\n\nSecond."), _entry("description", "About it"), _entry("difficulty", "Easy"), _entry("yield", "4"),
            _entry("author", "A"), _entry("prep_time", "5 mins"), _entry("total_time", "20 mins"), _entry("tags", items=["x", "y", "x"]),
            _entry("preparation_notes", items=["n"]), _entry("supplemental_sections", sections=[("Tip", ["t", "t"]), ("", ["u"])]),
        ], "Title", "Excerpt"),
        ([], "Title", "Other"), ([], "Title", "title"),
    ]
    df = spark.createDataFrame(rows, f"{ENTRIES}, title string, excerpt string")
    full, other, same = [
        [(b["block"], b["heading"], b["lines"]) for b in r["p"]]
        for r in df.select(M.recipe_page(F.col("entries"), F.col("title"), F.col("excerpt")).alias("p")).collect()
    ]
    assert full == [
        ("summary", "Author", ["A"]), ("summary", "Yield", ["4"]), ("summary", "Timing", ["Total 20 mins · Prep 5 mins"]),
        ("summary", "Difficulty", ["Easy"]), ("intro", "Introduction", ["First.", "Second."]), ("text", "Description", ["About it"]),
        ("list", "Notes", ["n"]), ("list", "Tags", ["x", "y"]), ("section", "Tip", ["t"]),
    ]
    assert other == [("intro", "Excerpt", ["Other"])]
    assert same == []


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Monday - Lentil dahl", "lentil daal|monday lentil daal"),
        ("Dinner Fish pies (Friday)", "dinner fish pies|dinner fish pies friday|fish pies friday"),
        ("Pasta (tomato sauce)", "pasta|pasta tomato sauce|tomato sauce"),
    ],
)
def test_title_variants(one, title, want):
    assert "|".join(one(P.title_variants(F.lit(title)))) == want


@pytest.mark.parametrize(
    ("heading", "want"),
    [
        ("2024-04-14", "2024-04-14"), ("Week of 12 April 2024", "2024-04-12"), ("11 apr", "2024-04-11"), ("5 Sep 99", "1999-09-05"),
        ("Week 17 Jan", ""), ("31 Feb 2024", ""), ("29 Feb", ""), ("29 Feb 2024", "2024-02-29"), ("soon", ""),
    ],
)
def test_week_start(one, heading, want):
    assert one(P.week_start(F.lit(heading), 2024)) == want


def test_build_entry(one):
    entry = one(P.bulleted_entry(F.lit("- [x] Fish pie like last week https://example.com/p")))
    assert entry["title"] == "Fish pie" and entry["is_complete"] and entry["external_url"] == "https://example.com/p"
    assert one(P.bulleted_entry(F.lit("plain words"))) is None
    assert not one(P.build_entry(F.lit("Tally out")))["is_recipe"]


def test_entries_read_their_line_once(spark, one):
    rows = spark.createDataFrame([("- [X] Pie like a https://e.com/p",)], "t string")
    plan = rows.select(P.bulleted_entry(F.col("t")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(t#") <= 3 and plan.count(P.BULLET) == 1
    # White space that is one blank already is not replaced.
    assert one(F.regexp_count(F.lit("a b c"), F.lit(T.WS_RUN))) == 0
    assert one(F.regexp_count(F.lit("a  b\u00a0c \t d\te "), F.lit(T.WS_RUN))) == 4


def test_blank_to_null_evaluates_its_text_once(spark):
    rows = spark.createDataFrame([("",), (None,), ("a",), (" ",)], "t string")
    assert [r["v"] for r in rows.select(T.blank_to_null(F.col("t")).alias("v")).collect()] == [None, None, "a", " "]
    inner = T.bind(F.col("t"), lambda t: T.blank_to_null(F.upper(T.blank_to_null(F.reverse(t)))))
    plan = rows.select(inner.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1


def test_first_words_stops_after_them(spark):
    texts = ["a b  c\u00a0d", "\u3000 a\n\tb ", "", " \n", None, "word", "a b", "x" * 5000 + " y z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["v"] for r in rows.select(T.first_words(F.col("t"), 2).alias("v")).collect()]
    assert got == [None if t is None else " ".join(t.split()[:2]) for t in texts]
    plan = rows.select(T.first_words(F.col("t"), 2).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(t" not in plan


def test_white_space_of_any_kind_is_squashed(one):
    marks = "".join(f"x{c}{c} y" for c in T.WS_CHARS)
    assert one(T.squash(F.lit(f" {marks}​﻿ "))) == f"{' '.join(marks.split())}​﻿"
    assert "&&" in str(T.squash(F.lit("a")))


def test_normalising_searches_for_brackets_only_where_some_are(spark, one):
    assert one(I.normalize_ingredient(F.lit("OPTIONAL: the Gruß　(a) b ( c"))) == "gruss b c"
    assert one(I.normalize_ingredient(F.lit("not optional: a"))) == "not optional a"
    rows = spark.createDataFrame([("a",)], "t string")
    plan = rows.select(I.normalize_ingredient(F.col("t")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan
    assert plan.count("lower(") == 1
