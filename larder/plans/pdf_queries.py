"""Queries on the PDF layouts. Each document is set as a file of every source's layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import pdf_templates as P
from larder.sources import views

BLOCK = "array<struct<page:int,x0:double,y0:double,text:string>>"


def _block(page, x, y, text):
    def number(v):
        return v if not isinstance(v, (int, float)) else F.lit(float(v))

    shown = F.lit(text) if isinstance(text, str) else text
    return F.struct(F.lit(page).alias("page"), number(x).cast("double").alias("x0"), number(y).cast("double").alias("y0"), shown.alias("text"))


def _files(spark, d, fixed, lines, width=600.0, pages=2):
    """Fixed blocks, then one block per document line placed by ``lines(line, i)``."""
    docs = views.documents(spark, d)
    body = F.transform("lines", lines)
    blocks = F.concat(F.array(*fixed(docs)).cast(BLOCK), body.cast(BLOCK))
    return docs.select(
        F.col("recipe_id").alias("file_id"), F.concat("title", F.lit(".pdf")).alias("file_name"),
        F.col("cookbook_title"), F.lit(width).alias("page_width"), F.lit(pages).alias("page_count"), blocks.alias("blocks"),
    )


def _nyt(spark, d):
    def fixed(_docs):
        return [
            _block(1, 30, 60, F.concat(F.lit("Dish "), F.col("recipe_id").cast("string"))),
            _block(1, 30, 100, F.concat(F.lit("By  "), "cookbook_title")),
            _block(1, 30, 110, "Updated May 2, 2024"), _block(1, 30, 120, "Total Time 35 minutes"),
            _block(1, 30, 150, F.concat(F.lit("About "), "lang")), _block(1, 30, 200, "INGREDIENTS"), _block(1, 30, 205, "Yield: 4 servings"),
            _block(1, 300, 200, F.when(F.col("recipe_id") % 9 == 0, "METHOD").otherwise("PREPARATION")), _block(1, 300, 210, "Ratings 4"),
            _block(1, 300, 215, "Heat the oven."),
        ]

    def line(text, i):
        text, left = F.lower(text), i % 3 == 0
        marked = F.when(i % 3 == 1, F.concat(F.lit("Step "), i.cast("string"))).otherwise(text)
        return _block(1, F.when(left, 30.0).otherwise(300.0), 300 + i * 5, F.when(left, F.concat(i.cast("string"), F.lit(" "), text)).otherwise(marked))

    return P.pdf_nytimes(_files(spark, d, fixed, line))


def _shown(parsed):
    meta = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    sections = F.transform("supplemental_sections", lambda s: F.concat(s["heading"], F.lit(": "), F.array_join(s["lines"], "; ")))
    return parsed.select(
        "file_id", "title", F.array_join(meta, "|").alias("metadata"),
        F.array_join(F.transform("ingredients", lambda i: i["raw"]), "|").alias("ingredients"),
        F.array_join("method_steps", "|").alias("steps"), F.array_join("preparation_notes", "|").alias("notes"),
        F.array_join(sections, "|").alias("sections"), "reason",
    )


def pdf_nytimes(spark, d):
    return _shown(_nyt(spark, d)).drop("sections")


def pdf_jamie(spark, d):
    def fixed(_docs):
        return [
            _block(1, 30, 60, "BIG DISH"), _block(1, 30, 100, "1 HOUR 20 MINS"), _block(1, 200, 100, "SUPER EASY"), _block(1, 400, 100, "SERVES 4"),
            _block(1, 30, 200, "INGREDIENTS"), _block(1, 300, 200, "METHOD"), _block(1, 30, 9000000, "TOP TIP: Rest it."),
        ]

    def line(text, i):
        form = i % 4
        x = F.when(form < 2, 30.0).when(form == 2, 300.0).otherwise(330.0)
        said = F.when(form == 0, F.concat(F.lit("100g "), text)).when(form == 2, i.cast("string")).otherwise(text)
        return _block(1, x, 300 + F.floor(i / 2) * 20 + F.when(form == 3, 5).otherwise(0), said)

    return _shown(P.pdf_jamie(_files(spark, d, fixed, line)))


def _bbc(spark, d):
    def fixed(_docs):
        return [
            _block(1, 30, 100, F.concat(F.lit("Dish "), F.col("recipe_id").cast("string"))),
            _block(1, 30, 130, F.when(F.col("recipe_id") % 8 == 0, "").otherwise(F.col("cookbook_title"))),
            _block(1, 30, 160, "Makes 12 squares Easy"), _block(1, 30, 180, "Prep: 10 mins  Cook: 20 mins"), _block(1, 30, 190, "plus cooling"),
            _block(1, 30, 230, F.concat(F.lit("About "), "lang")), _block(1, 30, 280, "Vegetarian"), _block(1, 30, 370, "Ingredients"),
            _block(1, 30, 1000000, "Method"),
        ]

    def line(text, i):
        form = i % 4
        said = F.when(form == 0, F.concat(F.lit("2 "), text)).when(form == 2, F.concat(F.lit("Step "), i.cast("string"))).otherwise(text)
        return _block(1, 30, F.when(form < 2, 400 + i * 10).otherwise(2000000 + i * 10), said)

    return P.pdf_bbc(_files(spark, d, fixed, line))


def pdf_bbc(spark, d):
    return _shown(_bbc(spark, d)).drop("sections")


def pdf_waitrose(spark, d):
    def fixed(_docs):
        return [
            _block(1, 30, 400, F.concat(F.lit("Dish "), F.col("recipe_id").cast("string"))), _block(1, 30, 480, F.concat(F.lit("About "), "lang")),
            _block(1, 30, 640, "Serves 4"), _block(1, 30, 660, "Course Lunch"), _block(1, 30, 680, "Prepare 10 mins"),
            _block(1, 30, 700, F.when(F.col("recipe_id") % 7 == 0, "Bake 5 mins").otherwise("Cook 5 mins")), _block(1, 30, 720, "Total time 15 mins"),
            _block(2, 30, 10, "Ingredients"), _block(2, 30, 9000, "Method"),
        ]

    def line(text, i):
        return _block(2, F.when(i % 2 == 0, 30.0).otherwise(350.0), 100 + i, text)

    files = _files(spark, d, fixed, line)
    docs = views.documents(spark, d)
    words = F.transform(
        F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "),
        lambda w, i: F.struct(
            F.lit(2).alias("page"), F.when(i % 5 == 0, 30.0).otherwise(60.0).alias("x0"), (9000.2 + F.floor(i / 5) * 0.2).alias("y0"),
            F.when(i % 5 == 0, (i / 5 + 1).cast("int").cast("string")).otherwise(F.concat(F.lit("w"), w)).alias("text"),
        ),
    )
    worded = files.join(docs.select(F.col("recipe_id").alias("file_id"), words.alias("words")), "file_id")
    return _shown(P.pdf_waitrose(worded)).drop("sections", "notes")


def row_cluster(spark, d):
    """Lines as blocks that drift down the page, clustered into rows."""
    docs = views.documents(spark, d)
    blocks = F.transform("lines", lambda line, i: F.struct(
        F.floor(i / 7).alias("page"), ((i * 4) % 28 + F.floor(i / 3) * 3).cast("double").alias("y0"), (100 - i).cast("double").alias("x0"),
        i.alias("at"), line.alias("text")))
    ordered = docs.select("recipe_id", F.array_sort(blocks).alias("blocks"))
    rows = ordered.select("recipe_id", F.posexplode(P.row_cluster(F.col("blocks"))).alias("row_no", "row"))
    return rows.select("recipe_id", "row_no", F.array_join(F.transform("row", lambda b: b["at"].cast("string")), "|").alias("blocks"))


def template_rejects(spark, d):
    return P.template_rejects(_nyt(spark, d), "nytimes").union(P.template_rejects(_bbc(spark, d), "bbc-goodfood"))


def bulk_reprocess_report(spark, d):
    return P.bulk_reprocess_report(_nyt(spark, d))


QUERIES = {
    f.__name__: f
    for f in (pdf_nytimes, pdf_jamie, pdf_bbc, pdf_waitrose, row_cluster, template_rejects, bulk_reprocess_report)
}
