"""Queries on documents: nodes, sections, fields, candidates, drafts, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import documents as D
from larder.operators import profiles, routing
from larder.sources import html, pdf, views


def _pages(spark, d):
    return views.table(spark, d, "pages").select("page_id", "html")


def html_nodes(spark, d):
    return html.html_nodes(_pages(spark, d)).select(
        "page_id", "seq", "tag", F.array_join("classes", " ").alias("classes"), "id", "text"
    )


def html_nodes_nested(spark, d):
    """Pages with lists in lists, paragraphs in items and blocks in paragraphs around their own text."""
    before = (
        '<ul class="a b"><li>one <p id="two">two</p> three <ul><li>deep<li>deeper <img src="i.png"> x</ul> up</li><li><div>a</div> b</li>'
        '</ul><h2>head <i id="h">of</i> it</h2>lost<table><tr><td>cell <p>in cell</td></tr></table><article><div><p>p '
    )
    start = F.concat(F.lit(before), F.col("page_id").cast("string"), F.lit("</p></div></article><h1>"))
    nested = F.replace(F.replace("html", F.lit("<h1>"), start), F.lit("<b>"), F.lit("<div><p>inner</p> mid</div><b>"))
    return html.html_nodes(_pages(spark, d).withColumn("html", nested)).select(
        "page_id", "seq", "tag", F.array_join("classes", " ").alias("classes"), "id", "src", "text"
    )


def nav_html_skip(spark, d):
    pages = views.table(spark, d, "pages")
    form = F.col("page_id") % 5
    name = (
        F.when(form == 0, "OEBPS/Nav.xhtml").when(form == 1, "nav.x").when(form == 2, "toc-nav.html")
        .when(form == 3, "text/navy.html").otherwise(F.col("url"))
    )
    return D.nav_html_skip(pages.select("page_id", name.alias("doc")))


def sectionize(spark, d):
    return D.sectionize(_pages(spark, d)).select(
        "page_id", "section_no", "heading", F.array_join("lines", "\n").alias("lines")
    )


def html_sections(spark, d):
    return D.html_sections(_pages(spark, d)).select(
        "page_id", "section_no", "section_key", "chapter_title", "has_heading", "text", "excerpt"
    )


def toc_from_html(spark, d):
    return html.toc_from_html(_pages(spark, d), base=F.lit("OEBPS/nav.xhtml"))


def dedupe_consecutive(spark, d):
    talk = views.table(spark, d, "conversations")
    lines = F.split(F.concat("text", F.lit("\n"), F.upper("role"), F.lit("\n "), "role", F.lit("\n\n"), "role"), "\n")
    return talk.select("conv_id", "turn", F.array_join(D.dedupe_consecutive(lines), "|").alias("lines"))


def _sections(spark, d):
    """Sections of the documents: whole texts after the openings dishes have."""
    docs = views.documents(spark, d)
    form = F.col("recipe_id") % 6
    opening = (
        F.when(form == 0, "Serves 4\n200g flour\n2 eggs\n1 tsp salt\n")
        .when(form == 1, "A word first\nIngredients:\n200g flour\n1 egg, beaten\nPrep time: 5 mins\nMethod\nStep 1\n")
        .when(form == 2, "")
        .when(form == 3, "Recipe list\n")
        .when(form == 4, "Makes 2\nServes 3\n2 cups water\n")
        .otherwise("Method\n1. Start here\n2) Go on\nIngredients\n3 eggs\nTotal time: \n")
    )
    title = F.when(form == 4, "").when(F.col("recipe_id") % 7 == 0, "Introduction").otherwise(F.col("title"))
    ref = F.when(F.col("recipe_id") % 11 == 0, "text/copyright.xhtml#1").otherwise(
        F.concat(F.lit("text/c"), F.col("recipe_id").cast("string"), F.lit(".xhtml#1"))
    )
    return docs.select(
        F.col("cookbook_title").alias("cookbook_id"), "recipe_id", title.alias("chapter_title"), ref.alias("section_key"),
        ref.alias("anchor"), F.concat(opening, "text").alias("text"),
        F.when(F.col("recipe_id") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("images"),
    )


def recipe_candidate(spark, d):
    return D.candidate_sections(_sections(spark, d)).select("recipe_id", "chapter_title")


def section_fields(spark, d):
    fields = D.section_fields(_sections(spark, d))
    meta = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return fields.select(
        "recipe_id", F.array_join(meta, "|").alias("metadata"), F.array_join("ingredient_lines", "|").alias("ingredient_lines"),
        F.array_join("method_lines", "|").alias("method_lines"),
    )


def method_steps(spark, d):
    docs = views.documents(spark, d)
    lines = F.transform(
        "lines",
        lambda x, i: F.when((i + F.col("recipe_id")) % 5 == 0, F.concat(F.lit("step "), i.cast("string")))
        .when((i + F.col("recipe_id")) % 5 == 2, F.concat(i.cast("string"), F.lit(". "), x))
        .otherwise(x),
    )
    return docs.select("recipe_id", F.array_join(D.method_steps(lines), "|").alias("steps"))


def deterministic_gate(spark, d):
    return D.gate_path(D.section_fields(_sections(spark, d))).where(F.col("path").isNotNull()).select("recipe_id", "path")


def deterministic_drafts(spark, d):
    drafts = D.deterministic_drafts(D.section_fields(_sections(spark, d)))
    return drafts.select(
        "recipe_id", "title", F.size("ingredients").alias("ingredients"), F.size("method_steps").alias("steps"),
        "confidence", "review_status", F.array_join("review_reasons", "|").alias("review_reasons"),
        F.col("ingredients")[0]["normalized_name"].alias("first_name"),
    )


def review_flags(spark, d):
    docs = views.documents(spark, d)
    key = F.col("recipe_id")
    drafts = docs.select(
        key, ((key % 100) / 100.0).alias("confidence"), F.slice("lines", 1, (key % 4).cast("int")).alias("ingredients"),
        F.slice("lines", 1, (key % 3).cast("int")).alias("method_steps"), F.slice("lines", 1, (key % 5).cast("int")).alias("images"),
    )
    return D.review_flags(drafts).select("recipe_id", "review_status", F.array_join("review_reasons", "|").alias("review_reasons"))


def caption_attach(spark, d):
    """Conversation turns as pages of a book; each second reply repeats the question as a caption."""
    talk = views.table(spark, d, "conversations")
    even = F.col("turn") % 2 == 0
    title = F.concat(F.lit("Talk "), (F.col("conv_id") % 9).cast("string"))
    pages = talk.select(
        "conv_id", "turn", title.alias("chapter_title"), even.alias("has_heading"),
        F.when(even | (F.col("turn") % 4 == 1), F.upper(title)).otherwise(F.lit("elsewhere")).alias("excerpt"),
        F.array(F.concat(F.lit("img"), F.col("turn").cast("string"))).alias("images"),
    )
    done = D.caption_attach(pages, ["conv_id"], [F.asc("turn")], ["turn"])
    return done.select("conv_id", "turn", F.array_join("images", "|").alias("images"))


def pdf_page_sections(spark, d):
    talk = views.table(spark, d, "conversations")
    pages = talk.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("page"), "text")
    return pdf.pdf_page_sections(pages)


def pdf_blocks(spark, d):
    docs = views.table(spark, d, "conversations")
    block = F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("\u00a0 ")), F.lit("\n"))
    raw = docs.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("page"), F.when(F.col("turn") == 1, "\u00a0\n").otherwise(block).alias("text"))
    return pdf.pdf_blocks(raw)


def page_range_text(spark, d):
    talk = views.table(spark, d, "conversations")
    pages = talk.select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).alias("page"), "text")
    key = F.col("file_id")
    dishes = pages.select("file_id").distinct().select(
        "file_id", key.alias("recipe_id"), F.when(key % 3 != 0, key % 3).cast("bigint").alias("page_start"),
        F.when(key % 2 == 0, F.lit(3)).cast("bigint").alias("page_end"),
    )
    return pdf.page_range_text(pages, dishes)


def _classed(spark, d):
    """Documents set in the paragraph classes of three profiles."""
    docs = views.documents(spark, d)
    clean = F.translate("text", "<>&", "   ")
    classes = {
        0: ("rt", "ri", "ri", "rd", ""),
        1: ("recipe_header", "ingred", "center", "indented", ""),
        2: ("rec_head", "ingredient_list", "mc_intro", "method", "other"),
    }
    kind = F.col("recipe_id") % 3

    def paragraph(line, i):
        name = F.lit("")
        for k, names in classes.items():
            chosen = F.element_at(F.array(*[F.lit(n) for n in names]), (i % 5 + 1).cast("int"))
            name = F.when(kind == k, chosen).otherwise(name)
        start = F.when(name == "", F.lit("<p>")).otherwise(F.concat(F.lit('<p class="'), name, F.lit('" id="n'), i.cast("string"), F.lit('">')))
        return F.concat(start, line, F.lit('</p><img src="i'), i.cast("string"), F.lit('.png">'))

    return docs.select("recipe_id", F.array_join(F.transform(F.split(clean, "\n"), paragraph), "").alias("html"))


def profile_match(spark, d):
    return profiles.profile_match(_classed(spark, d), doc="recipe_id").where(F.col("profile").isNotNull())


def profile_sections(spark, d):
    rows = profiles.profile_sections(_classed(spark, d), doc="recipe_id")
    return rows.select(
        "recipe_id", "profile", "section_no", "anchor", "chapter_title", F.size("images").alias("images"),
        F.array_join("ingredient_lines", "|").alias("ingredient_lines"), F.array_join("method_lines", "|").alias("method_lines"),
    )


def anchor_text(spark, d):
    docs = _classed(spark, d).withColumnRenamed("recipe_id", "doc")
    asked = docs.select(F.col("doc").alias("recipe_id"), "doc", F.when(F.col("doc") % 4 == 0, "none").otherwise("n1").alias("fragment"))
    return D.anchor_text(docs, asked)


def targeted_reextract(spark, d):
    sections = D.section_fields(_sections(spark, d))
    asked = _sections(spark, d).where(F.col("chapter_title") != "Introduction").select("cookbook_id", "anchor")
    existing = _sections(spark, d).where(F.size("images") > 0).select("cookbook_id", "anchor")
    done = D.targeted_reextract(sections.withColumnRenamed("recipe_id", "section"), asked, existing, [F.asc("section")], ["section"])
    return done.select("section", "cookbook_id", "anchor", "position", "recipe_id")


def books(spark, d):
    """Every four documents as an e-book: one in a profile's classes, one plain, a caption page, a navigation file."""
    docs = views.documents(spark, d)
    key = F.col("recipe_id")
    clean = F.translate("text", "<>&", "   ")
    classes = F.array(*[F.lit(c) for c in ("rt", "ri", "ri", "rd", "rd")])
    opening = F.array(*[F.lit(o) for o in ("Dish ", "200g ", "200g ", "", "")])

    def classed(line, i):
        at = (i % 5 + 1).cast("int")
        return F.concat(
            F.lit('<p class="'), F.element_at(classes, at), F.lit('" id="n'), i.cast("string"), F.lit('">'),
            F.element_at(opening, at), line, F.lit("</p>"),
        )

    lines = F.split(clean, "\n")
    end = '<p class="rt" id="end">Dish end</p><p class="ri">3 eggs</p><p class="ri">200g salt</p><p class="rd">Stir.</p>'
    title = F.concat(F.lit("Soup "), key.cast("string"))
    plain = F.concat(
        F.lit("<h2>"), title, F.lit('</h2><img src="i.png"><p>Serves 4</p><ul><li>200g flour</li><li>2 eggs</li></ul><p>Method</p>'),
        F.array_join(F.transform(lines, lambda line: F.concat(F.lit("<p>"), line, F.lit("</p>"))), ""),
    )
    before = F.concat(F.lit("SOUP-"), (key - 1).cast("string"))
    caption = F.concat(F.lit('<img src="c.png"><p>'), F.when(F.floor(key / 4) % 3 == 0, "other").otherwise(before), F.lit("</p>"))
    form = key % 4
    html = (
        F.when(form == 0, F.concat(F.array_join(F.transform(lines, classed), ""), F.lit(end)))
        .when(form == 1, plain).when(form == 2, caption).otherwise(F.concat(F.lit("<p>Serves 9</p><p>200g x</p>"), plain))
    )
    name = F.when(form == 3, "nav.xhtml").otherwise(F.concat(F.lit("text/c"), key.cast("string"), F.lit(".xhtml")))
    return docs.select(F.floor(key / 4).cast("bigint").alias("cookbook_id"), key.alias("doc_no"), name.alias("doc"), html.alias("html"))


def book_drafts(spark, d):
    """From the files of e-books to numbered drafts."""
    drafts = routing.book_drafts(books(spark, d))
    return drafts.select(
        "cookbook_id", "recipe_id", "anchor", "position", "title", "profile", F.size("ingredients").alias("ingredients"),
        F.size("method_steps").alias("steps"), F.array_join("images", "|").alias("images"), "review_status",
    )


QUERIES = {
    f.__name__: f
    for f in (
        html_nodes, html_nodes_nested, nav_html_skip, sectionize, html_sections, toc_from_html, dedupe_consecutive, recipe_candidate,
        section_fields, method_steps, deterministic_gate, deterministic_drafts, review_flags, caption_attach,
        pdf_page_sections, pdf_blocks, page_range_text, profile_match, profile_sections, anchor_text, targeted_reextract,
        book_drafts,
    )
}
