"""Queries on tables of contents and chapters. Each document is a book; its lines are entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.text import first_words
from larder.operators import toc as T
from larder.sources import html, views


def _label(line, i):
    word = first_words(line, 2)
    form = i % 5
    return (
        F.when(form == 0, F.concat(F.lit("Chapter "), i.cast("string")))
        .when(form == 1, F.concat(F.lit("A"), F.upper(F.regexp_extract(line, "[A-Za-z]*", 0))))
        .when(form == 2, F.lit("Index"))
        .when(form == 3, F.concat(F.lit("3. "), word))
        .otherwise(F.concat(F.lit("About "), word))
    )


def _path(n):
    return F.concat(F.lit("t/p"), n.cast("string"))


def _books(spark, d):
    docs = views.documents(spark, d)
    count = F.size("lines")
    entries = F.transform(
        "lines",
        lambda line, i: F.struct(
            _label(line, i).alias("label"),
            _path((i * 3 + F.col("recipe_id")) % (count * 2)).alias("href"),
            F.element_at(F.array(*[F.lit(x) for x in (0, 1, 1, 2)]), (i % 4 + 1).cast("int")).alias("depth"),
            (((i % 4 == 0) | (i % 4 == 2)) & (i + 1 < count)).alias("has_children"),
        ),
    )
    spine = F.transform(F.sequence(F.lit(0), count * 2 - 1), _path)
    dishes = F.filter(spine, lambda p, i: i % 3 == 1)
    return docs.select(
        F.col("recipe_id").alias("cookbook_id"), entries.alias("toc"), spine.alias("spine"), dishes.alias("recipe_paths")
    )


def toc_flatten(spark, d):
    """Entries stored as nested JSON, four to a tree; every fifth book holds broken text."""
    docs = views.documents(spark, d)

    def node(i, children):
        label, href = F.get("lines", i), F.concat(F.lit("p"), i.cast("string"))
        return F.when(i < F.size("lines"), F.struct(label.alias("label"), href.alias("href"), children.alias("children")))

    def tree(k):
        empty = F.array().cast("array<string>")
        leaf = F.array_compact(F.array(node(k * 4 + 3, empty)))
        return node(k * 4, F.array_compact(F.array(node(k * 4 + 1, leaf), node(k * 4 + 2, F.slice(leaf, 1, 0)))))

    trees = F.array_compact(F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 4).cast("int")), tree))
    payload = F.when(F.col("recipe_id") % 5 == 0, F.concat(F.to_json(trees), F.lit("{"))).otherwise(F.to_json(trees))
    books = docs.select(F.col("recipe_id").alias("cookbook_id"), payload.alias("table_of_contents"))
    return T.toc_flatten(books)


def next_sibling(spark, d):
    return T.next_sibling(_books(spark, d)).select("cookbook_id", "seq", "at", "next_at")


def chapter_map(spark, d):
    return T.chapter_map(_books(spark, d))


def chapter_map_plain(spark, d):
    return T.chapter_map(_books(spark, d).withColumn("recipe_paths", F.array().cast("array<string>")))


def collapse_markers(spark, d):
    """Markers of every book, collapsed both ways."""
    books = _books(spark, d)
    markers = F.array_sort(
        F.transform("toc", lambda e, i: F.struct((i % 3).cast("int").alias("start"), e["depth"].alias("depth"), i.alias("place"), e["label"].alias("label")))
    ).cast(T.MARKERS)
    both = [
        books.select("cookbook_id", F.lit(deep).alias("deep"), F.explode(T.collapse_markers(markers, deep)).alias("m"))
        for deep in (True, False)
    ]
    return both[0].union(both[1]).select("cookbook_id", "deep", "m.start", "m.depth", "m.label")


def spine_asof(spark, d):
    books = _books(spark, d)
    markers = F.transform("toc", lambda e, i: F.struct((i * 2 + 1).cast("int").alias("start"), e["label"].alias("label")))
    rows = books.select("cookbook_id", F.posexplode(T.spine_asof(markers, F.col("spine"))).alias("idx", "p"))
    return rows.select("cookbook_id", "idx", "p.path", "p.label")


def facet_catalog_stats(spark, d):
    scored = T.facet_catalog_stats(_books(spark, d))
    return scored.select("cookbook_id", "score.s1", "score.s2", "score.s3")


def best_toc(spark, d):
    """Two candidates per book: the entries, and their first half."""
    books = _books(spark, d)
    half = books.withColumn("toc", F.slice("toc", 1, F.floor(F.size("toc") / 2).cast("int")))
    both = half.withColumn("candidate", F.lit(0)).unionByName(books.withColumn("candidate", F.lit(1)))
    return T.best_toc(both).select("cookbook_id", "candidate", F.size("toc").alias("entries"))


def _recipes(spark, d):
    """Three dishes per book, anchored in its files."""
    docs = views.documents(spark, d)
    key = F.col("recipe_id")
    picks = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(step).alias("step")) for i, step in enumerate((0, 3, 6, 40))])
    rows = docs.select(key.alias("cookbook_id"), "title", F.size("lines").alias("n"), F.explode(picks).alias("p"))
    form = (F.col("cookbook_id") + F.col("p.position")) % 4
    path = _path((F.col("p.step") + F.col("cookbook_id")) % (F.col("n") * 2))
    return rows.select(
        "cookbook_id",
        (F.col("cookbook_id") * 10 + F.col("p.position")).alias("recipe_id"),
        F.col("p.position").cast("bigint").alias("position"),
        "title",
        F.when(form == 0, F.upper(F.lit("own"))).when(form == 1, F.col("title")).otherwise("").alias("chapter_title"),
        F.when(form == 3, F.lit("x/chapter-12.xhtml#a")).otherwise(F.concat(path, F.lit("#a"))).alias("anchor"),
        F.when(F.col("cookbook_id") % 5 == 0, "pdf").otherwise("epub").alias("format"),
        F.concat(F.lit("Soups, "), "title").alias("excerpt"),
    )


def chapter_label(spark, d):
    return T.chapter_label(_recipes(spark, d), T.chapter_map(_books(spark, d))).select("recipe_id", "label")


def section_from_toc(spark, d):
    rows = T.section_from_toc(_recipes(spark, d), _books(spark, d).select("cookbook_id", "toc"))
    return rows.select("cookbook_id", "recipe_id", "section", F.col("post.seq").alias("entry"))


def order_sections(spark, d):
    books = _books(spark, d)
    labels = books.select("cookbook_id", F.posexplode(T.toc_labels(F.col("toc"))).alias("seq", "label"))
    sections = books.select(
        "cookbook_id",
        F.posexplode(F.concat(F.array(F.lit("Index"), F.lit("Index"), F.lit("Nowhere")), F.reverse(T.toc_labels(F.slice("toc", 1, 3))))).alias("section_no", "title"),
    )
    return T.order_sections(sections, labels).select("cookbook_id", "section_no", "title", "toc_seq", "rank")


def toc_from_ncx(spark, d):
    """Navigation files with a nested point in each point."""
    docs = views.documents(spark, d)
    points = F.transform(
        F.split(F.translate("text", "<>&", "   "), "\n"),
        lambda line, i: F.concat(
            F.lit("<navPoint><navLabel><text>"), F.when(i % 4 == 3, "").otherwise(line), F.lit('</text></navLabel><content src="a/p'),
            i.cast("string"), F.lit('.xhtml#x"/><navPoint><navLabel><text>Sub</text></navLabel><content src="s.xhtml"/></navPoint></navPoint>'),
        ),
    )
    end = F.when(F.col("recipe_id") % 6 == 0, "<navPoint>").otherwise("")
    xml = F.concat(F.lit("<ncx><navMap>"), F.array_join(points, ""), end, F.lit("</navMap></ncx>"))
    return html.toc_from_ncx(docs.select(F.col("recipe_id").alias("doc"), xml.alias("xml")), base=F.lit("OEBPS/toc.ncx"))


QUERIES = {
    f.__name__: f
    for f in (
        toc_flatten, next_sibling, chapter_map, chapter_map_plain, collapse_markers, spine_asof, facet_catalog_stats,
        best_toc, chapter_label, section_from_toc, order_sections, toc_from_ncx,
    )
}
