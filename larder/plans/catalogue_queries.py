"""Queries on cookbooks, listings, roll-ups, table changes and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import catalogue, ordering
from larder.session import cut_lineage
from larder.sources import files, views
from larder.sources.shelves import Shelves
from larder.streaming.jobs import scratch


def _raw_cookbooks(spark, d):
    """Cookbooks as the all-text hash they are stored in."""
    books = views.cookbooks(spark, d)
    key = F.col("cookbook_id")

    def stored(c):
        return F.coalesce(c.cast("string"), F.lit(""))

    return books.select(
        key.cast("string").alias("cookbook_id"), "title", stored(F.col("author")).alias("author"), "cuisine",
        stored(F.col("collection_slug")).alias("collection_slug"), stored(F.col("published_at")).alias("published_at"),
        (key * 1000).cast("string").alias("size_bytes"),
        F.when(key % 4 == 0, "uploaded").when(key % 4 == 1, "queued").otherwise("extracted").alias("status"),
        stored(F.col("recipe_count")).alias("recipe_count"), F.lit("").alias("needs_review_count"),
        F.lit("").alias("extract_error"),
    )


def hydrate_cookbooks(spark, d):
    return catalogue.hydrate_cookbooks(_raw_cookbooks(spark, d))


def _stored_recipes(spark, d):
    docs = views.documents(spark, d)
    line = F.transform(
        "lines", lambda x: F.struct(x.alias("raw"), x.alias("normalized_name"), F.lit(None).cast("string").alias("canonical_name"))
    )
    body = F.struct(
        F.lit("stale").alias("id"), F.col("cookbook_title").alias("cookbook_id"),
        F.concat("cookbook_title", F.lit(" (Z-Library)")).alias("cookbook_title"), "title", line.alias("ingredients"),
        F.array(F.lit("old")).alias("ingredient_names"),
    )
    return docs.select("recipe_id", F.to_json(body).alias("payload"))


def hydrate_recipes(spark, d):
    found = catalogue.hydrate_recipes(_stored_recipes(spark, d), views.toggles(spark, d))
    return found.select(
        "recipe_id", "cookbook_id", "cookbook_title", "title",
        F.array_join("ingredient_names", "|").alias("ingredient_names"), "is_favorite", "is_want_to_try",
    )


def recipe_references(spark, d):
    docs = views.documents(spark, d).select(
        "recipe_id", F.col("cookbook_title").alias("cookbook_id"),
        F.concat("cookbook_title", F.lit(" - z library")).alias("cookbook_title"), "title",
    )
    stored = docs.where(F.col("cookbook_id") != "src1").withColumn("title", F.concat(F.lit("* "), "title"))
    return catalogue.recipe_references(docs, stored)


def _listing(spark, d):
    """A file listing: one file per customer."""
    books = views.table(spark, d, "customer")
    key = F.col("c_custkey")
    extension = F.element_at(F.array(*[F.lit(e) for e in (".PDF", ".epub", ".txt", "", ".mobi")]), (key % 5 + 1).cast("int"))
    name = F.concat(F.lit("ebooks/"), F.lower("c_mktsegment"), F.lit("/the_"), F.lower("c_name"), F.lit("-(ZLibrary.sk)"), extension)
    return books.select(
        name.alias("object_name"),
        F.when(key % 7 == 0, 0).when(key % 11 == 0, key * 1000000000).otherwise(key).alias("size_bytes"),
        F.timestamp_seconds(1577836800 + (key * 7919) % 1000003).alias("last_modified"),
    )


def stage_files(spark, d):
    return files.stage_files(_listing(spark, d)).select("object_name", "size_bytes", "reason")


def list_objects(spark, d):
    return files.list_objects(_listing(spark, d)).withColumn("uploaded_at", F.unix_timestamp("uploaded_at"))


def object_keys(spark, d):
    dishes = views.dishes(spark, d)
    name = F.concat(F.lit(" my "), "priority", F.lit("  (final)! .pdf"))
    return dishes.select(
        "recipe_id",
        files.object_key(F.col("cookbook_id"), name, F.col("created_on")).alias("object_key"),
        files.image_key(F.col("cookbook_id"), F.col("recipe_id"), F.lit(1), F.lit("***")).alias("image_key"),
    )


def library_filter(spark, d):
    return catalogue.library_filter(views.cookbooks(spark, d)).select("cookbook_id", "title")


def recipe_scan_order(spark, d):
    return catalogue.recipe_scan_order(views.dishes(spark, d), views.cookbooks(spark, d)).select("recipe_id", "listing_order")


def _sorted_by(by):
    def query(spark, d):
        books = views.cookbooks(spark, d).select("cookbook_id", "title", "author", "cuisine", "published_at")
        return catalogue.sort_cookbooks(books, by).select("cookbook_id", "rank")

    return query


def collection_members(spark, d):
    members = catalogue.collection_members("jamie-oliver", views.dishes(spark, d), views.cookbooks(spark, d), views.toggles(spark, d))
    return members.select("recipe_id", "position")


def collection_members_favourites(spark, d):
    members = catalogue.collection_members("favorites", views.dishes(spark, d), views.cookbooks(spark, d), views.toggles(spark, d))
    return members.select("recipe_id", "event_id")


def recipe_flags(spark, d):
    return catalogue.recipe_flags(views.dishes(spark, d).select("recipe_id"), views.toggles(spark, d))


def collection_semi(spark, d):
    return catalogue.collection_semi(views.dishes(spark, d), views.cookbooks(spark, d), "nytimes").select("recipe_id", "cookbook_id")


def prev_next(spark, d):
    found = catalogue.recipe_neighbours(views.dishes(spark, d), views.cookbooks(spark, d))
    return found.select("list", "recipe_id", "rank", "previous_id", "next_id")


def recipe_total(spark, d):
    return catalogue.recipe_total(views.cookbooks(spark, d))


def collection_counts(spark, d):
    return catalogue.collection_counts(views.dishes(spark, d), views.cookbooks(spark, d), views.toggles(spark, d))


def needs_review_counts(spark, d):
    return catalogue.needs_review_counts(views.dishes(spark, d))


def ingest_rollup(spark, d):
    return catalogue.ingest_rollup(views.cookbooks(spark, d), views.dishes(spark, d))


def _tagged(spark, d):
    docs = views.documents(spark, d)
    key = F.col("recipe_id")
    return docs.select(
        F.col("cookbook_title").alias("cookbook_id"), "recipe_id",
        F.when(key % 5 != 0, F.array(F.concat(F.lit(" "), "lang"), F.col("lang"), F.lit(""), F.substring("title", 1, 1))).alias("tags"),
        F.when(key % 3 == 0, F.array(F.lit("missing_method_steps"), F.lit("missing_method_steps"))).otherwise(F.array(F.lit("too_few_ingredients"))).alias("needs_review_reasons"),
        F.when(key % 4 == 0, F.array(F.lit("a.png"))).otherwise(F.array().cast("array<string>")).alias("images"),
    )


def _sources(spark, d):
    return views.documents(spark, d).select(F.col("cookbook_title").alias("cookbook_id")).distinct()


def cookbook_management(spark, d):
    return catalogue.cookbook_management(_sources(spark, d), _tagged(spark, d))


def photo_percent(spark, d):
    return catalogue.photo_percent(_sources(spark, d), _tagged(spark, d))


def tag_recipe_join(spark, d):
    """Cookbooks with their dishes, the join under the management roll-up."""
    dishes = views.dishes(spark, d).select("cookbook_id", "recipe_id", "review_status")
    return views.cookbooks(spark, d).select("cookbook_id", "title").join(dishes, "cookbook_id")


def management_groups(spark, d):
    books = views.cookbooks(spark, d)
    slug = F.when(F.col("cookbook_id") % 9 == 0, "unknown-slug").otherwise(F.col("collection_slug"))
    return catalogue.management_groups(books.withColumn("collection_slug", slug))


def group_by_chapter(spark, d):
    dishes = views.dishes(spark, d)
    return catalogue.group_by_chapter(dishes.select("cookbook_id", "recipe_id", "position", F.col("priority").alias("label")))


def _stored_lines(spark, d):
    lines = views.ingredients(spark, d)
    return lines.select(
        "recipe_id", "raw", F.lit(None).cast("string").alias("item"),
        F.when(F.col("line_no") % 5 == 0, F.upper("name")).otherwise(F.col("name")).alias("normalized_name"),
        F.when(F.col("line_no") % 3 == 0, F.concat("name", F.lit(" cheese"))).otherwise(F.col("name")).alias("canonical_name"),
    )


def backfill_diff(spark, d):
    return catalogue.backfill_diff(_stored_lines(spark, d), views.ingredient_index(spark, d).where(F.col("name") != "small ring"))


def ingredient_index(spark, d):
    from larder.operators.facets import ingredient_index as build

    return build(_stored_lines(spark, d))


def _library(spark, d):
    """Cookbooks, dishes, index names and vectors as stored tables in a fresh folder."""
    dishes = views.dishes(spark, d).select("cookbook_id", "recipe_id", "position", "review_status", "priority")
    owner = dishes.select("recipe_id", "cookbook_id")
    tables = {
        "index": views.ingredient_index(spark, d).join(owner, "recipe_id"),
        "vectors": views.vectors(spark, d).join(owner, "recipe_id"),
        "dishes": dishes,
        "cookbooks": views.cookbooks(spark, d).select("cookbook_id", "title", "author"),
    }
    return Shelves.create(spark, scratch(spark, "library"), tables, buckets=16)


def _numbers(vector):
    """All numbers of a vector in millionths."""
    return F.array_join(F.transform(vector, lambda x: F.floor(x.cast("double") * 1000000)), ",")


def _stored_rows(shelves):
    """The rows of all stored tables, read back."""
    detail = {
        "index": F.col("name"), "vectors": _numbers(F.col("embedding")), "cookbooks": F.col("title"),
        "dishes": F.concat_ws("|", F.col("position").cast("string"), "review_status"),
    }
    parts = [
        shelves.read(name).select(
            F.lit(name).alias("table"), "cookbook_id",
            (F.lit(None).cast("bigint") if name == "cookbooks" else F.col("recipe_id")).alias("recipe_id"),
            detail[name].alias("detail"),
        )
        for name in shelves.tables
    ]
    return reduce(DataFrame.unionByName, parts)


def replace_by_cookbook(spark, d):
    """Cookbooks with an urgent dish are read again: their urgent dishes come back, with other names."""
    shelves = _library(spark, d)
    urgent = shelves.read("dishes").where(F.col("priority") == "1-URGENT")
    names = shelves.read("index").join(urgent.select("recipe_id"), "recipe_id")
    moved = F.col("recipe_id") + 1000000
    new = {
        "dishes": urgent.withColumns({"recipe_id": moved, "review_status": F.lit("pending_review")}),
        "index": names.withColumns({"recipe_id": moved, "name": F.upper("name")}),
    }
    # What is new is read from the tables that change, so it is written before they do.
    catalogue.replace_by_cookbook(shelves, {name: cut_lineage(df) for name, df in new.items()})
    return _stored_rows(shelves).where(F.col("table") != "cookbooks")


def _drafts(spark, d):
    dishes = views.dishes(spark, d)
    existing = dishes.where(F.col("review_status") == "verified").select(
        "cookbook_id", "recipe_id", F.concat(F.lit("p"), (F.col("recipe_id") % 40).cast("string")).alias("anchor")
    )
    key = F.col("recipe_id")
    anchor = F.when(key % 7 == 0, "").otherwise(F.concat(F.lit(" p"), (key % 41).cast("string"), F.lit(" ")))
    drafts = dishes.where(F.col("review_status") != "verified").select("cookbook_id", key.alias("draft_no"), anchor.alias("anchor"))
    return drafts, existing


def new_anchor_anti(spark, d):
    return catalogue.new_anchor_anti(*_drafts(spark, d))


def append_new_anchors(spark, d):
    drafts, existing = _drafts(spark, d)
    return catalogue.append_new_anchors(drafts, existing, [F.asc("draft_no")], ["draft_no"])


def positions(spark, d):
    drafts, existing = _drafts(spark, d)
    return ordering.positions(drafts, existing, [F.asc("draft_no")], ["draft_no"]).select("cookbook_id", "draft_no", "position")


def cascade_delete(spark, d):
    shelves = _library(spark, d)
    catalogue.cascade_delete(shelves, views.cookbooks(spark, d).where(F.col("author").isNull()))
    return _stored_rows(shelves)


def vector_upsert(spark, d):
    """Every vector is stored; those that begin above zero are stored again, backwards and with a title."""
    vectors = views.vectors(spark, d).withColumn("cookbook_id", F.col("recipe_id") % 50)
    current = vectors.withColumn("title", F.lit("old"))
    shelves = Shelves.create(spark, scratch(spark, "vectors"), {"vectors": current}, buckets=16)
    new = vectors.where(F.element_at("embedding", 1) > 0).select(
        "recipe_id", "cookbook_id", F.reverse("embedding").alias("embedding")
    )
    catalogue.vector_upsert(shelves, views.documents(spark, d).select("recipe_id", "title"), new)
    return shelves.read("vectors").select("recipe_id", "cookbook_id", _numbers(F.col("embedding")).alias("numbers"), "title")


def top_images(spark, d):
    docs = views.documents(spark, d).select("recipe_id", F.col("lines").alias("images"))
    return catalogue.top_images(docs).select("recipe_id", F.array_join("images", "|").alias("images"))


QUERIES = {
    f.__name__: f
    for f in (
        hydrate_cookbooks, hydrate_recipes, recipe_references, stage_files, list_objects, object_keys, library_filter,
        recipe_scan_order, collection_members, collection_members_favourites, recipe_flags, collection_semi, prev_next,
        recipe_total, collection_counts, needs_review_counts, ingest_rollup, cookbook_management, photo_percent,
        tag_recipe_join, management_groups, group_by_chapter, backfill_diff, ingredient_index, replace_by_cookbook,
        new_anchor_anti, append_new_anchors, positions, cascade_delete, vector_upsert, top_images,
    )
}
QUERIES["sort_cookbooks"] = _sorted_by("title")
QUERIES |= {f"sort_cookbooks_{by}": _sorted_by(by) for by in ("author", "cuisine", "published_at")}
