"""Cookbook and recipe tables: hydration, listings, roll-ups and changes.

Changes are whole-table results (anti joins and unions); a caller writes them where it keeps
its tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.ingredients import index_name, ingredient_payload
from larder.functions.text import blank_to_null, clean_metadata, published_at, sort_key, strip, text
from larder.operators.ordering import positions, prev_next, ranked
from larder.sources.shelves import Shelves
from larder.session import computed_once, cut_lineage

# The built-in collections and the management groups, in shown order.
COLLECTIONS = {
    "favourites": "Favourites",
    "want-to-try": "Want To Try",
    "nytimes": "NYTimes",
    "jamie-oliver": "Jamie Oliver",
    "bbc-goodfood": "BBC Good Food",
    "waitrose-recipes": "Waitrose Recipes",
}
MANAGEMENT_GROUPS = {
    "books": "Books",
    "nytimes": "NYTimes",
    "jamie-oliver": "Jamie Oliver",
    "bbc-goodfood": "BBC Good Food",
    "waitrose-recipes": "Waitrose Recipes",
}
TOGGLE_COLLECTIONS = {"favourites": "favourite", "want-to-try": "want_to_try"}
SLUG_ALIASES = {"favorites": "favourites"}
NO_RECIPES = "No recipe candidates were extracted."
LINE = (
    "struct<raw:string,normalized_name:string,canonical_name:string,quantity:string,unit:string,"
    "item:string,preparation:string,optional:boolean>"
)
RECIPE_SCHEMA = (
    f"id string, cookbook_id string, cookbook_title string, title string, ingredients array<{LINE}>, "
    "ingredient_names array<string>, method_steps array<string>, "
    "images array<struct<object_key:string,content_type:string,source_ref:string>>, "
    "source struct<object_key:string,format:string,chapter_title:string,page_start:int,page_end:int,"
    "anchor:string,excerpt:string,metadata:variant>, "
    "extraction struct<model:string,confidence:double,notes:array<string>,extracted_at:string,"
    "needs_review_reasons:array<string>>, "
    "review struct<status:string,note:string,reviewed_at:string>"
)


# --- reading ---------------------------------------------------------------------------------


def hydrate_cookbooks(raw: DataFrame) -> DataFrame:
    """Typed cookbooks of an all-text table: empty text is NULL, missing counts are zero."""
    status = text(F.col("status"))
    typed = {
        "size_bytes": F.col("size_bytes").try_cast("bigint"),
        "recipe_count": F.coalesce(F.col("recipe_count").try_cast("int"), F.lit(0)),
        "needs_review_count": F.coalesce(F.col("needs_review_count").try_cast("int"), F.lit(0)),
        "status": F.when(status.isin("", "uploaded"), "staged").otherwise(status),
    }
    optional = [
        c for c in (
            "author", "cuisine", "published_at", "collection_slug", "extract_attempted_at", "extract_completed_at",
            "extract_error", "cover_image_key", "cover_image_content_type", "cover_extract_attempted_at",
            "metadata_extract_attempted_at",
        ) if c in raw.columns
    ]
    return raw.withColumns({**typed, **{c: blank_to_null(F.col(c)) for c in optional}})


def ingredient_names(lines: Column) -> Column:
    """Sorted distinct index names of a recipe's ingredient structs."""
    named = F.transform(lines, lambda i: index_name(i["canonical_name"], i["normalized_name"], i["raw"]))
    return F.array_sort(F.array_distinct(F.filter(named, lambda n: n != "")))


def cleaned_title(c: Column) -> Column:
    return F.coalesce(blank_to_null(clean_metadata(c)), c)


def toggle_state(toggles: DataFrame) -> DataFrame:
    """Current switches: the last write per (kind, recipe) decides, and its time is the score."""
    last = toggles.groupBy("kind", "recipe_id").agg(
        F.max_by(F.struct("is_on", "ts", "event_id"), F.struct("ts", "event_id")).alias("last")
    )
    return last.where("last.is_on").select("kind", "recipe_id", "last.ts", "last.event_id")


def recipe_flags(dishes: DataFrame, toggles: DataFrame) -> DataFrame:
    """Whether each recipe is a favourite and on the want-to-try list."""
    state = toggle_state(toggles).groupBy("recipe_id").agg(
        F.bool_or(F.col("kind") == "favourite").alias("is_favorite"),
        F.bool_or(F.col("kind") == "want_to_try").alias("is_want_to_try"),
    )
    off = F.lit(False)
    return dishes.join(state, "recipe_id", "left").withColumns(
        {"is_favorite": F.coalesce("is_favorite", off), "is_want_to_try": F.coalesce("is_want_to_try", off)}
    )


def hydrate_recipes(stored: DataFrame, toggles: DataFrame) -> DataFrame:
    """Dishes of stored documents ``(recipe_id, payload)``.

    Names are recomputed from the ingredient lines, and the key wins over the stored id.
    """
    parsed = stored.select("recipe_id", F.from_json("payload", RECIPE_SCHEMA).alias("r")).select("recipe_id", "r.*").drop("id")
    names = ingredient_names(F.coalesce("ingredients", F.array().cast(f"array<{LINE}>")))
    return recipe_flags(
        parsed.withColumns({"cookbook_title": cleaned_title(F.col("cookbook_title")), "ingredient_names": names}), toggles
    )


def recipe_references(dishes: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Thin recipe rows; where a stored projection is missing the full recipe gives it."""
    own = dishes.select("recipe_id", "cookbook_id", "cookbook_title", "title")
    if references is not None:
        kept = references.select(
            "recipe_id", *[F.col(c).alias(f"stored_{c}") for c in ("cookbook_id", "cookbook_title", "title")]
        )
        own = own.join(kept, "recipe_id", "left").select(
            "recipe_id", *[F.coalesce(f"stored_{c}", c).alias(c) for c in ("cookbook_id", "cookbook_title", "title")]
        )
    return own.withColumn("cookbook_title", cleaned_title(F.col("cookbook_title")))


# --- listings --------------------------------------------------------------------------------


def library_filter(cookbooks: DataFrame, include_collection_items: bool = False) -> DataFrame:
    return cookbooks if include_collection_items else cookbooks.where(F.col("collection_slug").isNull())


def scan_order() -> list[Column]:
    """Cookbooks newest first, then dishes by position."""
    return [F.desc("uploaded_epoch"), F.asc("cookbook_id"), F.asc("position")]


def recipe_scan_order(dishes: DataFrame, cookbooks: DataFrame) -> DataFrame:
    """All dishes with their place in the unfiltered listing."""
    dated = dishes.join(cookbooks.select("cookbook_id", "uploaded_epoch"), "cookbook_id")
    return ranked(dated, scan_order(), name="listing_order")


def sort_cookbooks(cookbooks: DataFrame, by: str = "title") -> DataFrame:
    """Cookbooks in library order, ``rank`` giving the place.

    By title, author or cuisine, missing values come last. By publication date the whole key is
    reversed, so titles descend too. Any other order means by title.
    """
    second = {"author": "title", "cuisine": "title"}.get(by, "author")
    first = by if by in ("author", "cuisine") else "title"
    if by in ("published_at", "published", "date_published"):
        date = published_at(F.col("published_at"))
        order = [F.desc(date != ""), F.desc(date), F.desc(sort_key(F.col("title"))), F.asc("cookbook_id")]
    else:
        primary, secondary = sort_key(F.col(first)), sort_key(F.col(second))
        order = [
            F.asc(primary == ""), F.asc(F.coalesce(blank_to_null(primary), secondary)), F.asc(secondary), F.asc("cookbook_id"),
        ]
    return ranked(cookbooks, order)


def collection_semi(dishes: DataFrame, cookbooks: DataFrame, slug: str) -> DataFrame:
    """Dishes of the cookbooks that carry the slug."""
    mine = cookbooks.where(F.col("collection_slug") == slug).select("cookbook_id")
    return dishes.join(mine, "cookbook_id", "left_semi")


def collection_members(slug: str, dishes: DataFrame, cookbooks: DataFrame, toggles: DataFrame) -> DataFrame:
    """Dishes of a collection with sort columns ``score`` (toggle time) or ``position``.

    Favourites and want-to-try come latest toggle first; an unknown slug has no members.
    """
    slug = SLUG_ALIASES.get(slug, slug)
    if slug in TOGGLE_COLLECTIONS:
        state = toggle_state(toggles).where(F.col("kind") == TOGGLE_COLLECTIONS[slug])
        return dishes.join(state.select("recipe_id", "ts", "event_id"), "recipe_id").orderBy(
            F.desc("ts"), F.desc("event_id")
        )
    if slug not in COLLECTIONS:
        return dishes.limit(0)
    return collection_semi(dishes, cookbooks, slug)


def recipe_neighbours(dishes: DataFrame, cookbooks: DataFrame) -> DataFrame:
    """Previous and next recipe: within the cookbook's collection, else within the cookbook."""
    own = F.coalesce("collection_slug", F.concat(F.lit("cookbook-"), F.col("cookbook_id").cast("string")))
    listed = dishes.join(cookbooks.select("cookbook_id", "collection_slug", "uploaded_epoch"), "cookbook_id")
    members = listed.select(
        own.alias("list"), "recipe_id", F.struct((-F.col("uploaded_epoch")).alias("e"), "cookbook_id", "position").alias("position")
    )
    return prev_next(members, [F.asc("position")], ["list"])


def top_images(sections: DataFrame, n: int = 4) -> DataFrame:
    return sections.withColumn("images", F.slice("images", 1, n))


# --- roll-ups --------------------------------------------------------------------------------


def recipe_total(cookbooks: DataFrame) -> DataFrame:
    return cookbooks.agg(F.coalesce(F.sum(F.coalesce("recipe_count", F.lit(0))), F.lit(0)).alias("recipe_total"))


def _fixed(spark: SparkSession, names: Mapping[str, str]) -> DataFrame:
    """A fixed handful of rows, small enough to broadcast by construction."""
    rows = [(i, slug, title) for i, (slug, title) in enumerate(names.items())]
    return spark.createDataFrame(rows, "place int, slug string, collection_title string")


def collection_counts(dishes: DataFrame, cookbooks: DataFrame, toggles: DataFrame) -> DataFrame:
    """Dishes per built-in collection, zero when empty, in declared order."""
    by_book = dishes.groupBy("cookbook_id").agg(F.count("*").alias("n"))
    slugs = (
        by_book.join(cookbooks.select("cookbook_id", F.col("collection_slug").alias("slug")), "cookbook_id")
        .groupBy("slug").agg(F.sum("n").alias("n"))
    )
    kinds = F.create_map(*(F.lit(v) for s, k in TOGGLE_COLLECTIONS.items() for v in (k, s)))
    switched = (
        toggle_state(toggles).join(dishes.select("recipe_id"), "recipe_id", "left_semi")
        .groupBy(F.element_at(kinds, F.col("kind")).alias("slug")).agg(F.count("*").alias("n"))
    )
    fixed = F.broadcast(_fixed(dishes.sparkSession, COLLECTIONS))
    counts = slugs.union(switched).join(fixed, "slug", "right")
    return counts.select(
        "place", "slug", F.col("collection_title").alias("title"), F.coalesce("n", F.lit(0)).alias("recipe_count")
    )


def needs_review_counts(dishes: DataFrame) -> DataFrame:
    return dishes.groupBy("cookbook_id").agg(
        F.count_if(F.col("review_status") == "needs_review").alias("needs_review_count")
    )


def ingest_rollup(cookbooks: DataFrame, dishes: DataFrame) -> DataFrame:
    """Status, counts and error text of every cookbook after an ingest."""
    counted = dishes.groupBy("cookbook_id").agg(
        F.count("*").alias("dishes"), F.count_if(F.col("review_status") == "needs_review").alias("flagged")
    )
    some = F.coalesce("dishes", F.lit(0)) > 0
    return cookbooks.select("cookbook_id").join(counted, "cookbook_id", "left").select(
        "cookbook_id",
        F.when(some, "extracted").otherwise("partially_extracted").alias("status"),
        F.coalesce("dishes", F.lit(0)).alias("recipe_count"),
        F.coalesce("flagged", F.lit(0)).alias("needs_review_count"),
        F.when(some, F.lit(None)).otherwise(NO_RECIPES).alias("extract_error"),
    )


def photo_percent(cookbooks: DataFrame, dishes: DataFrame) -> DataFrame:
    """Share of dishes with an image, in whole percent, halves to even; 0 without dishes."""
    shares = dishes.groupBy("cookbook_id").agg(
        F.bround(100.0 * F.count_if(F.size("images") > 0) / F.count("*"), 0).cast("int").alias("percent")
    )
    return cookbooks.select("cookbook_id").join(shares, "cookbook_id", "left").select(
        "cookbook_id", F.coalesce("percent", F.lit(0)).alias("photo_recipe_percent")
    )


def cookbook_management(cookbooks: DataFrame, dishes: DataFrame) -> DataFrame:
    """Tag and review-reason counts per cookbook, values distinct within a recipe.

    One row per (cookbook, kind, value) with its rank by count, then value. ``tags`` is NULL for
    a recipe whose tags are not a list.
    """
    tags = F.array_distinct(
        F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: strip(text(t))), lambda t: t != "")
    )
    reasons = F.array_distinct(F.coalesce("needs_review_reasons", F.array().cast("array<string>")))

    def labelled(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    counted = (
        dishes.join(cookbooks.select("cookbook_id"), "cookbook_id", "left_semi")
        .select("cookbook_id", F.explode(F.concat(labelled("tag", tags), labelled("reason", reasons))).alias("v"))
        .groupBy("cookbook_id", "v.kind", "v.value")
        .agg(F.count("*").alias("dishes"))
    )
    return ranked(counted, [F.desc("dishes"), F.asc("value")], ["cookbook_id", "kind"])


def management_groups(cookbooks: DataFrame) -> DataFrame:
    """Cookbooks by management group; unknown slugs and empty groups vanish."""
    slug = F.coalesce(blank_to_null(F.col("collection_slug")), F.lit("books"))
    fixed = F.broadcast(_fixed(cookbooks.sparkSession, MANAGEMENT_GROUPS))
    return cookbooks.withColumn("slug", slug).join(fixed, "slug").select(
        "place", "slug", F.col("collection_title").alias("group_title"), "cookbook_id", "title"
    )


def group_by_chapter(dishes: DataFrame) -> DataFrame:
    """Chapters of each cookbook in order of their first recipe, ``rank`` giving the place."""
    chapters = dishes.groupBy("cookbook_id", "label").agg(
        F.min("position").alias("first_position"), F.count("*").alias("dishes")
    )
    return ranked(chapters, [F.asc("first_position")], ["cookbook_id"])


def backfill_lines(lines: DataFrame) -> DataFrame:
    """Stored ingredient lines next to their recomputed names."""
    fresh = ingredient_payload(F.col("raw"), F.col("normalized_name"), item=F.col("item"))
    return computed_once(lines, "fresh", fresh).select(
        "*",
        (
            ~F.col("canonical_name").eqNullSafe(F.col("fresh.canonical_name"))
            | ~F.col("normalized_name").eqNullSafe(F.col("fresh.normalized_name"))
        ).alias("changed"),
    )


def backfill_diff(lines: DataFrame, stored_names: DataFrame) -> DataFrame:
    """What a re-canonicalisation would change, in one row of counts.

    ``stored_names`` holds the (recipe_id, name) pairs of the stored name lists. A recipe also
    counts as changed when only its name list differs.
    """
    name = index_name(F.col("fresh.canonical_name"), F.col("fresh.normalized_name"), F.col("raw"))
    # Canonicalising is the dear part and feeds two aggregations: keep its narrow result.
    compared = cut_lineage(backfill_lines(lines).select("recipe_id", name.alias("name"), "changed"))
    per_recipe = compared.groupBy("recipe_id").agg(
        F.bool_or("changed").alias("changed"), F.count_if("changed").alias("lines_changed")
    )
    now = compared.select("recipe_id", "name").where(F.col("name") != "").distinct()
    both = now.withColumn("new", F.lit(True)).join(
        stored_names.select("recipe_id", "name").distinct().withColumn("old", F.lit(True)), ["recipe_id", "name"], "full"
    )
    differs = both.where(F.col("new").isNull() | F.col("old").isNull()).select("recipe_id").distinct()
    marked = per_recipe.join(differs.withColumn("differs", F.lit(True)), "recipe_id", "left")
    return marked.agg(
        F.count("*").alias("recipes_scanned"),
        F.count_if(F.col("changed") | F.coalesce("differs", F.lit(False))).alias("recipes_updated"),
        F.sum("lines_changed").alias("ingredients_updated"),
    )


# --- changes ---------------------------------------------------------------------------------


def replace_by_cookbook(shelves: Shelves, new: Mapping[str, DataFrame]) -> None:
    """Store re-extracted cookbooks: their dishes and all child rows give way to those in ``new``.

    ``new`` names ``dishes`` and whichever child tables have new rows; cookbooks are those of the new dishes.
    """
    shelves.replace(new, owners=new["dishes"])


def cascade_delete(shelves: Shelves, cookbook_ids: DataFrame) -> None:
    """Drop cookbooks with their dishes and every child row of these."""
    shelves.delete(cookbook_ids)


def new_anchor_anti(drafts: DataFrame, dishes: DataFrame) -> DataFrame:
    """Drafts whose anchor is not stored for their cookbook; drafts without an anchor stay."""
    stored = dishes.where(text(F.col("anchor")) != "").select(
        "cookbook_id", F.col("anchor").alias("_anchor")
    ).distinct()
    keyed = drafts.withColumn("_anchor", blank_to_null(strip(text(F.col("anchor")))))
    return keyed.join(stored, ["cookbook_id", "_anchor"], "left_anti").drop("_anchor")


def append_new_anchors(
    drafts: DataFrame, existing: DataFrame, order: Sequence[Column], ids: Sequence[str] = ()
) -> DataFrame:
    """Dishes to append: unseen anchors, numbered after the stored ones.

    Repeats inside the batch all stay. Ids derive from cookbook, anchor and position, so a rerun
    writes the same rows. ``ids`` as in ``positions``.
    """
    placed = positions(new_anchor_anti(drafts, existing), existing, order, ids)
    key = F.concat_ws("|", F.col("cookbook_id").cast("string"), text(F.col("anchor")), F.col("position").cast("string"))
    return placed.withColumn("recipe_id", F.sha2(key, 256))


def vector_upsert(shelves: Shelves, dishes: DataFrame, embeddings: DataFrame, table: str = "vectors") -> None:
    """Store the vectors of ``embeddings`` with the payload of their dishes, over old ones of the same recipe.

    Dishes without an embedding get no vector, and embeddings without a dish are not stored.
    """
    shelves.upsert(table, dishes.join(embeddings, "recipe_id"), ["recipe_id"])
