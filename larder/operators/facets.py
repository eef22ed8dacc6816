"""Ingredient facets over the inverted index ``(name, recipe_id)``, distinct pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.ingredients import canonical_ingredient, index_name


def facet_names(spark: SparkSession, values: Sequence[str]) -> list[str]:
    """Canonical, distinct facet names of a request, in request order; commas separate names."""
    parts = [part.strip() for value in values for part in (value or "").split(",")]
    if not parts:
        return []
    names = F.array(*[canonical_ingredient(F.lit(part)) for part in parts])
    return spark.range(1).select(ordered_distinct(names).alias("names")).first()["names"]


def ordered_distinct(values: Column) -> Column:
    """Distinct non-empty values of an array; the first occurrence keeps its place."""
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def ingredient_index(lines: DataFrame) -> DataFrame:
    """Distinct (name, recipe_id) from ingredient lines.

    Pairs, not one set per name: a name that a third of all dishes use never sits in one row.
    """
    named = lines.select(
        "recipe_id", index_name(F.col("canonical_name"), F.col("normalized_name"), F.col("raw")).alias("name")
    )
    return named.where(F.col("name") != "").distinct()


def facet_and(index: DataFrame, names: Sequence[str]) -> DataFrame:
    """Dishes that hold every name, by recipe id (relational division)."""
    wanted = facet_names(index.sparkSession, names)
    if not wanted:
        return index.select("recipe_id").limit(0)
    hits = index.where(F.col("name").isin(*wanted)).select("recipe_id")
    if len(wanted) > 1:
        hits = hits.groupBy("recipe_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
    return hits.select("recipe_id").orderBy("recipe_id")


def facet_in_cookbook(
    dishes: DataFrame, index: DataFrame, cookbook_id: int | str, names: Sequence[str]
) -> DataFrame:
    """Dishes of one cookbook that hold every name, in cookbook order."""
    mine = dishes.where(F.col("cookbook_id") == cookbook_id).select("recipe_id", "cookbook_id", "position")
    return mine.join(facet_and(index, names), "recipe_id", "left_semi").orderBy("position")


def _ordered(counts: DataFrame, limit: int | None) -> DataFrame:
    ordered = counts.orderBy(F.desc("recipe_count"), F.asc("name"))
    return ordered if limit is None else ordered.limit(limit)


def facet_counts(index: DataFrame, limit: int | None = None) -> DataFrame:
    return _ordered(index.groupBy("name").agg(F.count("*").alias("recipe_count")), limit)


def facet_prefix(index: DataFrame, q: str, limit: int | None = None) -> DataFrame:
    """Facet counts of the names that start with the query."""
    return facet_counts(index.where(F.startswith(F.col("name"), canonical_ingredient(F.lit(q)))), limit)


def facet_minus(index: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct facet names other than the selected ones."""
    return index.select("name").distinct().where(~F.col("name").isin(*facet_names(index.sparkSession, names)))


def facet_drilldown(
    index: DataFrame, names: Sequence[str], q: str | None = None, limit: int | None = None
) -> DataFrame:
    """Counts of the other names among the dishes that hold every selected name.

    With a query, only names that contain it.
    """
    others = index.where(~F.col("name").isin(*facet_names(index.sparkSession, names)))
    if q:
        others = others.where(F.contains(F.col("name"), canonical_ingredient(F.lit(q))))
    return facet_counts(others.join(facet_and(index, names), "recipe_id", "left_semi"), limit)


def facet_substring(index: DataFrame, names: Sequence[str], q: str) -> DataFrame:
    return facet_drilldown(index, names, q)


def posting_intersect(index: DataFrame, names: Sequence[str]) -> DataFrame:
    """Dishes in every posting list, by intersecting the lists."""
    lists = [
        index.where(F.col("name") == name).select("recipe_id")
        for name in facet_names(index.sparkSession, names)
    ]
    return reduce(DataFrame.intersect, lists)


def rank_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids that are in either ranking."""
    return left.select("recipe_id").union(right.select("recipe_id")).distinct()
