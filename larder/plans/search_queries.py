"""Queries on facets, search, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import facets, ordering, postings, search
from larder.sources import views
from larder.streaming.jobs import scratch

FACETS = ("small ring", "red widget")
POSTING_TERMS = ["thonen", "andtion", "zq", "src12"]
TERMS = "the and thon the"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("matched_terms", F.array_join("matched_terms", "|"))


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The request's vector: that of recipe 0."""
    return views.vectors(spark, sf_dir).where(F.col("recipe_id") == 0).first()["embedding"]


def facet_and(spark, d):
    return facets.facet_and(views.ingredient_index(spark, d), FACETS)


def facet_in_cookbook(spark, d):
    return facets.facet_in_cookbook(views.dishes(spark, d), views.ingredient_index(spark, d), 87, ["small ring"])


def facet_counts(spark, d):
    return facets.facet_counts(views.ingredient_index(spark, d))


def facet_drilldown(spark, d):
    return facets.facet_drilldown(views.ingredient_index(spark, d), FACETS)


def facet_prefix(spark, d):
    return facets.facet_prefix(views.ingredient_index(spark, d), "The Red")


def facet_substring(spark, d):
    return facets.facet_substring(views.ingredient_index(spark, d), FACETS[:1], "a RI")


def posting_intersect(spark, d):
    return facets.posting_intersect(views.ingredient_index(spark, d), FACETS)


def facet_minus(spark, d):
    return facets.facet_minus(views.ingredient_index(spark, d), FACETS)


def ordered_distinct(spark, d):
    """Cleaned words of every document, first occurrence kept."""
    docs = views.documents(spark, d)
    kept = facets.ordered_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "))
    return docs.select("recipe_id", F.array_join(kept, " ").alias("words"))


def rank_union(spark, d):
    scored = search.keyword_score(views.searchable(spark, d), ["thon"])
    near = search.vector_topk(views.vectors(spark, d), _vector(spark, d), 30)
    return facets.rank_union(scored, near)


def keyword_score(spark, d):
    scored = search.keyword_score(views.searchable(spark, d), search.query_terms(TERMS))
    return _flat(scored.select("recipe_id", "score", "matched_terms"))


def keyword_postings(spark, d):
    """The keyword scores of long, short and absent terms, found by an index of grams."""
    dishes = views.searchable(spark, d)
    path = scratch(spark, "postings")
    postings.build_postings(dishes, path)
    scored = postings.indexed_keyword_score(dishes, path, POSTING_TERMS)
    return _flat(scored.select("recipe_id", "score", "matched_terms"))


def keyword_topk(spark, d):
    return search.keyword_topk(views.searchable(spark, d), TERMS, 6)


def rank_map(spark, d):
    scored = search.keyword_score(views.searchable(spark, d), search.query_terms(TERMS))
    return ordering.rank_map(scored.select("recipe_id", "score"))


def vector_topk(spark, d):
    top = search.vector_topk(views.vectors(spark, d), _vector(spark, d), search.fan_out(10))
    return top.select("rank", "recipe_id", F.round("score", 5).alias("score"))


def vector_candidate_join(spark, d):
    top = search.vector_topk(views.vectors(spark, d), _vector(spark, d), search.fan_out(10))
    some = views.documents(spark, d).where(F.col("lang") == "en")
    return search.vector_candidate_join(top, some).select("recipe_id", F.round("score", 5).alias("score"))


def rank_fusion(spark, d):
    kw = ordering.rank_map(search.keyword_score(views.searchable(spark, d), ["thon"]).select("recipe_id", "score"))
    near = search.vector_topk(views.vectors(spark, d), _vector(spark, d), 50)
    return search.rank_fusion(kw, near).select("recipe_id", "keyword_rank", "semantic_rank", F.round("fused", 6).alias("fused"))


def search_keyword(spark, d):
    return _flat(search.search_keyword(views.searchable(spark, d), TERMS, 25)).drop("matched_ingredient")


def search_facets(spark, d):
    return search.search_facets(views.ingredient_index(spark, d), FACETS, 20)


def _doc_index(spark, d):
    return views.documents(spark, d).select("recipe_id", F.col("lang").alias("name"))


def hybrid_search(spark, d):
    found = search.hybrid_search(
        views.searchable(spark, d), _doc_index(spark, d), views.vectors(spark, d),
        q=TERMS, q_vec=_vector(spark, d), ingredients=["en"], limit=20,
    )
    return _flat(found)


def hybrid_search_unlimited(spark, d):
    """Every match ranked: the distributed ranking path."""
    found = search.hybrid_search(
        views.searchable(spark, d), None, views.vectors(spark, d), q="thon", q_vec=_vector(spark, d)
    )
    return found.select("recipe_id", "score", "keyword_score", "semantic_score")


QUERIES = {
    f.__name__: f
    for f in (
        facet_and, facet_in_cookbook, facet_counts, facet_drilldown, facet_prefix, facet_substring,
        posting_intersect, facet_minus, ordered_distinct, rank_union, keyword_score, keyword_postings, keyword_topk,
        rank_map, vector_topk, vector_candidate_join, rank_fusion, search_keyword, search_facets,
        hybrid_search, hybrid_search_unlimited,
    )
}
