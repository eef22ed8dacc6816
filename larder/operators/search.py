"""Keyword, vector and hybrid search.

Query terms and the query vector are request parameters; the corpus is only scanned, never
exploded, and rankings meet in equi joins.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import casefold
from larder.operators.facets import facet_and, facet_names
from larder.operators.ordering import SHORT_LIST, rank_map, top_ranked
from larder.session import computed_once, cut_lineage

# Weight of each searched field, and the rank offset of the fusion.
FIELD_WEIGHTS = {
    "title": 5.0,
    "ingredients": 4.0,
    "ingredient_raw": 3.0,
    "cookbook": 2.0,
    "method": 1.5,
    "source": 1.0,
}
RANK_OFFSET = 60
FACET_BOOST = 0.02


def query_terms(q: str | None) -> list[str]:
    """Terms of a query in order, duplicates kept."""
    return re.sub(r"[^a-z0-9\s-]", " ", (q or "").lower()).split()


def search_fields() -> dict[str, Column]:
    """The searched fields of a dish, lowered."""
    def joined(name: str) -> Column:
        return F.lower(F.array_join(name, " "))

    return {
        "title": F.lower("title"),
        "ingredients": joined("ingredient_names"),
        "ingredient_raw": joined("ingredient_raw"),
        "cookbook": F.lower("cookbook_title"),
        "method": joined("method_steps"),
        "source": F.lower("excerpt"),
    }


def keyword_score(dishes: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Dishes that match any term, with ``score`` and ``matched_terms``.

    A term counts once per field that contains it as a substring; a repeated term counts again.
    """
    lowered = search_fields()
    fields = {name: F.col(f"_fields.{name}") for name in lowered}
    score = F.lit(0.0)
    matched = []
    for term in dict.fromkeys(terms):
        hits = {name: F.contains(field, F.lit(term)) for name, field in fields.items()}
        for name, hit in hits.items():
            score = score + F.when(hit, FIELD_WEIGHTS[name] * terms.count(term)).otherwise(0.0)
        anywhere = F.lit(False)
        for hit in hits.values():
            anywhere = anywhere | hit
        matched.append(F.when(anywhere, F.lit(term)))
    if not matched:
        return dishes.limit(0).select("*", score.alias("score"), F.array().cast("array<string>").alias("matched_terms"))
    found = F.struct(score.alias("score"), F.array_compact(F.array(*matched)).alias("matched_terms"))
    # Fields are lowered once, however many terms read them.
    read = computed_once(dishes, "_fields", F.struct(*[c.alias(name) for name, c in lowered.items()]))
    return computed_once(read, "k", found).drop("_fields").where(F.col("k.score") > 0).select("*", "k.*").drop("k")


def keyword_topk(dishes: DataFrame, q: str, limit: int = 6) -> DataFrame:
    """Suggestions: best keyword score, then title, then cookbook title."""
    scored = keyword_score(dishes, query_terms(q)).select(
        "recipe_id", "title", "cookbook_title", "score"
    )
    order = [
        F.desc("score"), F.asc(casefold(F.col("title"))), F.asc(casefold(F.col("cookbook_title"))),
        F.asc("recipe_id"),
    ]
    return top_ranked(scored, order, max(limit, 0))


def cosine(embedding: Column, q_vec: Sequence[float]) -> Column:
    vector = F.transform(embedding, lambda x: x.cast("double"))
    query = F.array(*[F.lit(float(x)) for x in q_vec])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    dot = total(F.zip_with(vector, query, lambda a, b: a * b))
    norm = F.sqrt(total(F.transform(vector, lambda a: a * a)))
    size = sum(float(x) ** 2 for x in q_vec) ** 0.5
    return F.when(norm > 0, dot / (norm * F.lit(size))).otherwise(0.0)


def fan_out(limit: int) -> int:
    return max(5 * limit, 20)


def vector_topk(vectors: DataFrame, q_vec: Sequence[float], k: int) -> DataFrame:
    """Exact cosine top-k of the whole vector table."""
    scored = vectors.select("recipe_id", cosine(F.col("embedding"), q_vec).alias("score"))
    return top_ranked(scored, [F.desc("score"), F.asc("recipe_id")], k)


def vector_candidate_join(topk: DataFrame, candidates: DataFrame) -> DataFrame:
    """Keep the candidates of a global top-k, so fewer than k rows may remain."""
    return topk.join(candidates.select("recipe_id"), "recipe_id", "left_semi")


def rank_fusion(kw: DataFrame, sem: DataFrame, k: int = RANK_OFFSET, boost: float = 0.0) -> DataFrame:
    """Reciprocal rank fusion of two rankings ``(recipe_id, rank)``."""
    both = kw.select("recipe_id", F.col("rank").alias("keyword_rank")).join(
        sem.select("recipe_id", F.col("rank").alias("semantic_rank")), "recipe_id", "full"
    )

    def part(rank: str) -> Column:
        return F.coalesce(1.0 / (k + F.col(rank)), F.lit(0.0))

    return both.withColumn("fused", part("keyword_rank") + part("semantic_rank") + F.lit(float(boost)))


def _ranks_needed(scored: DataFrame, semantic: DataFrame, limit: int, k: int) -> DataFrame:
    """Keyword ranks of the best ``limit + k`` dishes and of every semantic hit, exactly.

    No other recipe can be among the best ``limit`` after fusion, so the full ranking is never
    built. The rank of a semantic hit is the count of dishes before it: those with a higher
    score, from one count per score, plus earlier ids with the same score.
    """
    order = [F.desc("score"), F.asc("scan_order")]
    best = top_ranked(scored, order, limit + k).select("recipe_id", "rank")
    hits = scored.join(semantic.select("recipe_id"), "recipe_id", "left_semi")
    # The hits of a score part its rows by order: a row is before a hit when no more hits than those before it
    # are at or before the row. Rows are counted by stretch and never joined with single hits.
    marks = hits.groupBy("score").agg(F.array_sort(F.collect_list("scan_order")).alias("marks"))
    stretch = F.size(F.filter(F.coalesce("marks", F.array().cast("array<bigint>")), lambda m: m <= F.col("scan_order")))
    counts = scored.select("score", F.col("scan_order").cast("bigint").alias("scan_order")).join(
        marks.withColumn("marks", F.col("marks").cast("array<bigint>")), "score", "left"
    ).groupBy("score", stretch.alias("stretch")).agg(F.count("*").alias("n"))
    # One row for each score and hit at most.
    total = F.sum("n").over(Window.partitionBy("score"))
    upto = F.sum("n").over(Window.partitionBy("score").orderBy("stretch"))
    counts = counts.select("score", "stretch", upto.alias("upto"), total.alias("total"))
    per_score = counts.groupBy("score").agg(F.max("total").alias("n"))
    above = per_score.select(
        "score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("above")
    )
    place = F.row_number().over(Window.partitionBy("score").orderBy("scan_order"))
    ranked_hits = hits.select("recipe_id", "score", (place - 1).alias("place"))
    level = ranked_hits.join(counts.select("score", "stretch", "upto"), "score").where(F.col("stretch") <= F.col("place"))
    level = level.groupBy("recipe_id").agg(F.max("upto").alias("level"))
    ranked_hits = ranked_hits.join(above, "score").join(level, "recipe_id", "left").select(
        "recipe_id", (F.col("above") + F.coalesce("level", F.lit(0)) + 1).alias("rank")
    )
    return best.union(ranked_hits).distinct()


def hybrid_search(
    dishes: DataFrame,
    index: DataFrame | None,
    vectors: DataFrame | None,
    q: str | None = None,
    q_vec: Sequence[float] | None = None,
    ingredients: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Keyword and vector rankings over the faceted candidates, fused by reciprocal rank.

    ``dishes`` carries the searched fields and ``scan_order``, the listing order. Without a
    limit every match is ranked.
    """
    names = facet_names(dishes.sparkSession, ingredients)
    candidates = dishes
    if names:
        candidates = dishes.join(facet_and(index, names), "recipe_id", "left_semi").withColumn(
            "scan_order", F.col("recipe_id")
        )
    shown = (", ".join(names)) if names else None

    def result(df: DataFrame) -> DataFrame:
        return df.select(
            "recipe_id",
            F.round("score", 5).alias("score"),
            F.round("keyword_score", 5).alias("keyword_score"),
            F.round("semantic_score", 5).alias("semantic_score"),
            "matched_terms",
            F.lit(shown).cast("string").alias("matched_ingredient"),
        )

    def flat(keyword: float) -> DataFrame:
        every = candidates.select("recipe_id", "scan_order").orderBy("scan_order")
        every = every if limit is None else every.limit(limit)
        return result(
            every.select(
                "recipe_id",
                F.lit(1.0).alias("score"),
                F.lit(keyword).alias("keyword_score"),
                F.lit(0.0).alias("semantic_score"),
                F.array().cast("array<string>").alias("matched_terms"),
            )
        )

    if not q:
        return flat(1.0 if names else 0.0)

    # Both sides are read several times below. What is kept of them is narrow, so it is written
    # once instead of scanning texts and vectors again.
    scored = cut_lineage(
        keyword_score(candidates, query_terms(q)).select("recipe_id", "scan_order", "score", "matched_terms")
    )
    k = fan_out(limit if limit is not None else max(candidates.count(), 1))
    if vectors is not None and q_vec is not None and q.strip():
        near = cut_lineage(vector_candidate_join(vector_topk(vectors, q_vec, k), candidates).select("recipe_id", "score"))
    else:
        near = scored.select("recipe_id", "score").limit(0)
    if limit is None or limit + k > SHORT_LIST:
        semantic = rank_map(near)
        keyword = rank_map(scored.select("recipe_id", "scan_order", "score"), tie="scan_order")
    else:
        # At most k rows, so the window is small.
        semantic = near.withColumn(
            "rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("recipe_id"))).cast("bigint")
        )
        keyword = _ranks_needed(scored, semantic, limit, k)
    fused = rank_fusion(keyword, semantic, boost=FACET_BOOST if names else 0.0)
    order = [F.desc("fused"), F.asc("recipe_id")]
    fused = fused.orderBy(*order) if limit is None else fused.orderBy(*order).limit(limit)
    found = (
        fused.select("recipe_id", F.col("fused").alias("score"))
        .join(scored.select("recipe_id", F.col("score").alias("keyword_score"), "matched_terms"), "recipe_id", "left")
        .join(semantic.select("recipe_id", F.col("score").alias("semantic_score")), "recipe_id", "left")
    )
    return result(
        found.withColumns(
            {
                "keyword_score": F.coalesce("keyword_score", F.lit(0.0)),
                "semantic_score": F.coalesce("semantic_score", F.lit(0.0)),
                "matched_terms": F.coalesce("matched_terms", F.array().cast("array<string>")),
            }
        )
    ).orderBy(F.desc("score"), F.asc("recipe_id"))


def search_keyword(dishes: DataFrame, q: str, limit: int | None) -> DataFrame:
    """The keyword side alone."""
    return hybrid_search(dishes, None, None, q=q, limit=limit)


def search_facets(index: DataFrame, names: Sequence[str], limit: int | None = None) -> DataFrame:
    """Facets alone: every candidate scores one, in recipe order."""
    wanted = facet_names(index.sparkSession, names)
    hits = facet_and(index, names)
    hits = hits if limit is None else hits.limit(limit)
    return hits.select(
        "recipe_id",
        F.lit(1.0).alias("score"),
        F.lit(1.0).alias("keyword_score"),
        F.lit(0.0).alias("semantic_score"),
        F.lit(", ".join(wanted)).alias("matched_ingredient"),
    )
