"""SQL of the facet, search and set queries."""

from __future__ import annotations

from larder.oracle.sql import scored, sub, with_views

BOTH = (
    "SELECT recipe_id FROM v_index WHERE name IN ('small ring', 'red widget') "
    "GROUP BY recipe_id HAVING count(*) = 2"
)
POSTING_TERMS = ["thonen", "andtion", "zq", "src12"]
TERMS = ["the", "and", "thon", "the"]
SIM = (
    "SELECT vec_id AS recipe_id, list_cosine_similarity(cast(embedding AS DOUBLE[]), "
    "(SELECT cast(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings"
)


def top(k: int) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY score DESC, recipe_id) AS rank FROM ({SIM}) ORDER BY rank LIMIT {k}"


def docs(body: str) -> str:
    return with_views(body, "v_docs", "v_search")


def hybrid(terms: list[str], candidates: str, k: str, limit: int | None, boost: float, shown: str, extra: str) -> str:
    cut = "" if limit is None else f" ORDER BY fused DESC, recipe_id LIMIT {limit}"
    return docs(f"""
        SELECT f.recipe_id, round(fused, 5) AS score, round(coalesce(k.score, 0), 5) AS keyword_score,
               round(coalesce(s.score, 0), {extra}) AS semantic_score{shown.format(terms="coalesce(k.matched_terms, '')")}
        FROM (SELECT coalesce(k.recipe_id, s.recipe_id) AS recipe_id,
                     coalesce(1.0 / (60 + k.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) + {boost} AS fused
              FROM kw k FULL JOIN sem s ON k.recipe_id = s.recipe_id{cut}) f
        LEFT JOIN kw k ON k.recipe_id = f.recipe_id LEFT JOIN sem s ON s.recipe_id = f.recipe_id""").replace(
        "\n        SELECT f.recipe_id", f""",
        candidates AS ({candidates}),
        kw AS (SELECT *, row_number() OVER (ORDER BY score DESC, recipe_id) AS rank
               FROM ({scored(terms)}) WHERE recipe_id IN (FROM candidates)),
        sem AS (SELECT recipe_id, score, row_number() OVER (ORDER BY score DESC, recipe_id) AS rank
                FROM ({top(k)}) WHERE recipe_id IN (FROM candidates))
        SELECT f.recipe_id""", 1)


SQL = {
    "facet_and": with_views(BOTH, "v_index"),
    "facet_in_cookbook": with_views(
        "SELECT recipe_id, cookbook_id, position FROM v_recipes WHERE cookbook_id = 87 AND recipe_id IN "
        "(SELECT recipe_id FROM v_index WHERE name = 'small ring')", "v_index", "v_recipes"),
    "facet_counts": with_views("SELECT name, count(DISTINCT recipe_id) AS recipe_count FROM v_index GROUP BY name", "v_index"),
    "facet_drilldown": with_views(
        f"SELECT name, count(*) AS recipe_count FROM v_index WHERE name NOT IN ('small ring', 'red widget') "
        f"AND recipe_id IN ({BOTH}) GROUP BY name", "v_index"),
    "facet_prefix": with_views(
        "SELECT name, count(*) AS recipe_count FROM v_index WHERE starts_with(name, 'red') GROUP BY name", "v_index"),
    "facet_substring": with_views(
        "SELECT name, count(*) AS recipe_count FROM v_index WHERE contains(name, 'ri') AND name <> 'small ring' AND recipe_id IN "
        "(SELECT recipe_id FROM v_index WHERE name = 'small ring') GROUP BY name", "v_index"),
    "posting_intersect": with_views(
        "SELECT recipe_id FROM v_index WHERE name = 'small ring' INTERSECT SELECT recipe_id FROM v_index WHERE name = 'red widget'",
        "v_index"),
    "facet_minus": with_views(
        "SELECT DISTINCT name FROM v_index EXCEPT SELECT * FROM (VALUES ('small ring'), ('red widget'))", "v_index"),
    "ordered_distinct": f"""
        SELECT doc_id AS recipe_id, coalesce(string_agg(w, ' ' ORDER BY pos), '') AS words
        FROM documents LEFT JOIN (
            SELECT doc_id AS id, w, min(i) AS pos
            FROM documents, unnest(string_split(trim({sub('lower(text)', '[^a-z0-9]+', ' ')}), ' ')) WITH ORDINALITY AS u(w, i)
            WHERE w <> '' GROUP BY doc_id, w) ON id = doc_id
        GROUP BY doc_id""",
    "rank_union": docs(f"SELECT recipe_id FROM ({scored(['thon'])}) UNION SELECT recipe_id FROM ({top(30)})"),
    "keyword_score": docs(f"SELECT recipe_id, score, matched_terms FROM ({scored(TERMS)})"),
    "keyword_postings": docs(f"SELECT recipe_id, score, matched_terms FROM ({scored(POSTING_TERMS)})"),
    "keyword_topk": docs(f"""
        SELECT recipe_id, title, cookbook_title, score,
               row_number() OVER (ORDER BY score DESC, replace(lower(title), 'ß', 'ss'),
                                  replace(lower(cookbook_title), 'ß', 'ss'), recipe_id) AS rank
        FROM ({scored(TERMS)}) ORDER BY rank LIMIT 6"""),
    "rank_map": docs(f"SELECT recipe_id, score, row_number() OVER (ORDER BY score DESC, recipe_id) AS rank FROM ({scored(TERMS)})"),
    "vector_topk": f"SELECT rank, recipe_id, round(score, 5) AS score FROM ({top(50)})",
    "vector_candidate_join": f"SELECT recipe_id, round(score, 5) AS score FROM ({top(50)}) WHERE recipe_id IN "
                             "(SELECT doc_id FROM documents WHERE lang = 'en')",
    "rank_fusion": docs(f"""
        SELECT coalesce(k.recipe_id, s.recipe_id) AS recipe_id, k.rank AS keyword_rank, s.rank AS semantic_rank,
               round(coalesce(1.0 / (60 + k.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 6) AS fused
        FROM (SELECT recipe_id, row_number() OVER (ORDER BY score DESC, recipe_id) AS rank FROM ({scored(['thon'])})) k
        FULL JOIN ({top(50)}) s ON k.recipe_id = s.recipe_id"""),
    "search_keyword": docs(f"""
        SELECT recipe_id, round(1.0 / (60 + rank), 5) AS score, score AS keyword_score, cast(0 AS DOUBLE) AS semantic_score, matched_terms
        FROM (SELECT recipe_id, score, matched_terms, row_number() OVER (ORDER BY score DESC, recipe_id) AS rank
              FROM ({scored(TERMS)})) WHERE rank <= 25"""),
    "search_facets": with_views(
        f"SELECT recipe_id, cast(1 AS DOUBLE) AS score, cast(1 AS DOUBLE) AS keyword_score, cast(0 AS DOUBLE) AS semantic_score, "
        f"'small ring, red widget' AS matched_ingredient FROM ({BOTH}) ORDER BY recipe_id LIMIT 20", "v_index"),
    "hybrid_search": hybrid(TERMS, "SELECT doc_id FROM documents WHERE lang = 'en'", "100", 20, 0.02,
                            ", {terms} AS matched_terms, 'en' AS matched_ingredient", "5"),
    "hybrid_search_unlimited": hybrid(
        ["thon"], "SELECT doc_id FROM documents", "(SELECT 5 * count(*) FROM documents)", None, 0.0, "", "5"),
}
