"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from larder.plans import (
    catalogue_queries,
    document_queries,
    function_queries,
    network_queries,
    pdf_queries,
    plan_queries,
    search_queries,
    stream_queries,
    toc_queries,
)

ALL_QUERIES = {
    **search_queries.QUERIES,
    **network_queries.QUERIES,
    **plan_queries.QUERIES,
    **catalogue_queries.QUERIES,
    **function_queries.QUERIES,
    **document_queries.QUERIES,
    **toc_queries.QUERIES,
    **pdf_queries.QUERIES,
    **stream_queries.QUERIES,
}
