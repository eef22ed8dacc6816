"""DuckDB SQL with the same result as each registered query."""

from larder.oracle import (
    catalogue_sql,
    document_sql,
    function_sql,
    network_sql,
    pdf_sql,
    plan_sql,
    search_sql,
    stream_sql,
    toc_sql,
)

ALL_SQL = {
    **search_sql.SQL,
    **network_sql.SQL,
    **plan_sql.SQL,
    **catalogue_sql.SQL,
    **function_sql.SQL,
    **document_sql.SQL,
    **toc_sql.SQL,
    **pdf_sql.SQL,
    **stream_sql.SQL,
}
