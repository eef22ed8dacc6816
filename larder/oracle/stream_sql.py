"""SQL of the streaming queries: the batch result each stream must reach."""

from __future__ import annotations

from larder.oracle.document_sql import BOOKS
from larder.oracle.sql import with_views

EVERY = "every AS (SELECT * FROM plain UNION ALL SELECT * FROM classed_drafts)"
# Books without text give nothing; of those sent again only the plain document counts, without the caption page.
STORED = """every AS (SELECT * REPLACE (CASE WHEN cookbook_id % 5 = 0 THEN 'i.png' ELSE images END AS images) FROM (
        SELECT * FROM plain UNION ALL SELECT * FROM classed_drafts) WHERE cookbook_id % 13 <> 0 AND (profile IS NULL OR cookbook_id % 5 <> 0))"""
QUEUE = """ev AS (SELECT user_id AS cookbook_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'extracted' ELSE 'requested' END AS status,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"""

SQL = {
    "stream_toggles": with_views("""SELECT kind, recipe_id, event_id FROM (SELECT kind, recipe_id, max_by(is_on, (ts, event_id)) AS is_on, max_by(event_id, (ts, event_id)) AS event_id
        FROM v_toggles GROUP BY kind, recipe_id) WHERE is_on""", "v_toggles"),
    "stream_job_status": """SELECT user_id AS cookbook_id, max_by(CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'extracted'
        WHEN 'purchase' THEN 'partially_extracted' WHEN 'error' THEN 'failed' ELSE 'staged' END, (ts, event_id)) AS status, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""",
    "stream_facet_counts": "SELECT l_partkey AS name, count(DISTINCT l_orderkey) AS recipe_count FROM lineitem GROUP BY 1",
    "stream_review_counts": """SELECT k % 10 AS cookbook_id, count(*) FILTER (s = 'error') AS needs_review_count FROM (
        SELECT cast(json_extract_string(props, '$.k') AS BIGINT) AS k, max_by(event_type, (ts, event_id)) AS s FROM events GROUP BY 1) GROUP BY 1""",
    "stream_enqueue_dedup": f"""WITH {QUEUE} SELECT cookbook_id, event_id FROM (SELECT *, lag(status, 1, 'extracted') OVER (PARTITION BY cookbook_id ORDER BY n) AS before FROM ev)
        WHERE status = 'requested' AND before <> 'requested'""",
    "stream_ingest": f"""WITH RECURSIVE {BOOKS.replace(EVERY, STORED)},
    owners AS (SELECT DISTINCT recipe_id // 4 AS cookbook_id FROM v_docs),
    told AS (SELECT cookbook_id, CASE WHEN cookbook_id % 5 = 0 THEN 2 ELSE 1 END AS upload_no, count(recipe_id) AS n, count(*) FILTER (review_status = 'needs_review') AS r,
        cookbook_id % 13 = 0 OR (cookbook_id % 5 = 0 AND cookbook_id * 4 + 1 NOT IN (SELECT recipe_id FROM v_docs)) AS bad FROM owners LEFT JOIN book_drafts USING (cookbook_id) GROUP BY cookbook_id),
    old AS (SELECT cookbook_id + 1000000 AS cookbook_id, 'old' || (cookbook_id + 1000000) AS recipe_id FROM owners)
    SELECT 'dishes' AS "table", cookbook_id, recipe_id, position || '|' || anchor || '|' || title || '|' || review_status AS detail FROM book_drafts
    UNION ALL SELECT 'dishes', cookbook_id, recipe_id, '1|a|Old|verified' FROM old
    UNION ALL SELECT 'index', cookbook_id, recipe_id, NULL FROM book_drafts UNION ALL SELECT 'index', cookbook_id, recipe_id, 'salt' FROM old
    UNION ALL SELECT 'toggles', cookbook_id, recipe_id, 'favourite' FROM old
    UNION ALL SELECT 'vectors', cookbook_id, recipe_id, '4' FROM book_drafts UNION ALL SELECT 'vectors', cookbook_id, recipe_id, '1' FROM old
    UNION ALL SELECT 'rejects', cookbook_id, NULL, CASE WHEN bad THEN 'No text in the uploaded document.' ELSE 'No recipe candidates were extracted.' END FROM told WHERE bad OR n = 0
    UNION ALL SELECT 'cookbooks', cookbook_id, NULL, upload_no || '|' || CASE WHEN bad THEN 'failed' WHEN n = 0 THEN 'partially_extracted' ELSE 'extracted' END || '|' || n || '|' || r FROM told""",
    "embed_column": "SELECT doc_id AS recipe_id, cast('0x' || sha256(text)[1:2] AS INT) AS first_byte FROM documents",
    "extract_with": "SELECT doc_id AS recipe_id, len(text) - len(replace(text, chr(10), '')) + 1 AS lines FROM documents",
}
