"""SQL of the catalogue queries."""

from __future__ import annotations

from larder.oracle.plan_sql import let
from larder.oracle.sql import canonical_norm, normalized, squash, strip, sub, title_case, with_views

NAME = r"(?:z[\s-]*library(?:\.sk)?|1lib(?:\.sk)?|z[\s-]*lib(?:\.sk|rary)?)"


def unsuffixed(x: str) -> str:
    y = sub(x, r"(?i)[\(\[][^)\]]*" + NAME + r"[^)\]]*[\)\]]", "")
    return squash(sub(y, r"(?i)\s*[-–—,]?\s*" + NAME + r".*$", ""))


def clean_meta(x: str) -> str:
    return f"trim({unsuffixed(strip(f'''coalesce({x}, '')'''))}, ' -_,;:/')"


def sort_key(x: str) -> str:
    return f"trim({sub(f'''lower(coalesce({x}, ''))''', '[^a-z0-9]+', ' ')})"


def file_title(x: str) -> str:
    stem = sub(f"regexp_extract({x}, '([^/]*)/*$', 1)", r"(.)\.[^.]+$", r"\1")
    return f"coalesce(nullif({title_case(unsuffixed(f'''translate({stem}, '_-', '  ')'''))}, ''), 'Untitled Cookbook')"


STATE = """SELECT kind, recipe_id, max_by(is_on, (ts, event_id)) AS is_on, max_by(event_id, (ts, event_id)) AS event_id
    FROM v_toggles GROUP BY kind, recipe_id"""
ON = f"SELECT * FROM ({STATE}) WHERE is_on"
FLAGS = """coalesce((SELECT bool_or(true) FROM state s WHERE s.recipe_id = {r} AND kind = 'favourite'), false) AS is_favorite,
    coalesce((SELECT bool_or(true) FROM state s WHERE s.recipe_id = {r} AND kind = 'want_to_try'), false) AS is_want_to_try"""
LISTING = """listing AS (SELECT 'ebooks/' || lower(c_mktsegment) || '/the_' || lower(c_name) || '-(ZLibrary.sk)'
        || ['.PDF', '.epub', '.txt', '', '.mobi'][c_custkey % 5 + 1] AS object_name,
        CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 11 = 0 THEN c_custkey * 1000000000 ELSE c_custkey END AS size_bytes,
        1577836800 + (c_custkey * 7919) % 1000003 AS seen, c_custkey % 5 AS ext,
        'the_' || lower(c_name) || '-(ZLibrary.sk)' || ['.PDF', '.epub', '.txt', '', '.mobi'][c_custkey % 5 + 1] AS filename FROM customer)"""
DRAFTS = """existing AS (SELECT o_custkey AS cookbook_id, o_orderkey AS recipe_id, 'p' || (o_orderkey % 40) AS anchor FROM orders WHERE o_orderstatus = 'F'),
    drafts AS (SELECT o_custkey AS cookbook_id, o_orderkey AS draft_no, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ' p' || (o_orderkey % 41) || ' ' END AS anchor
               FROM orders WHERE o_orderstatus <> 'F'),
    fresh AS (SELECT * FROM drafts d WHERE trim(anchor) = '' OR NOT EXISTS (SELECT 1 FROM existing e WHERE e.cookbook_id = d.cookbook_id AND e.anchor = trim(d.anchor)))"""
PLACED = """(SELECT d.*, coalesce((SELECT count(*) FROM existing e WHERE e.cookbook_id = d.cookbook_id), 0)
    + row_number() OVER (PARTITION BY d.cookbook_id ORDER BY draft_no) AS position FROM {t} d)"""
TAGGED = """tagged AS (SELECT cookbook_title AS cookbook_id, recipe_id,
        CASE WHEN recipe_id % 5 <> 0 THEN list_filter(list_distinct([trim(lang), substr(title, 1, 1)]), lambda t: trim(t) <> '') ELSE [] END AS tags,
        CASE WHEN recipe_id % 3 = 0 THEN 'missing_method_steps' ELSE 'too_few_ingredients' END AS reason FROM v_docs)"""
STORED = """stored AS (SELECT recipe_id, raw, name, CASE WHEN line_no % 5 = 0 THEN upper(name) ELSE name END AS normalized_name,
        CASE WHEN line_no % 3 = 0 THEN name || ' cheese' ELSE name END AS canonical_name FROM v_ingredients)"""


def sorted_by(order: str) -> str:
    return with_views(f"SELECT cookbook_id, row_number() OVER (ORDER BY {order}, cookbook_id) AS rank FROM v_cookbooks", "v_cookbooks")


def text_order(a: str, b: str) -> str:
    return f"{sort_key(a)} = '', coalesce(nullif({sort_key(a)}, ''), {sort_key(b)}), {sort_key(b)}"


INDEX_NAME = let(normalized("canonical_name"), "c", f"CASE WHEN c <> '' THEN c ELSE {canonical_norm(normalized('name'))} END")

# All numbers of a vector in millionths.
NUMBERS = "array_to_string(list_transform({v}, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',')"
SQL = {
    "hydrate_cookbooks": with_views("""SELECT cast(cookbook_id AS VARCHAR) AS cookbook_id, title, author, cuisine, collection_slug, published_at,
        cookbook_id * 1000 AS size_bytes, CASE cookbook_id % 4 WHEN 0 THEN 'staged' WHEN 1 THEN 'queued' ELSE 'extracted' END AS status,
        coalesce(recipe_count, 0) AS recipe_count, 0 AS needs_review_count, cast(NULL AS VARCHAR) AS extract_error FROM v_cookbooks""", "v_cookbooks"),
    "hydrate_recipes": with_views(f""", state AS ({ON})
        SELECT recipe_id, cookbook_title AS cookbook_id, cookbook_title, title, array_to_string(list_sort(list_distinct(list_filter(
            list_transform(lines, lambda l: {let(normalized(normalized('l')), 'n', canonical_norm('n'))}), lambda n: n <> ''))), '|') AS ingredient_names,
            {FLAGS.format(r='d.recipe_id')} FROM v_docs d""", "v_docs", "v_toggles"),
    "recipe_references": with_views("SELECT recipe_id, cookbook_title AS cookbook_id, cookbook_title, CASE WHEN cookbook_title <> 'src1' THEN '* ' || title ELSE title END AS title FROM v_docs", "v_docs"),
    "stage_files": f"""WITH {LISTING} SELECT object_name, size_bytes, CASE
        WHEN ext = 2 THEN 'Unsupported file type ''txt''. Allowed types: azw3, epub, mobi, pdf.'
        WHEN ext = 3 THEN 'Unsupported file type ''sk)''. Allowed types: azw3, epub, mobi, pdf.'
        WHEN size_bytes = 0 THEN '''' || filename || ''' is empty.'
        WHEN size_bytes > 524288000 THEN '''' || filename || ''' exceeds the 500 MB upload limit.' END AS reason FROM listing""",
    "list_objects": f"""WITH {LISTING} SELECT replace(object_name, '/', '-') AS cookbook_id, {file_title('filename')} AS title, filename,
        object_name AS object_key, size_bytes, 'staged' AS status, seen AS uploaded_at FROM listing""",
    "object_keys": """SELECT o_orderkey AS recipe_id, 'ebooks/' || strftime(o_orderdate, '%Y/%m/%d') || '/' || o_custkey || '/'
        || trim(regexp_replace('my ' || o_orderpriority || '  (final)! .pdf', '[^A-Za-z0-9._-]+', '-', 'g'), '-') AS object_key,
        'derived/' || o_custkey || '/recipes/' || o_orderkey || '/images/1-untitled' AS image_key FROM orders""",
    "library_filter": with_views("SELECT cookbook_id, title FROM v_cookbooks WHERE collection_slug IS NULL", "v_cookbooks"),
    "recipe_scan_order": with_views("SELECT recipe_id, row_number() OVER (ORDER BY uploaded_epoch DESC, cookbook_id, position) AS listing_order "
                                    "FROM v_recipes JOIN v_cookbooks USING (cookbook_id)", "v_recipes", "v_cookbooks"),
    "collection_members": with_views("SELECT recipe_id, position FROM v_recipes JOIN v_cookbooks USING (cookbook_id) WHERE collection_slug = 'jamie-oliver'", "v_recipes", "v_cookbooks"),
    "collection_members_favourites": with_views(f"SELECT recipe_id, event_id FROM v_recipes JOIN ({ON}) s USING (recipe_id) WHERE kind = 'favourite'", "v_recipes", "v_toggles"),
    "recipe_flags": with_views(f", state AS ({ON}) SELECT recipe_id, {FLAGS.format(r='r.recipe_id')} FROM v_recipes r", "v_recipes", "v_toggles"),
    "collection_semi": with_views("SELECT recipe_id, cookbook_id FROM v_recipes WHERE cookbook_id IN (SELECT cookbook_id FROM v_cookbooks WHERE collection_slug = 'nytimes')", "v_recipes", "v_cookbooks"),
    "prev_next": with_views("""SELECT list, recipe_id, row_number() OVER w AS rank, lag(recipe_id) OVER w AS previous_id, lead(recipe_id) OVER w AS next_id
        FROM (SELECT coalesce(collection_slug, 'cookbook-' || cookbook_id) AS list, * FROM v_recipes JOIN v_cookbooks USING (cookbook_id))
        WINDOW w AS (PARTITION BY list ORDER BY uploaded_epoch DESC, cookbook_id, position)""", "v_recipes", "v_cookbooks"),
    "recipe_total": with_views("SELECT cast(sum(coalesce(recipe_count, 0)) AS BIGINT) AS recipe_total FROM v_cookbooks", "v_cookbooks"),
    "collection_counts": with_views(f"""SELECT place, slug, title, CASE slug
            WHEN 'favourites' THEN (SELECT count(*) FROM ({ON}) s JOIN v_recipes USING (recipe_id) WHERE kind = 'favourite')
            WHEN 'want-to-try' THEN (SELECT count(*) FROM ({ON}) s JOIN v_recipes USING (recipe_id) WHERE kind = 'want_to_try')
            ELSE (SELECT count(*) FROM v_recipes JOIN v_cookbooks USING (cookbook_id) WHERE collection_slug = slug) END AS recipe_count
        FROM (VALUES (0, 'favourites', 'Favourites'), (1, 'want-to-try', 'Want To Try'), (2, 'nytimes', 'NYTimes'), (3, 'jamie-oliver', 'Jamie Oliver'),
                     (4, 'bbc-goodfood', 'BBC Good Food'), (5, 'waitrose-recipes', 'Waitrose Recipes')) t(place, slug, title)""", "v_recipes", "v_cookbooks", "v_toggles"),
    "needs_review_counts": "SELECT o_custkey AS cookbook_id, count(*) FILTER (o_orderstatus = 'P') AS needs_review_count FROM orders GROUP BY 1",
    "ingest_rollup": """SELECT c_custkey AS cookbook_id, CASE WHEN count(o_orderkey) > 0 THEN 'extracted' ELSE 'partially_extracted' END AS status,
        count(o_orderkey) AS recipe_count, count(*) FILTER (o_orderstatus = 'P') AS needs_review_count,
        CASE WHEN count(o_orderkey) = 0 THEN 'No recipe candidates were extracted.' END AS extract_error
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "cookbook_management": with_views(f""", {TAGGED}, counted AS (
        SELECT cookbook_id, 'tag' AS kind, t AS value, count(*) AS dishes FROM tagged, unnest(tags) AS u(t) GROUP BY ALL
        UNION ALL SELECT cookbook_id, 'reason', reason, count(*) FROM tagged GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY cookbook_id, kind ORDER BY dishes DESC, value) AS rank FROM counted""", "v_docs"),
    "photo_percent": with_views("SELECT cookbook_title AS cookbook_id, cast(round_even(100.0 * count(*) FILTER (recipe_id % 4 = 0) / count(*), 0) AS INT) AS photo_recipe_percent FROM v_docs GROUP BY 1", "v_docs"),
    "tag_recipe_join": with_views("SELECT cookbook_id, title, recipe_id, review_status FROM v_cookbooks JOIN v_recipes USING (cookbook_id)", "v_cookbooks", "v_recipes"),
    "management_groups": with_views("""SELECT place, slug, group_title, cookbook_id, title FROM (SELECT *, CASE WHEN cookbook_id % 9 = 0 THEN 'unknown-slug'
        ELSE coalesce(collection_slug, 'books') END AS slug FROM v_cookbooks) JOIN (VALUES (0, 'books', 'Books'), (1, 'nytimes', 'NYTimes'),
        (2, 'jamie-oliver', 'Jamie Oliver'), (3, 'bbc-goodfood', 'BBC Good Food'), (4, 'waitrose-recipes', 'Waitrose Recipes')) t(place, slug, group_title) USING (slug)""", "v_cookbooks"),
    "group_by_chapter": with_views("""SELECT *, row_number() OVER (PARTITION BY cookbook_id ORDER BY first_position) AS rank FROM (
        SELECT cookbook_id, priority AS label, min(position) AS first_position, count(*) AS dishes FROM v_recipes GROUP BY ALL)""", "v_recipes"),
    "backfill_diff": with_views(f""", {STORED}, lines AS (SELECT *, canonical_name <> {canonical_norm(normalized('normalized_name'))}
            OR normalized_name <> {normalized('normalized_name')} AS changed FROM stored),
        r AS (SELECT recipe_id, bool_or(changed) AS changed, bool_or(name = 'small ring') AS lacking, count(*) FILTER (changed) AS n FROM lines GROUP BY 1)
        SELECT count(*) AS recipes_scanned, count(*) FILTER (changed OR lacking) AS recipes_updated, cast(sum(n) AS BIGINT) AS ingredients_updated FROM r""", "v_ingredients"),
    "ingredient_index": with_views(f", {STORED} SELECT DISTINCT recipe_id, {INDEX_NAME} AS name FROM stored", "v_ingredients"),
    "replace_by_cookbook": with_views(f""", urgent AS (SELECT * FROM v_recipes WHERE priority = '1-URGENT'), again AS (SELECT cookbook_id FROM urgent)
        SELECT 'dishes' AS "table", cookbook_id, recipe_id, position || '|' || review_status AS detail FROM v_recipes WHERE cookbook_id NOT IN (FROM again)
        UNION ALL SELECT 'dishes', cookbook_id, recipe_id + 1000000, position || '|pending_review' FROM urgent
        UNION ALL SELECT 'index', cookbook_id, recipe_id, name FROM v_index JOIN v_recipes USING (recipe_id) WHERE cookbook_id NOT IN (FROM again)
        UNION ALL SELECT 'index', cookbook_id, recipe_id + 1000000, upper(name) FROM v_index JOIN urgent USING (recipe_id)
        UNION ALL SELECT 'vectors', cookbook_id, recipe_id, {NUMBERS.format(v='embedding')} FROM embeddings JOIN v_recipes ON recipe_id = vec_id WHERE cookbook_id NOT IN (FROM again)""", "v_recipes", "v_index"),
    "new_anchor_anti": f"WITH {DRAFTS} SELECT * FROM fresh",
    "append_new_anchors": f"WITH {DRAFTS} SELECT *, sha256(cookbook_id || '|' || anchor || '|' || position) AS recipe_id FROM {PLACED.format(t='fresh')}",
    "positions": f"WITH {DRAFTS} SELECT cookbook_id, draft_no, position FROM {PLACED.format(t='drafts')}",
    "cascade_delete": with_views(f""", gone AS (SELECT cookbook_id FROM v_cookbooks WHERE author IS NULL), stay AS (SELECT * FROM v_recipes WHERE cookbook_id NOT IN (FROM gone))
        SELECT 'cookbooks' AS "table", cookbook_id, CAST(NULL AS BIGINT) AS recipe_id, title AS detail FROM v_cookbooks WHERE cookbook_id NOT IN (FROM gone)
        UNION ALL SELECT 'dishes', cookbook_id, recipe_id, position || '|' || review_status FROM stay
        UNION ALL SELECT 'index', cookbook_id, recipe_id, name FROM v_index JOIN stay USING (recipe_id)
        UNION ALL SELECT 'vectors', cookbook_id, recipe_id, {NUMBERS.format(v='embedding')} FROM embeddings JOIN stay ON recipe_id = vec_id""", "v_cookbooks", "v_recipes", "v_index"),
    "vector_upsert": with_views(f"""SELECT vec_id AS recipe_id, vec_id % 50 AS cookbook_id, CASE WHEN t.recipe_id IS NULL THEN {NUMBERS.format(v='embedding')} ELSE {NUMBERS.format(v='list_reverse(embedding)')} END AS numbers,
        coalesce(title, 'old') AS title FROM embeddings LEFT JOIN v_docs t ON t.recipe_id = vec_id AND embedding[1] > 0""", "v_docs"),
    "top_images": with_views("SELECT recipe_id, array_to_string(lines[1:4], '|') AS images FROM v_docs", "v_docs"),
    "sort_cookbooks": sorted_by(text_order("title", "author")),
    "sort_cookbooks_author": sorted_by(text_order("author", "title")),
    "sort_cookbooks_cuisine": sorted_by(text_order("cuisine", "title")),
    "sort_cookbooks_published_at": sorted_by(f"published_at IS NOT NULL DESC, coalesce(published_at, '') DESC, {sort_key('title')} DESC"),
}
SQL = {name: sql.replace(")\n,", "),", 1) if ")\n," in sql[:20000] else sql for name, sql in SQL.items()}
