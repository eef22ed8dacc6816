"""SQL of the text function queries."""

from __future__ import annotations

from larder.oracle.catalogue_sql import clean_meta, sort_key as key_of, unsuffixed
from larder.oracle.plan_sql import let
from larder.oracle.sql import CHEESE, PASTA, VIEWS, WS, canonical_norm, casefold, normalized, squash, strip, sub, title_case, with_views

WE = r"(?:$|[^\p{L}\p{N}_])"
LINES = f"""v_docs AS ({VIEWS['v_docs']}),
    lines AS (SELECT recipe_id, pos - 1 AS line_no, line FROM v_docs, unnest(lines) WITH ORDINALITY AS u(line, pos))"""
WRITTEN = f"""{LINES}, written AS (SELECT recipe_id, line_no, CASE (recipe_id + line_no) % 12 WHEN 0 THEN '200g ' || line WHEN 1 THEN '1 1/2 cups ' || line
    WHEN 2 THEN 'Optional: the ' || line || ' (chopped)' WHEN 3 THEN '½ tsp of ' || line || ', finely sliced' WHEN 4 THEN '2 x 400g tins ' || line
    WHEN 5 THEN 'a ' || line WHEN 6 THEN 'The Goat''s cheese' WHEN 7 THEN {PASTA}[recipe_id % 13 + 1] || ' Pasta (' || line || ')'
    WHEN 8 THEN 'about 3-4 tablespoons ' || line || ' plus extra for frying' WHEN 9 THEN {CHEESE}[recipe_id % 8 + 1] || '  Cheese'
    WHEN 10 THEN 'pinch ' || line ELSE line END AS raw FROM lines)"""
DIRTY = f"""v_docs AS ({VIEWS['v_docs']}), dirty AS (SELECT recipe_id, title, CASE recipe_id % 6 WHEN 0 THEN title || ' (Z-Library)'
    WHEN 1 THEN title || ' [1Lib.sk, z-lib.org] (kept) ' WHEN 2 THEN title || ' - z library.sk and more' WHEN 3 THEN ' -' || title || ':; '
    WHEN 4 THEN ' (z library) ' ELSE title END AS dirty FROM v_docs)"""
LABELLED = f"""{LINES}, labelled AS (SELECT recipe_id, line_no, CASE (recipe_id + line_no) % 9 WHEN 0 THEN 'Serves: ' || line WHEN 1 THEN 'makes' || line
    WHEN 2 THEN 'Yield - ' || line WHEN 3 THEN 'PREP TIME: ' || line WHEN 4 THEN 'Cook time. ' || line WHEN 5 THEN 'Chilling  time ' || line
    WHEN 6 THEN 'total time:' || line WHEN 7 THEN 'Serves' ELSE line END AS line FROM lines)"""


def w(cte: str, body: str) -> str:
    return f"WITH {cte}\n{body}"


def twice(x: str) -> str:
    """Canonical name of text that goes through the normaliser twice."""
    return let(normalized(normalized(x)), "n", canonical_norm("n"))


QUANTITY = r"(?i)^\s*(?:about\s+)?(?:(?:\d+\s*[./-]?\s*\d*)|(?:\d+\s*x\s*\d+)|[¼½¾⅓⅔⅛]+)\s*"
UNIT = r"(?i)^(g|kg|ml|l|oz|lb|lbs|tbsp|tsp|teaspoon|teaspoons|tablespoon|tablespoons|clove|cloves|sprig|sprigs|bunch|bunches|handful|handfuls|medium|small|large)" + WE
PARSED = f"""{WRITTEN}, p1 AS (SELECT recipe_id, line_no, {squash('raw')} AS cleaned FROM written),
    p2 AS (SELECT *, regexp_extract(cleaned, '^[^,]*') AS base, nullif({strip(sub('cleaned', '^[^,]*,?', ''))}, '') AS preparation FROM p1),
    p3 AS (SELECT *, regexp_extract(base, '{QUANTITY}') AS quantity FROM p2),
    p4 AS (SELECT *, substr(base, len(quantity) + 1) AS remainder, regexp_extract(remainder, '{UNIT}', 1) AS unit FROM p3),
    p5 AS (SELECT *, {sub('substr(remainder, len(unit) + 1)', f'^{WS}+', '')} AS rest FROM p4),
    p6 AS (SELECT *, {sub(f"trim({sub('rest', WS + r'*\([^)]*\)', '')}, ' .;:-')", f'(?i)^of{WS}+', '')} AS item FROM p5),
    p7 AS (SELECT *, coalesce(nullif({normalized(sub(strip(sub(sub(casefold("coalesce(nullif(item, ''), cleaned)"), WS + r'*\([^)]*\)', ' '),
        r'(^|[^\p{L}\p{N}_])(?:for|plus)(?:[^\p{L}\p{N}_].*)?$', r'\1')), f'^(a|an|the){WS}+', ''))}, ''), 'ingredient') AS name FROM p6)"""


def named(steps: list[tuple[str, str]]) -> str:
    x = strip("replace(raw, chr(160), ' ')")
    for pattern, by in steps:
        x = sub(x, pattern, by)
    return w(WRITTEN, f"SELECT recipe_id, line_no, {normalized(f'''regexp_extract({x}, '^[^,]*')''')} AS name FROM written")


PREFIX = (("serves", "serves"), ("makes", "makes"), ("yield", "yield"), ("prep time", "prep_time"), ("cook time", "cook_time"),
          ("chilling time", "chilling_time"), ("total time", "total_time"))
FILE = "translate(replace(title, '/', ''), ' ', '_') || '-(ZLibrary.sk)-[1Lib.sk]'"
BLOCKS = [
    ("summary", "'Author'", "cookbook_title", "true"),
    ("summary", "'Timing'", "CASE WHEN recipe_id % 3 = 0 THEN 'Prep 5 mins · Cook 20 mins' ELSE 'Cook 20 mins' END", "true"),
    ("summary", "'Difficulty'", "'Easy'", "true"),
    ("intro", "CASE WHEN recipe_id % 2 = 0 THEN 'Introduction' ELSE 'Excerpt' END",
     "CASE WHEN recipe_id % 2 = 0 THEN title || '|' || title ELSE upper(lang) END", "recipe_id % 2 = 0 OR recipe_id % 3 = 0"),
    ("text", "'Description'", "'About ' || title", "true"),
    ("list", "'Notes'", "'note'", "true"),
    ("list", "'Tags'", "lang || '|' || cookbook_title", "true"),
    ("section", "'Tip'", "title", "true"),
]

SQL = {
    "normalize_ingredient": w(WRITTEN, f"SELECT recipe_id, line_no, {normalized('raw')} AS name FROM written"),
    "canonical_ingredient": w(WRITTEN, f"SELECT recipe_id, line_no, {let(normalized('raw'), 'n', canonical_norm('n'))} AS name FROM written"),
    "ingredient_payload": w(WRITTEN, f"""SELECT recipe_id, line_no, {strip('raw')} AS raw, coalesce(nullif({normalized(strip('raw'))}, ''), 'ingredient') AS normalized_name,
        coalesce(nullif({twice(strip('raw'))}, ''), 'ingredient') AS canonical_name, cast(NULL AS VARCHAR) AS quantity, cast(NULL AS VARCHAR) AS unit,
        CASE WHEN line_no % 2 = 0 THEN nullif({strip('raw')}, '') END AS item, cast(NULL AS VARCHAR) AS preparation, false AS optional FROM written"""
                            .replace("{normalized(strip('raw'))}", normalized("raw"))),
    "index_name": w(WRITTEN, f"SELECT recipe_id, line_no, CASE WHEN line_no % 3 = 0 AND {normalized('raw')} <> '' THEN {normalized('raw')} ELSE {twice('raw')} END AS name FROM written"),
    "parse_ingredient_line": w(PARSED, f"""SELECT recipe_id, line_no, cleaned AS raw, {normalized('name')} AS normalized_name, {twice('name')} AS canonical_name,
        nullif({strip('quantity')}, '') AS quantity, nullif(unit, '') AS unit, nullif({strip('item')}, '') AS item, preparation,
        contains({casefold('cleaned')}, 'optional') AS optional FROM p7"""),
    "name_nytimes": named([
        (r"\([^)]*\)", ""),
        (r"(?i)^\s*(?:\d+(?:\s+\d+/\d+)?(?:/\d+)?|[¼½¾⅓⅔⅛]|a|an)(?:\s*(?:to|-)\s*(?:\d+(?:/\d+)?|[¼½¾⅓⅔⅛]))?\s*", ""),
        (r"(?i)^(?:cup|cups|tablespoon|tablespoons|tbsp|teaspoon|teaspoons|tsp|ounce|ounces|oz|pound|pounds|lb|lbs|gram|grams|g|kilogram|kilograms|kg|milliliter|milliliters|ml|liter|liters|l|quart|quarts|pint|pints|can|cans|clove|cloves|bunch|bunches|small|medium|large)(?:$|([^\p{L}\p{N}_]))\s*", r"\1"),
        (r"^\s+", ""), (r"(?i)^of\s+", "")]),
    "name_jamie": named([
        (r"\([^)]*\)", ""), (r"(?i)^optional:\s*", ""),
        (r"(?i)^\s*(?:\d+(?:\s+\d+/\d+)?(?:/\d+)?|\d+\s*x\s*\d+|[¼½¾⅓⅔⅛]|a|an|one|two|three|four|five)\s*", ""),
        (r"(?i)^(?:x\s*\d+\s+([\p{L}\p{N}_])|(?:g|kg|ml|l|tbsp|tsp|teaspoon|teaspoons|tablespoon|tablespoons|sachet|sachets|large|medium|small)(?:$|([^\p{L}\p{N}_]))\s*)", r"\1\2")]),
    "name_bbc": named([
        (r"^\s*(?:\d+(?:\s*/\s*\d+)?|[¼½¾⅓⅔⅛]|pinch|few|small|medium|large)\s*", ""),
        (r"^(?:g|kg|ml|l|tbsp|tsp|tablespoon|tablespoons|teaspoon|teaspoons|plain)(?:$|([^\p{L}\p{N}_]))\s*", r"\1")]),
    "name_waitrose": named([
        (r"(?i)^\s*(?:\d+(?:[./]\d+)?|[¼½¾⅓⅔⅛]|handful)\s*", ""),
        (r"(?i)^(?:g|kg|ml|l|tbsp|tsp|pack|jar|bag)(?:$|([^\p{L}\p{N}_]))\s*", r"\1")]),
    "clean_metadata": w(DIRTY, f"SELECT recipe_id, {clean_meta('dirty')} AS cleaned FROM dirty"),
    "display_title_from_file": w(DIRTY, f"""SELECT recipe_id, coalesce(nullif({title_case(unsuffixed(f"translate({FILE}, '_-', '  ')"))}, ''), 'Untitled Cookbook') AS title,
        {title_case(squash(sub("regexp_extract(title, '([^/]*)$', 1)", '[-_]', ' ')))} AS source_title FROM dirty"""),
    "derive_cuisine": w(DIRTY, f"SELECT recipe_id, CASE WHEN {clean_meta('dirty')} = '' THEN 'Lemon-Herb O''Neil' ELSE {title_case(clean_meta('dirty'))} END AS cuisine FROM dirty"),
    "published_at": with_views("""SELECT recipe_id, CASE recipe_id % 6 WHEN 0 THEN strftime(created_on, '%Y-%m-%d') WHEN 1 THEN strftime(created_on, '%Y')
        WHEN 2 THEN strftime(created_on, '%Y-%m-%d') WHEN 3 THEN strftime(created_on, '%Y-%m') WHEN 4 THEN '' ELSE strftime(created_on, '%Y-%m') END AS published_at FROM v_recipes""", "v_recipes"),
    "sort_key": w(DIRTY, f"SELECT recipe_id, {key_of('dirty')} AS sort_key FROM dirty"),
    "metadata_line": w(LABELLED, f"""SELECT recipe_id, line_no, {'CASE ' + ' '.join(f"WHEN starts_with(lower(l), '{p}') THEN '{k}'" for p, k in PREFIX) + ' END'} AS key,
        {'CASE ' + ' '.join(f"WHEN starts_with(lower(l), '{p}') THEN coalesce(nullif({strip(f'''ltrim(substr(l, {len(p) + 1}), ' :.-')''')}, ''), l)" for p, _ in PREFIX) + ' END'} AS value
        FROM (SELECT *, {squash('line')} AS l FROM labelled)"""),
    "merge_metadata": with_views(f"""SELECT recipe_id, array_to_string(list_sort(list_filter(['intro=' || {strip("title")}, CASE WHEN recipe_id % 2 = 0 THEN 'serves=6' ELSE 'serves=4' END,
        CASE WHEN recipe_id % 3 = 0 THEN 'yield=' || lang END, CASE WHEN recipe_id % 5 = 0 THEN 'supplemental_sections=[{{"heading":"Tip"}}]' END], lambda x: x IS NOT NULL)), '|') AS metadata FROM v_docs""", "v_docs"),
    "recipe_page_metadata": with_views("SELECT recipe_id, row_number() OVER (PARTITION BY recipe_id ORDER BY o) - 1 AS place, block, heading, lines FROM ("
                              + " UNION ALL ".join(f"SELECT recipe_id, {i} AS o, '{b}' AS block, {h} AS heading, {ls} AS lines FROM v_docs WHERE {c}" for i, (b, h, ls, c) in enumerate(BLOCKS)) + ")", "v_docs"),
    "embedding_text": with_views(f"SELECT recipe_id, {strip('''title || chr(10) || 'Ingredients: ' || array_to_string(lines, ', ') || chr(10) || 'Method: ' || array_to_string(lines, ' ')''')} AS text FROM v_docs", "v_docs"),
    "excerpt": with_views(f"SELECT recipe_id, {strip(f'''substr(array_to_string(list_filter(list_transform(lines, lambda l: {strip('l')}), lambda l: l <> '')[1:4], ' '), 1, 420)''')} AS excerpt FROM v_docs", "v_docs"),
    "inferred_title": with_views(f"""SELECT recipe_id, {let(strip('lines[1]'), 'f', f"CASE WHEN f <> '' AND len(string_split({squash('f')}, ' ')) <= 16 THEN substr(f, 1, 160) END")} AS title FROM v_docs""", "v_docs"),
    "json_in_text": "SELECT doc_id AS recipe_id, true AS is_recipe, text AS title FROM documents",
    "epub_path": """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'OEBPS/text/' || p WHEN 1 THEN 'OEBPS/' || p WHEN 2 THEN 'OEBPS/nav/toc.xhtml' WHEN 3 THEN 'OEBPS/nav/' || p
        WHEN 5 THEN p WHEN 7 THEN 'OEBPS/nav/a/' || p ELSE '' END AS relative,
        CASE page_id % 8 WHEN 0 THEN 'text/' || p WHEN 1 THEN 'OEBPS/' || p WHEN 3 THEN p WHEN 5 THEN p WHEN 7 THEN 'a/' || p ELSE '' END AS bare
        FROM (SELECT *, 'p' || page_id || '.xhtml' AS p FROM pages)""",
    "chapter_label_test": with_views("""SELECT recipe_id, recipe_id % 7 = 4 OR lower(trim(label)) IN ('index', 'title') AS ignored,
        CASE recipe_id % 7 WHEN 4 THEN false WHEN 5 THEN false WHEN 6 THEN
            regexp_matches(title, '[A-Za-z]') AND (NOT regexp_matches(title, '[a-z]') OR regexp_matches(title, '(?i)^(?:chapter""" + WE + r"""|\d+[.:)]\s|\d+\s+-\s)'))
            WHEN 0 THEN true ELSE regexp_matches(title, '[A-Za-z]') OR recipe_id % 7 = 1 END AS chapter
        FROM (SELECT *, CASE recipe_id % 7 WHEN 6 THEN title ELSE '-' END AS label FROM v_docs)""", "v_docs"),
}
