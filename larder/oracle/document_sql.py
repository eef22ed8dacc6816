"""SQL of the document queries."""

from __future__ import annotations

from html.entities import html5

from larder.oracle.plan_sql import let
from larder.oracle.sql import VIEWS, casefold, names, normalized, squash, strip, sub

WE = r"(?:$|[^\p{L}\p{N}_])"
SKIP = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"


NAMES = {k: v for k, v in html5.items() if k.endswith(";")}


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def decode(x: str) -> str:
    """Character references looked up in parallel lists of names and characters, the usual ones first."""
    first = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "nbsp;": chr(0xA0), "copy;": chr(0xA9), "middot;": chr(0xB7)}
    every = {**first, **{k: v for k, v in NAMES.items() if k not in first}}
    number = "TRY_CAST(CASE WHEN lower(p[3]) = 'x' THEN '0x' || p[4:-2] ELSE p[3:-2] END AS BIGINT)"
    parts = f"regexp_extract_all({x}, '&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,31}});|[^&]+|&')"
    return f"""array_to_string(list_transform({parts}, lambda p: CASE
        WHEN p[1] <> '&' OR p[-1] <> ';' THEN p
        WHEN p[2] = '#' THEN CASE WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr(CAST({number} AS INT)) ELSE chr(65533) END
        ELSE coalesce({quoted(every.values())}[list_position({quoted(every)}, p[2:])], p) END), '')"""


def attr(x: str, name: str) -> str:
    return f"nullif(regexp_extract({x}, '(?i)\\s{name}\\s*=\\s*\"([^\"]*)\"', 1), '')"


def nodes(table: str, doc: str, keep: str = "true") -> str:
    """Tags and texts one by one. A node ends at the first later block tag that leaves fewer elements of
    its kind open than there were before the node, or that no such node may hold."""
    tokens = f"unnest(regexp_extract_all({sub('html', SKIP, ' ')}, '<[^>]*>|[^<]+|<')) WITH ORDINALITY AS u(token, pos)"
    block = r"(?i)^</?(h[1-6]|p|li|img|article|aside|blockquote|body|dd|div|dl|dt|figure|footer|form|header|html|main|nav|ol|section|table|tbody|td|th|tr|ul)(\s[^>]*)?/?>$"
    return f"""tokens AS (SELECT {doc}, pos, token, lower(regexp_extract(token, '{block}', 1)) AS tag, token LIKE '</%' AS closes,
        CASE WHEN token LIKE '</%' THEN -1 WHEN token LIKE '%/>' THEN 0 ELSE 1 END AS delta FROM {table}, {tokens}),
    blocks AS (SELECT *, sum(delta) OVER (PARTITION BY {doc}, tag ORDER BY pos) AS open_after,
        sum(CASE WHEN tag IN ('ul', 'ol') THEN delta ELSE 0 END) OVER (PARTITION BY {doc} ORDER BY pos) - CASE WHEN tag IN ('ul', 'ol') THEN delta ELSE 0 END AS lists,
        sum(CASE WHEN tag = 'p' THEN 0 ELSE delta END) OVER (PARTITION BY {doc} ORDER BY pos) - CASE WHEN tag = 'p' THEN 0 ELSE delta END AS depth
        FROM tokens WHERE tag NOT IN ('', 'img')),
    starts AS (SELECT *, true AS is_node FROM blocks WHERE tag IN ('h1', 'h2', 'h3', 'h4', 'p', 'li') AND delta = 1),
    before AS (SELECT s.{doc}, s.pos, b.tag, sum(b.delta) AS n FROM starts s JOIN blocks b ON s.{doc} = b.{doc} AND b.pos < s.pos GROUP BY ALL),
    closed AS (SELECT s.{doc}, s.pos, min(b.pos) AS stop FROM starts s JOIN blocks b ON s.{doc} = b.{doc} AND b.pos > s.pos
        LEFT JOIN before x ON x.{doc} = s.{doc} AND x.pos = s.pos AND x.tag = b.tag
        WHERE (s.tag = 'p' AND b.depth = s.depth AND (b.tag = 'p' OR NOT b.closes AND (b.tag = 'li' OR b.tag LIKE 'h_')))
            OR (s.tag = 'li' AND b.tag = 'li' AND b.lists = s.lists)
            OR (s.tag LIKE 'h_' AND b.tag LIKE 'h_' AND b.depth = s.depth + 1 AND (b.tag = s.tag OR NOT b.closes))
            OR (b.closes AND b.tag <> 'p' AND b.tag <> s.tag AND b.open_after < coalesce(x.n, 0)) GROUP BY ALL),
    spans AS (SELECT s.{doc}, s.pos, s.tag, s.token AS head, coalesce(c.stop, 1000000000) AS stop FROM starts s LEFT JOIN closed c ON s.{doc} = c.{doc} AND s.pos = c.pos
        UNION ALL SELECT {doc}, pos, tag, token, pos FROM tokens WHERE tag = 'img' AND NOT closes),
    gathered AS (SELECT s.{doc}, s.pos, any_value(s.tag) AS tag, any_value(head) AS head,
        arg_min(t.token, t.pos) FILTER (regexp_matches(t.token, '(?i)^<[a-z][^>]*\\sid\\s*=')) AS inner_head,
        coalesce(string_agg(CASE WHEN regexp_matches(t.token, '^<[^>]*>$') THEN ' ' ELSE t.token END, '' ORDER BY t.pos), '') AS raw
        FROM spans s LEFT JOIN tokens t ON s.{doc} = t.{doc} AND t.pos > s.pos AND t.pos < s.stop GROUP BY s.{doc}, s.pos),
    nodes AS (SELECT {doc}, row_number() OVER (PARTITION BY {doc} ORDER BY pos) - 1 AS seq, tag, coalesce({attr('head', 'class')}, '') AS classes,
        coalesce({attr('head', 'id')}, {attr('inner_head', 'id')}) AS id, {attr('head', 'src')} AS src,
        {squash(decode('raw'))} AS text FROM gathered)"""


SECTIONS = nodes("pages", "page_id") + """,
    kept AS (SELECT *, tag IN ('h1', 'h2', 'h3', 'h4') AS is_head FROM nodes WHERE tag IN ('h1', 'h2', 'h3', 'h4') OR text <> ''),
    cut AS (SELECT *, is_head AND row_number() OVER w > 1 AS starts FROM kept WINDOW w AS (PARTITION BY page_id ORDER BY seq)),
    numbered AS (SELECT *, 1 + count(*) FILTER (starts) OVER (PARTITION BY page_id ORDER BY seq) AS section_no FROM cut),
    sections AS (SELECT page_id, section_no, max(text) FILTER (is_head) AS heading, list(text ORDER BY seq) AS lines FROM numbered GROUP BY ALL)"""


def dedupe(x: str) -> str:
    kept = f"list_filter(list_transform({x}, lambda l: {squash('l')}), lambda l: l <> '')"
    return let(kept, "ls", f"list_filter(ls, lambda l, i: i = 1 OR {casefold('l')} <> {casefold('ls[i - 1]')})")


OPENING = """CASE recipe_id % 6 WHEN 0 THEN 'Serves 4|200g flour|2 eggs|1 tsp salt|' WHEN 1 THEN 'A word first|Ingredients:|200g flour|1 egg, beaten|Prep time: 5 mins|Method|Step 1|'
    WHEN 2 THEN '' WHEN 3 THEN 'Recipe list|' WHEN 4 THEN 'Makes 2|Serves 3|2 cups water|' ELSE 'Method|1. Start here|2) Go on|Ingredients|3 eggs|Total time: |' END"""
SRC = f"""v_docs AS ({VIEWS['v_docs']}), src AS (SELECT cookbook_title AS cookbook_id, recipe_id, CASE WHEN recipe_id % 6 = 4 THEN '' WHEN recipe_id % 7 = 0 THEN 'Introduction' ELSE title END AS chapter_title,
    CASE WHEN recipe_id % 11 = 0 THEN 'text/copyright.xhtml#1' ELSE 'text/c' || recipe_id || '.xhtml#1' END AS anchor,
    replace({OPENING}, '|', chr(10)) || text AS text FROM v_docs)"""
INGREDIENT = (
    r"(?i)^\s*(?:[-*•]\s+)?(?:\d+(?:[./]\d+)?(?:g|kg|ml|l|oz|lb|lbs|cm)?|\d+/\d+|[¼½¾⅓⅔⅛]|one|two|three|four|five)" + WE
)
MEASURE = r"(?i)(?:^|[^\p{L}\p{N}_]|\d)(?:cup|cups|tbsp|tsp|teaspoon|teaspoons|tablespoon|tablespoons|g|kg|ml|l|oz|lb|lbs)" + WE
MEASURED = "(regexp_matches(l, '" + INGREDIENT + "') OR regexp_matches(l, '" + MEASURE + "'))"
TITLES = names([
    "about the author", "about the authors", "about the book", "acknowledgements",
    "a short note about ingredients", "contents", "copyright", "dedication", "foreword",
    "how to use this book", "index", "introduction", "ottolenghi", "praise for salt fat acid heat",
    "recipe list", "table of contents", "thank you", "our histories", "our shared history",
])
CANDIDATE = f"""{SRC}, measured AS (SELECT *, lower(text) AS low, list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: {strip('l')}), lambda l: l <> '') AS ls,
        len(list_filter(ls, lambda l: {MEASURED})) AS n, chapter_title <> '' AND len(string_split({squash('chapter_title')}, ' ')) <= 12 AS titled,
        regexp_matches(low, 'ingredients|serves|yield|prep|cook time|makes|method|directions|steps|instructions') AS cued FROM src),
    candidates AS (SELECT * FROM measured WHERE lower(chapter_title) NOT IN {TITLES} AND NOT regexp_matches(anchor, 'about_|acknowledg|contents|copyright|dedication|foreword|intro|our_histor|ottolenghi|title|toc')
        AND NOT (contains(low, 'recipe list') AND NOT contains(low, 'ingredients') AND NOT contains(low, 'method'))
        AND NOT (chapter_title = '' AND len(list_filter(ls, lambda l: regexp_matches(lower(l), '^(serves|makes)'))) > 1)
        AND (n >= 3 OR (n >= 2 AND titled AND len(ls) <= 40) OR (n >= 2 AND cued) OR (n >= 1 AND regexp_matches(low, 'serves|makes|yield')) OR (titled AND cued AND len(ls) <= 80)))"""
META = "regexp_extract(lower(l), '^(serves|makes|yield|prep time|cook time|chilling time|total time)', 1)"
FIELDS = f"""flat AS (SELECT recipe_id, pos, l FROM (SELECT recipe_id, {let(dedupe("string_split(text, chr(10))"), 'a', f"CASE WHEN {casefold('a[1]')} = {casefold(strip('chapter_title'))} THEN a[2:] ELSE a END")} AS a FROM src), unnest(a) WITH ORDINALITY AS u(l, pos)),
    tagged AS (SELECT *, {strip("rtrim(l, ':')")} AS h, CASE WHEN lower(h) IN ('ingredient', 'ingredients') THEN 'ingredients' WHEN lower(h) IN ('method', 'methods', 'directions', 'instructions', 'preparation', 'steps') THEN 'method' END AS turn,
        {META} AS mk, mk = '' AND NOT regexp_matches({casefold('l')}, '^(for the |for |to serve|serve with)') AND {MEASURED} AS ing FROM flat),
    placed AS (SELECT *, last_value(CASE WHEN turn IS NOT NULL THEN turn END IGNORE NULLS) OVER w AS mode,
        min(CASE WHEN turn IS NULL AND ing THEN pos END) OVER (PARTITION BY recipe_id) AS first_ing FROM tagged WINDOW w AS (PARTITION BY recipe_id ORDER BY pos)),
    parts AS (SELECT *, CASE WHEN turn IS NOT NULL THEN 'turn' WHEN mk <> '' THEN 'meta' WHEN mode IS NOT NULL THEN mode WHEN pos >= first_ing THEN 'ingredients' ELSE 'intro' END AS part,
        replace(mk, ' ', '_') AS key, coalesce(nullif({strip("ltrim(substr(l, len(mk) + 1), ' :.-')")}, ''), l) AS value FROM placed),
    metas AS (SELECT recipe_id, key, max_by(value, pos) AS value FROM parts WHERE part = 'meta' GROUP BY ALL
              UNION ALL SELECT recipe_id, 'intro', array_to_string({dedupe('list(l ORDER BY pos)')}, chr(10) || chr(10)) FROM parts WHERE part = 'intro' GROUP BY recipe_id),
    mets AS (SELECT recipe_id, string_agg(key || '=' || value, '|' ORDER BY key || '=' || value) AS metadata FROM metas WHERE {strip('value')} <> '' GROUP BY recipe_id),
    ings AS (SELECT recipe_id, {dedupe('list(l ORDER BY pos)')} AS ingredient_lines FROM parts WHERE part = 'ingredients' GROUP BY recipe_id),
    steplines AS (SELECT recipe_id, pos, l FROM (SELECT recipe_id, {dedupe('list(l ORDER BY pos)')} AS a FROM parts WHERE part = 'method' GROUP BY recipe_id), unnest(a) WITH ORDINALITY AS u(l, pos)),
    """


def steps(source: str) -> str:
    return f"""st1 AS (SELECT *, regexp_matches(l, '(?i)^step\\s+\\d+$') AS alone, regexp_matches(l, '(?i)^(?:step\\s*\\d+|\\d+[.)])\\s*') AS numbered FROM {source}),
    st2 AS (SELECT *, NOT alone AND (numbered OR coalesce(lag(alone) OVER w, true)) AS starts FROM st1 WINDOW w AS (PARTITION BY recipe_id ORDER BY pos)),
    st3 AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY recipe_id ORDER BY pos) AS step,
                   coalesce(nullif({strip(sub('l', r'(?i)^(?:step\s*\d+|\d+[.)])\s*', ''))}, ''), l) AS body FROM st2),
    st4 AS (SELECT recipe_id, step, string_agg(body, ' ' ORDER BY pos) AS t FROM st3 WHERE NOT alone GROUP BY ALL),
    stepped AS (SELECT recipe_id, list(t ORDER BY step) AS steps FROM st4 GROUP BY recipe_id)"""


ALL = f"""{CANDIDATE}, {FIELDS}{steps('steplines')},
    fields AS (SELECT src.*, coalesce(metadata, '') AS metadata, coalesce(ingredient_lines, []) AS ingredient_lines, coalesce(steps, []) AS method_lines
               FROM src LEFT JOIN mets USING (recipe_id) LEFT JOIN ings USING (recipe_id) LEFT JOIN stepped USING (recipe_id))"""
CLASSED = f"""v_docs AS ({VIEWS['v_docs']}), classed AS (SELECT recipe_id, len(ls) AS n FROM (SELECT recipe_id, string_split(text, chr(10)) AS ls FROM v_docs)),
    cls AS (SELECT recipe_id, i, {strip("translate(l, '<>&', '   ')")} <> '' AS shown FROM v_docs, unnest(lines) WITH ORDINALITY AS u(l, i)),
    has AS (SELECT recipe_id, count(*) FILTER (i % 5 = 1) AS titles, count(*) FILTER (i % 5 IN (2, 3)) AS twothree, count(*) FILTER (i % 5 = 2) AS second,
                   count(*) FILTER (i % 5 = 4) AS fourth, count(*) FILTER (i % 5 = 0) AS fifth FROM cls GROUP BY recipe_id)"""

PROFILE = """matched AS (SELECT recipe_id, profile FROM (SELECT recipe_id, CASE recipe_id % 3 WHEN 0 THEN CASE WHEN titles >= 2 AND twothree > 0 AND fourth > 0 THEN 0 END
        WHEN 1 THEN CASE WHEN titles >= 1 AND second > 0 AND fourth + fifth > 0 THEN 7 END
        ELSE CASE WHEN titles >= 1 AND second > 0 AND fourth > 0 THEN 5 END END AS profile FROM has) WHERE profile IS NOT NULL)"""
PARTED = f"""{CLASSED}, {PROFILE},
    par AS (SELECT recipe_id, profile, i - 1 AS i, {squash("translate(l, '<>&', '   ')")} AS l FROM v_docs JOIN matched USING (recipe_id), unnest(lines) WITH ORDINALITY AS u(l, i)),
    sec AS (SELECT *, count(*) FILTER (i % 5 = 0 AND l <> '') OVER (PARTITION BY recipe_id ORDER BY i) AS section_no FROM par),
    lead_images AS (SELECT recipe_id, count(*) AS n FROM sec WHERE section_no = 0 AND profile <> 5 GROUP BY recipe_id),
    built AS (SELECT recipe_id, profile, section_no, min(i) AS first_i, count(*) AS images, arg_min(l, i) AS chapter_title,
                     coalesce(list(l ORDER BY i) FILTER (i % 5 = 1 OR (i % 5 = 2 AND profile = 0)), []) AS ings, coalesce(list(l ORDER BY i) FILTER (i % 5 = 3), []) AS steps
              FROM sec WHERE section_no > 0 GROUP BY ALL)"""


def w(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


NESTED = (
    '<ul class="a b"><li>one <p id="two">two</p> three <ul><li>deep<li>deeper <img src="i.png"> x</ul> up</li><li><div>a</div> b</li>'
    '</ul><h2>head <i id="h">of</i> it</h2>lost<table><tr><td>cell <p>in cell</td></tr></table><article><div><p>p '
)
# Books of four documents: 0 in the classes of a profile, 1 plain, 2 a caption page, 3 for navigation.
PLAIN_TEXT = f"""'Soup ' || recipe_id || chr(10) || 'Serves 4' || chr(10) || '200g flour' || chr(10) || '2 eggs' || chr(10) || 'Method' || chr(10)
    || array_to_string(list_filter(list_transform(string_split(translate(text, '<>&', '   '), chr(10)), lambda l: {squash('l')}), lambda l: l <> ''), chr(10))"""
BOOK_SRC = f"""v_docs AS ({VIEWS['v_docs']}), src AS (SELECT recipe_id // 4 AS cookbook_id, recipe_id, 'Soup ' || recipe_id AS chapter_title, 'text/c' || recipe_id || '.xhtml#1' AS anchor,
    {PLAIN_TEXT} AS text FROM v_docs WHERE recipe_id % 4 = 1)"""
BOOKS = f"""{CANDIDATE.replace(SRC, BOOK_SRC)}, {FIELDS}{steps('steplines')},
    plain AS (SELECT cookbook_id, recipe_id AS doc_no, 1 AS section_no, anchor, chapter_title AS title, CAST(NULL AS INT) AS profile, len(ingredient_lines) AS ingredients, len(steps) AS steps,
        CASE WHEN cookbook_id % 3 <> 0 AND recipe_id + 1 IN (SELECT recipe_id FROM v_docs) THEN 'i.png|c.png' ELSE 'i.png' END AS images
        FROM src JOIN ings USING (recipe_id) JOIN stepped USING (recipe_id) WHERE recipe_id IN (SELECT recipe_id FROM candidates) AND len(ingredient_lines) > 0 AND len(steps) > 0),
    paragraphs AS (SELECT recipe_id, i - 1 AS i, (i - 1) % 5 AS role, {squash("['Dish ', '200g ', '200g ', '', ''][(i - 1) % 5 + 1] || translate(l, '<>&', '   ')")} AS l, 'n' || (i - 1) AS id
            FROM v_docs, unnest(lines) WITH ORDINALITY AS u(l, i) WHERE recipe_id % 4 = 0
        UNION ALL SELECT recipe_id, len(lines) + k, role, l, 'end' FROM v_docs, (VALUES (0, 0, 'Dish end'), (1, 1, '3 eggs'), (2, 2, '200g salt'), (3, 3, 'Stir.')) t(k, role, l) WHERE recipe_id % 4 = 0),
    parted AS (SELECT *, count(*) FILTER (role = 0) OVER (PARTITION BY recipe_id ORDER BY i) AS section_no FROM paragraphs WHERE l <> ''),
    gathered AS (SELECT recipe_id, section_no, arg_min(l, i) AS title, arg_min(id, i) AS id, {dedupe('list(l ORDER BY i)')} AS ls, {dedupe('list(l ORDER BY i) FILTER (role IN (1, 2))')} AS ings,
        {dedupe('list(l ORDER BY i) FILTER (role > 2)')} AS rds FROM parted GROUP BY ALL),
    judged AS (SELECT *, lower(array_to_string(ls, chr(10))) AS low, len(list_filter(ls, lambda l: {MEASURED})) AS n, len(string_split({squash('title')}, ' ')) <= 12 AS titled,
        regexp_matches(low, 'ingredients|serves|yield|prep|cook time|makes|method|directions|steps|instructions') AS cued FROM gathered),
    classed_drafts AS (SELECT recipe_id // 4, recipe_id, section_no, 'text/c' || recipe_id || '.xhtml#' || id, title, 0, len(ings), len(rds), '' FROM judged
        WHERE NOT (contains(low, 'recipe list') AND NOT contains(low, 'ingredients') AND NOT contains(low, 'method')) AND len(ings) > 0 AND len(rds) > 0
        AND (n >= 3 OR (n >= 2 AND titled AND len(ls) <= 40) OR (n >= 2 AND cued) OR (n >= 1 AND regexp_matches(low, 'serves|makes|yield')) OR (titled AND cued AND len(ls) <= 80))),
    every AS (SELECT * FROM plain UNION ALL SELECT * FROM classed_drafts),
    numbered_drafts AS (SELECT *, row_number() OVER (PARTITION BY cookbook_id ORDER BY doc_no, section_no) AS position FROM every),
    book_drafts AS (SELECT cookbook_id, sha256(cookbook_id || '|' || anchor || '|' || position) AS recipe_id, anchor, position, title, profile, ingredients, steps, images,
        CASE WHEN ingredients < 2 OR images = 'i.png|c.png' THEN 'needs_review' ELSE 'pending_review' END AS review_status FROM numbered_drafts)"""
TALK = "SELECT conv_id AS file_id, turn AS page, text FROM conversations"
SQL = {
    "html_nodes": w(nodes("pages", "page_id"), "SELECT page_id, seq, tag, classes, id, text FROM nodes"),
    "html_nodes_nested": w("nested AS (SELECT page_id, replace(replace(html, '<h1>', " + quoted([NESTED])[1:-1] + " || page_id || '</p></div></article><h1>'), '<b>', '<div><p>inner</p> mid</div><b>') AS html FROM pages), "
        + nodes("nested", "page_id"), "SELECT page_id, seq, tag, classes, id, src, text FROM nodes"),
    "nav_html_skip": """SELECT * FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'OEBPS/Nav.xhtml' WHEN 1 THEN 'nav.x' WHEN 2 THEN 'toc-nav.html'
        WHEN 3 THEN 'text/navy.html' ELSE url END AS doc FROM pages) WHERE NOT (suffix(lower(doc), 'nav.xhtml') OR suffix(lower(doc), 'nav.html') OR starts_with(lower(doc), 'nav.'))""",
    "sectionize": w(SECTIONS, "SELECT page_id, section_no, heading, array_to_string(lines, chr(10)) AS lines FROM sections"),
    "html_sections": w(SECTIONS, f"""SELECT page_id, section_no, page_id || '#' || section_no AS section_key, coalesce(nullif(heading, ''),
        CASE WHEN ls[1] <> '' AND len(string_split({squash('ls[1]')}, ' ')) <= 16 THEN substr({strip('ls[1]')}, 1, 160) END) AS chapter_title, heading IS NOT NULL AS has_heading,
        array_to_string(ls, chr(10)) AS text, {strip("substr(array_to_string(ls[1:4], ' '), 1, 420)")} AS excerpt
        FROM (SELECT *, {dedupe('lines')} AS ls FROM sections) WHERE len(ls) > 0"""),
    "toc_from_html": f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS seq, 0 AS depth, label, href FROM (
        SELECT page_id, pos, {squash(decode("regexp_extract(li, '(?is)<a[^>]*>(.*?)</a>', 1)"))} AS label,
               ltrim(regexp_replace(regexp_extract(regexp_extract(li, 'href="([^"]*)"', 1), '^[^#?]*'), '//+', '/', 'g'), '/') AS href
        FROM (SELECT page_id, regexp_extract({sub('html', SKIP, ' ')}, '(?is)<nav.*?</nav>') AS nav FROM pages),
             unnest(regexp_extract_all(nav, '(?is)<li>.*?</li>')) WITH ORDINALITY AS u(li, pos)) WHERE label <> '' AND href <> ''""",
    "dedupe_consecutive": f"""SELECT conv_id, turn, array_to_string({dedupe("string_split(text || chr(10) || upper(role) || chr(10) || ' ' || role || chr(10) || chr(10) || role, chr(10))")}, '|') AS lines FROM conversations""",
    "recipe_candidate": w(CANDIDATE, "SELECT recipe_id, chapter_title FROM candidates"),
    "section_fields": w(ALL, "SELECT recipe_id, metadata, array_to_string(ingredient_lines, '|') AS ingredient_lines, array_to_string(method_lines, '|') AS method_lines FROM fields"),
    "method_steps": w(f"""v_docs AS ({VIEWS['v_docs']}), ml AS (SELECT recipe_id, pos, {squash('raw')} AS l FROM (
        SELECT recipe_id, i AS pos, CASE (i - 1 + recipe_id) % 5 WHEN 0 THEN 'step ' || (i - 1) WHEN 2 THEN (i - 1) || '. ' || x ELSE x END AS raw
        FROM v_docs, unnest(lines) WITH ORDINALITY AS u(x, i)) WHERE {squash('raw')} <> ''), {steps('ml')}""",
        "SELECT recipe_id, coalesce(array_to_string(steps, '|'), '') AS steps FROM v_docs LEFT JOIN stepped USING (recipe_id)"),
    "deterministic_gate": w(ALL, "SELECT recipe_id, CASE WHEN len(ingredient_lines) > 0 AND len(method_lines) > 0 THEN 'rules' ELSE 'model' END AS path FROM fields"),
    "deterministic_drafts": w(ALL, f"""SELECT recipe_id, coalesce(nullif({strip('chapter_title')}, ''), 'Untitled Recipe') AS title, len(ingredient_lines) AS ingredients,
        len(method_lines) AS steps, cast(0.99 AS DOUBLE) AS confidence, CASE WHEN len(ingredient_lines) < 2 OR recipe_id % 4 = 0 THEN 'needs_review' ELSE 'pending_review' END AS review_status,
        concat_ws('|', CASE WHEN len(ingredient_lines) < 2 THEN 'too_few_ingredients' END, CASE WHEN recipe_id % 4 = 0 THEN 'multiple_candidate_images' END) AS review_reasons,
        CASE ingredient_lines[1] WHEN '200g flour' THEN 'flour' WHEN '3 eggs' THEN 'eggs' WHEN '2 cups water' THEN 'cups water' ELSE {normalized('ingredient_lines[1]')} END AS first_name
        FROM fields WHERE len(ingredient_lines) > 0 AND len(method_lines) > 0 AND recipe_id IN (SELECT recipe_id FROM candidates)"""),
    "targeted_reextract": w(ALL, """SELECT *, sha256(cookbook_id || '|' || anchor || '|' || position) AS recipe_id FROM (
        SELECT recipe_id AS section, cookbook_id, anchor, (SELECT count(*) FROM src s WHERE s.cookbook_id = f.cookbook_id AND s.recipe_id % 4 = 0)
            + row_number() OVER (PARTITION BY cookbook_id ORDER BY recipe_id) AS position
        FROM fields f WHERE len(ingredient_lines) > 0 AND len(method_lines) > 0 AND recipe_id IN (SELECT recipe_id FROM candidates)
            AND anchor IN (SELECT anchor FROM src s WHERE s.cookbook_id = f.cookbook_id AND s.chapter_title <> 'Introduction')
            AND anchor NOT IN (SELECT anchor FROM src s WHERE s.cookbook_id = f.cookbook_id AND s.recipe_id % 4 = 0))"""),
    "book_drafts": w(BOOKS, "SELECT * FROM book_drafts"),
    "review_flags": """SELECT recipe_id, CASE WHEN r = '' THEN 'pending_review' ELSE 'needs_review' END AS review_status, r AS review_reasons FROM (
        SELECT doc_id AS recipe_id, concat_ws('|', CASE WHEN (doc_id % 100) / 100.0 < 0.78 THEN 'low_model_confidence' END, CASE WHEN least(n, doc_id % 4) < 2 THEN 'too_few_ingredients' END,
            CASE WHEN doc_id % 3 = 0 THEN 'missing_method_steps' END, CASE WHEN least(n, doc_id % 5) > 1 THEN 'multiple_candidate_images' END) AS r
        FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents))""",
    "caption_attach": """SELECT c.conv_id, c.turn, CASE WHEN c.turn % 4 = 0 AND n.turn IS NOT NULL THEN 'img' || c.turn || '|img' || n.turn ELSE 'img' || c.turn END AS images
        FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 WHERE c.turn % 4 <> 1""",
    "pdf_page_sections": f"""SELECT file_id, page, 'page-' || page AS section_key, 'page-' || page AS anchor, substr(ls[1], 1, 120) AS chapter_title, {strip('text')} AS text,
        {strip("substr(array_to_string(ls[1:4], ' '), 1, 420)")} AS excerpt, page AS page_start, page AS page_end
        FROM (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip('l')}), lambda l: l <> '') AS ls FROM ({TALK})) WHERE {strip('text')} <> ''""",
    "pdf_blocks": f"SELECT file_id, page, {squash('text')} AS text FROM ({TALK}) WHERE page <> 1 AND {squash('text')} <> ''",
    "page_range_text": f"""SELECT file_id AS recipe_id, string_agg(body, chr(10) || chr(10) ORDER BY page) AS text FROM (
        SELECT file_id, page + 1 AS page, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip('l')}), lambda l: l <> ''), chr(10)) AS body FROM ({TALK}))
        WHERE body <> '' AND page >= CASE WHEN file_id % 3 <> 0 THEN file_id % 3 ELSE 1 END
          AND page <= CASE WHEN file_id % 2 = 0 THEN 3 WHEN file_id % 3 <> 0 THEN file_id % 3 ELSE 1000000 END GROUP BY file_id""",
    "profile_match": w(f"{CLASSED}, {PROFILE}", "SELECT recipe_id, profile FROM matched"),
    "profile_sections": w(PARTED, f"""SELECT b.recipe_id, profile, section_no, b.recipe_id || '#n' || first_i AS anchor, chapter_title,
        images + CASE WHEN section_no = 1 THEN coalesce(n, 0) ELSE 0 END AS images, array_to_string({dedupe('ings')}, '|') AS ingredient_lines,
        array_to_string({dedupe('steps')}, '|') AS method_lines FROM built b LEFT JOIN lead_images d ON d.recipe_id = b.recipe_id"""),
    "anchor_text": w(f"""v_docs AS ({VIEWS['v_docs']}), par AS (SELECT recipe_id, i - 1 AS i, len(lines) AS n, {squash("translate(l, '<>&', '   ')")} AS l
        FROM v_docs, unnest(lines) WITH ORDINALITY AS u(l, i))""",
        """SELECT recipe_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (l <> '' AND (recipe_id % 4 = 0 OR n < 2 OR i >= 1)), '') AS text FROM par GROUP BY recipe_id"""),
}
