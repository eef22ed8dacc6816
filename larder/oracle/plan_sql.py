"""SQL of the plan queries."""

from __future__ import annotations

from larder.oracle.sql import VIEWS, WS, alnum, casefold, canonical_norm, names, normalized, q, squash, strip, sub, with_views

URL = r"https?://\S+"
DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
STOP = names(["a", "an", "and", "for", "fresh", "of", "or", "style", "the", "to", "with"])
MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|"
    "sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
WE = r"(?:$|[^\p{L}\p{N}_])"
HINTS = names(["", "out", "leftover", "leftovers", "snack", "snacks", "soup"])
GROUPS = names(["meal", "meals", "dinner", "dinners", "lunch", "lunches", "snacks", "dinner recipes"])


def let(x: str, name: str, body: str) -> str:
    """Bind an expression to a name inside another one."""
    return f"list_transform([{x}], lambda {name}: {body})[1]"


def meal(x: str) -> str:
    y = alnum(f"replace({sub(f'lower({x})', URL, ' ')}, '&', ' and ')")
    one = (
        "CASE WHEN t IN ('dahl', 'dal') THEN 'daal' WHEN len(t) > 4 AND suffix(t, 'ies') THEN t[:-4] || 'y' "
        "WHEN len(t) > 4 AND suffix(t, 's') AND NOT suffix(t, 'ss') AND NOT suffix(t, 'us') THEN t[:-2] ELSE t END"
    )
    return (
        f"array_to_string(list_transform(list_filter(string_split({y}, ' '), lambda t: t <> '' AND t NOT IN {STOP}), "
        f"lambda t: {one}), ' ')"
    )


def dashes(x: str) -> str:
    return f"trim({x}, ' -:' || chr(9))"


def display(x: str) -> str:
    return let(dashes(x), "c", squash("(CASE WHEN len(c) > 1 AND starts_with(c, '(') AND suffix(c, ')') THEN substr(c, 2, len(c) - 2) ELSE c END)"))


def clean(x: str) -> str:
    return dashes(sub(x, WS + "+", " "))


def trim_heading(x: str) -> str:
    return strip(f"rtrim({strip(x)}, ':')")


def link(x: str) -> str:
    return let(f"rtrim(regexp_replace({x}, '^https?://', ''), '/')", "u", "CASE WHEN len(u) <= 64 THEN u ELSE u[1:61] || '...' END")


def slot_title(x: str) -> str:
    return display(sub(sub(display(x), rf"(?i)^({DAYS})\s*[-:]?\s*", ""), rf"(?i)\(({DAYS})[^)]*\)", ""))


def label(x: str, known: list[str]) -> str:
    low = names([k.lower() for k in known])
    return let(display(x), "k", f"CASE WHEN lower(k) IN {low} THEN upper(k[1]) || lower(k[2:]) ELSE k END")


WEEK = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MEALS = ["Breakfast", "Lunch", "Dinner"]


def day_in(x: str) -> str:
    return let(f"lower(regexp_extract({x}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({DAYS}){WE}', 1))", "w", "upper(w[1]) || w[2:]")


def is_day(x: str) -> str:
    return f"regexp_matches({x}, '(?i)^(?:{DAYS}){WE}')"


def cookable(x: str) -> str:
    return let(meal(x), "m", f"NOT (m IN {HINTS} OR suffix(m, ' out') OR starts_with(m, 'out ') OR suffix(m, ' leftover') "
                             "OR suffix(m, ' leftovers') OR starts_with(m, 'day lunch dinner'))")


def variants(x: str) -> str:
    bad = "sam out|" + DAYS
    base = (
        f"[b, {sub('b', r'\([^)]*\)', '')}, {sub('b', rf'(?i)^({DAYS})\s+', '')}, "
        f"CASE WHEN {is_day('b')} THEN regexp_extract(b, '^[^-:]+[-:]\\s*(.+)$', 1) ELSE '' END, "
        "regexp_extract(b, '(?i)^(?:breakfast|lunch|lunches|dinner|dinners)( .*)$', 1)]"
    )
    asides = (
        "list_filter(regexp_extract_all(b, '\\(([^)]*)\\)', 1), "
        f"lambda p: NOT {is_day('p')} AND NOT regexp_matches({meal('p')}, '{bad}'))"
    )
    return let(display(x), "b", f"list_sort(list_distinct(list_filter(list_transform(list_concat({base}, {asides}), lambda r: {meal('r')}), lambda v: v <> '')))")


def week_start(x: str, year: int = 2024) -> str:
    rest = strip(sub("w", rf"(?i)^week(?:{WS}+\d+)?(?:{WS}+of)?{WS}+", ""))
    dated = (
        "CASE WHEN regexp_full_match(r, '(?i)\\d{1,2} [a-z]+ \\d{4}') THEN try_strptime(r, ['%d %b %Y', '%d %B %Y']) "
        "WHEN regexp_full_match(r, '(?i)\\d{1,2} [a-z]+ \\d{2}') THEN try_strptime(r, ['%d %b %y', '%d %B %y']) "
        "WHEN regexp_full_match(r, '(?i)\\d{1,2} [a-z]+') AND try_strptime(r || ' 1900', ['%d %b %Y', '%d %B %Y']) IS NOT NULL "
        f"THEN try_strptime(r || ' {year}', ['%d %b %Y', '%d %B %Y']) END"
    )
    return let(display(x), "w", "coalesce(CASE WHEN regexp_full_match(w, '\\d{4}-\\d{2}-\\d{2}') THEN cast(try_cast(w AS DATE) AS VARCHAR) "
               f"ELSE {let(rest, 'r', f'cast(cast({dated} AS DATE) AS VARCHAR)')} END, '')")


def parts(x: str) -> str:
    split = f"list_filter(list_transform(regexp_split_to_array({x}, '\\t+|\\s{{2,}}'), lambda p: {strip('p')}), lambda p: p <> '')"
    return let(split, "a", f"CASE WHEN len(a) >= 3 AND {is_day('a[1]')} THEN a[1:3] END")


def entry_title(x: str) -> str:
    """Displayed title of an entry body."""
    no_url = let(clean(sub("c", URL, "")), "n", f"CASE WHEN n = '' THEN {link(f'''regexp_extract(c, '{URL}')''')} ELSE n END")
    titled = let(clean(x), "c", f"CASE WHEN regexp_matches(c, '{URL}') THEN {no_url} ELSE c END")
    cut = clean(f"regexp_extract(t, '(?is)^(.*?){WS}like{WS}', 1)")
    return display(let(titled, "t", f"CASE WHEN contains(lower(t), ' like ') THEN {cut} ELSE t END"))


def url(x: str) -> str:
    return f"nullif(regexp_extract({clean(x)}, '{URL}'), '')"


FORM = """CASE form WHEN 0 THEN 'Week of ' || (1 + i % 28) || ' April 2024' WHEN 1 THEN 'Dinners:' WHEN 2 THEN '- [x] ' || l
    WHEN 3 THEN '  • ' || l WHEN 4 THEN '• ' || l WHEN 5 THEN '' WHEN 6 THEN 'Monday' || chr(9) || l || chr(9) || l
    WHEN 7 THEN 'https://example.com/plan/' || i WHEN 8 THEN '- Tuesday lunch: ' || l || ' https://example.com/a'
    WHEN 9 THEN 'snacks' ELSE l END"""
LINES = f"""SELECT file_id, i AS line_no, {FORM} AS line FROM (
    SELECT doc_id AS file_id, pos - 1 AS i, (doc_id + pos - 1) % 11 AS form, {sub('raw', '[' + chr(92) + 't' + chr(92) + 'r]+', ' ')} AS l
    FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(raw, pos))"""
SECTION = (
    "(regexp_matches(s, '(?i)^(?:week(?:\\s+of)?\\s+)?\\d{1,2}\\s+(?:" + MONTH + ")(?:\\s+\\d{2,4})?$') OR "
    "regexp_matches(s, '(?i)^week(?:\\s+\\d{1,2})?(?:\\s+of)?\\s+(?:\\d{1,2}\\s+)?(?:" + MONTH + ")(?:\\s+\\d{2,4})?$') OR "
    "starts_with(lower(s), 'week '))"
)
GROUP = f"lower({trim_heading('s')}) IN {GROUPS}"
KINDS = f"""lines AS ({LINES}),
    kinds AS (SELECT *, lead(starts_with(s, '•'), 1, false) OVER f AS before_detail,
                     coalesce(lag(kind0) OVER f IN ('blank', 'url', 'schedule', 'section', 'group'), true) AS after_reset
              FROM (SELECT file_id, line_no, {strip('line')} AS s, {parts('s')} AS ps,
                           CASE WHEN s = '' THEN 'blank' WHEN regexp_full_match(s, '{URL}') THEN 'url' WHEN ps IS NOT NULL THEN 'schedule'
                                WHEN {SECTION} THEN 'section' WHEN {GROUP} THEN 'group' WHEN starts_with(s, '•') THEN 'detail' ELSE 'entry' END AS kind0
                    FROM lines) WINDOW f AS (PARTITION BY file_id ORDER BY line_no))"""
BULLET = "regexp_extract(b, '^(?:-|•|\\*)\\s*(.+)$', 1)"
CHECK = "regexp_extract(b, '^-\\s*\\[([ xX])\\]\\s*(.+)$', {n})"
ENTRIES = f"""{KINDS},
    k1 AS (SELECT *, CASE WHEN kind0 = 'detail' AND after_reset THEN 'entry' ELSE kind0 END AS kind FROM kinds),
    k2 AS (SELECT *, count(*) FILTER (kind = 'section') OVER f AS section_no,
                  count(*) FILTER (kind IN ('entry', 'url', 'schedule')) OVER f AS entry_no, {trim_heading('s')} AS h
           FROM k1 WINDOW f AS (PARTITION BY file_id ORDER BY line_no)),
    k3 AS (SELECT *, coalesce(max(h) FILTER (kind = 'section') OVER (PARTITION BY file_id, section_no), 'Imported Plan') AS section_title,
                  last_value(CASE WHEN kind = 'group' THEN h END IGNORE NULLS) OVER s AS heading,
                  count(*) FILTER (kind IN ('entry', 'url', 'schedule') OR (kind = 'group' AND lower(h) <> 'meals')) OVER p AS filled
           FROM k2 WINDOW s AS (PARTITION BY file_id, section_no ORDER BY line_no),
                p AS (PARTITION BY file_id, section_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    pend AS (SELECT file_id, max_by(h, line_no) AS pending FROM k3 WHERE section_no = 0 AND kind = 'group' AND filled = 0 GROUP BY file_id),
    k4 AS (SELECT k3.*, CASE WHEN section_no = 1 THEN coalesce(pending, 'Meals') ELSE 'Meals' END AS initial FROM k3 LEFT JOIN pend USING (file_id)),
    items AS (SELECT *, 0 AS slot, coalesce(heading, initial) AS grp, s AS body, cast(NULL AS VARCHAR) AS day FROM k4 WHERE kind IN ('entry', 'url', 'group')
              UNION ALL SELECT *, 0, 'Lunches', ps[2], ps[1] FROM k4 WHERE kind = 'schedule'
              UNION ALL SELECT *, 1, 'Dinners', ps[3], ps[1] FROM k4 WHERE kind = 'schedule'),
    grouped AS (SELECT *, CASE WHEN lower(grp) = lower(initial) THEN -1 ELSE min(line_no * 2 + slot) OVER g END AS group_at,
                       CASE WHEN lower(grp) = lower(initial) THEN initial ELSE min_by(grp, line_no * 2 + slot) OVER g END AS group_title
                FROM items WINDOW g AS (PARTITION BY file_id, section_no, lower(grp))),
    details AS (SELECT file_id, entry_no, string_agg(t, '|' ORDER BY line_no) AS details, string_agg(t, ' | ' ORDER BY line_no) AS remarks
                FROM (SELECT *, {clean(BULLET.replace('(b,', '(k1.s,'))} AS t FROM k1 JOIN k2 USING (file_id, line_no) WHERE k1.kind = 'detail') WHERE t <> ''
                GROUP BY ALL),
    bodies AS (SELECT *, body AS b, {CHECK.format(n=1)} AS state,
                      CASE WHEN kind = 'schedule' OR (kind = 'entry' AND before_detail) THEN body
                           WHEN kind = 'entry' THEN coalesce(nullif({CHECK.format(n=2)}, ''), nullif({BULLET}, '')) END AS text0
               FROM grouped WHERE kind <> 'group'),
    entries AS (SELECT b.file_id, section_no, section_title, group_at, group_title, line_no, slot,
                       CASE WHEN text0 IS NOT NULL THEN {entry_title('text0')} WHEN kind = 'url' THEN {link('body')} ELSE {clean('body')} END AS title,
                       coalesce(text0, body) AS raw_text, text0 IS NOT NULL AND {cookable(entry_title('text0'))} AS is_recipe,
                       CASE WHEN kind = 'entry' AND NOT before_detail AND state <> '' THEN lower(state) = 'x' END AS is_complete, day,
                       CASE WHEN text0 IS NOT NULL THEN {url('text0')} WHEN kind = 'url' THEN body END AS external_url,
                       coalesce(details, '') AS details, coalesce(remarks, '') AS remarks
                FROM bodies b LEFT JOIN details d ON d.file_id = b.file_id AND d.entry_no = b.entry_no)"""
BOTH = "lower(concat_ws(' ', nullif(raw_text, ''), nullif(title, '')))"
ROWS = f"""{ENTRIES},
    weeks AS (SELECT *, {week_start('section_title')} AS start_on, {display('section_title')} AS legacy, {slot_title('title')} AS slot_title,
                     {label(f"coalesce(nullif({day_in('coalesce(day, chr(32))')}, ''), nullif({day_in('raw_text')}, ''), nullif({day_in('title')}, ''), '')", WEEK)} AS weekday,
                     CASE WHEN contains({BOTH}, 'breakfast') THEN 'Breakfast' WHEN contains({BOTH}, 'lunch') THEN 'Lunch'
                          WHEN contains({BOTH}, 'night') OR contains({BOTH}, 'dinner') THEN 'Dinner'
                          WHEN contains(lower(group_title), 'breakfast') THEN 'Breakfast' WHEN contains(lower(group_title), 'lunch') THEN 'Lunch'
                          ELSE 'Dinner' END AS meal,
                     concat_ws(' | ', nullif(remarks, ''), external_url) AS said FROM entries),
    rows AS (SELECT *, slot_title <> '' AS usable,
                    max(CASE WHEN slot_title <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, section_no) AS any_row,
                    row_number() OVER (PARTITION BY file_id, section_no ORDER BY group_at, line_no, slot) AS nth,
                    CASE WHEN slot_title <> '' AND said <> '' THEN coalesce(nullif(weekday, ''), 'Any day') || ' ' || meal || ' notes: ' || said
                         WHEN slot_title = '' AND external_url IS NOT NULL THEN 'Link: ' || external_url ELSE '' END AS note FROM weeks)"""
TITLE = """CASE recipe_id % 7 WHEN 0 THEN 'Monday - ' || title WHEN 1 THEN 'Dinner ' || title WHEN 2 THEN title || ' (Soup of the day)'
    WHEN 3 THEN 'Tuesday ' || title || ' (sam out)' WHEN 4 THEN '(' || title || ')'
    WHEN 5 THEN array_to_string(string_split(title, ' ')[1:7], ' ') ELSE title END"""
TITLES = f"""v_docs AS ({VIEWS['v_docs']}), titles AS (SELECT recipe_id AS entry_id, {TITLE} AS title FROM v_docs),
    norms AS (SELECT norm, min(recipe_id) AS recipe_id, count(*) AS copies FROM (SELECT recipe_id, {meal('title')} AS norm FROM v_docs) WHERE norm <> '' GROUP BY norm)"""
EXACT = f"""{TITLES}, vs AS (SELECT DISTINCT title, v FROM titles, unnest({variants('title')}) AS u(v)),
    exact AS (SELECT title, min(recipe_id) AS recipe_id FROM vs JOIN norms ON norm = v GROUP BY title)"""
# Ratio by matching blocks: the longest common run of a stretch, earliest in the one and then in the other, and the same
# in what is left and right of it. Cells are pairs of places with equal characters, with the run that begins there.
_LONGEST = """list_max(list_transform(list_filter(cs, lambda c: c.i >= {0}.alo AND c.i < {0}.ahi AND c.j >= {0}.blo AND c.j < {0}.bhi),
        lambda c: {{'k': least(c.n, {0}.ahi - c.i, {0}.bhi - c.j), 'i': -c.i, 'j': -c.j}}))"""
FUZZY = f"""rest AS (SELECT title, v, list_distinct(string_split(v, ' ')) AS tv FROM vs WHERE v <> '' AND title NOT IN (SELECT title FROM exact)),
    tokened AS (SELECT *, list_distinct(string_split(norm, ' ')) AS tn FROM norms),
    met AS (SELECT v, norm, len(list_intersect(tv, tn)) AS shared, len(tv) AS nv, len(tn) AS nn FROM (SELECT DISTINCT v, tv FROM rest), tokened WHERE list_has_any(tv, tn)),
    pairs AS (SELECT row_number() OVER () AS p, *, shared / greatest(nv, nn) * 0.22 + shared / nv * 0.32 + CASE WHEN contains(norm, v) OR contains(v, norm) THEN 0.08 ELSE 0 END + CASE WHEN shared = nv THEN 0.08 ELSE 0 END AS other
        FROM met WHERE shared / greatest(nv, nn) * 0.22 + shared / nv * 0.32 + 0.16 + 0.46 >= 0.77),
    cells AS (SELECT p, list({{'i': i, 'j': j, 'n': n}}) AS cs FROM (SELECT p, i, j, max(i) OVER (PARTITION BY p, i - j, island) - i + 1 AS n FROM (
        SELECT p, i, j, i - row_number() OVER (PARTITION BY p, i - j ORDER BY i) AS island FROM pairs, unnest(range(length(v))) AS a(i), unnest(range(length(norm))) AS b(j)
        WHERE substr(v, CAST(i + 1 AS BIGINT), 1) = substr(norm, CAST(j + 1 AS BIGINT), 1))) GROUP BY p),
    blocks AS (SELECT p, s, {_LONGEST.format('s')} AS best FROM (SELECT p, {{'alo': 0::BIGINT, 'ahi': CAST(length(v) AS BIGINT), 'blo': 0::BIGINT, 'bhi': CAST(length(norm) AS BIGINT)}} AS s FROM pairs) JOIN cells USING (p)
        UNION ALL SELECT p, s, {_LONGEST.format('s')} AS best FROM (SELECT p, unnest([{{'alo': s.alo, 'ahi': -best.i, 'blo': s.blo, 'bhi': -best.j}},
            {{'alo': -best.i + best.k, 'ahi': s.ahi, 'blo': -best.j + best.k, 'bhi': s.bhi}}]) AS s FROM blocks WHERE best IS NOT NULL) JOIN cells USING (p) WHERE s.alo < s.ahi AND s.blo < s.bhi),
    ratios AS (SELECT p, sum(best.k) AS k FROM blocks WHERE best IS NOT NULL GROUP BY p),
    measured AS (SELECT v, norm, 2.0::DOUBLE * coalesce(k, 0) / (length(v) + length(norm)) AS ratio, other, nv FROM pairs LEFT JOIN ratios USING (p)),
    scored AS (SELECT title, recipe_id, max(CASE WHEN v = norm THEN 1.0::DOUBLE ELSE ratio * 0.46 + other - CASE WHEN nv = 1 AND ratio < 0.7 THEN 0.12 ELSE 0 END END) AS score, copies
        FROM rest JOIN measured USING (v) JOIN norms USING (norm) GROUP BY title, recipe_id, copies HAVING score >= 0.74)"""
CLIENT_VARIANTS = let(
    strip("title"), "b",
    f"list_distinct(list_filter(list_transform(list_concat([b, {sub('b', r'\([^)]*\)', ' ')}, {sub('b', rf'(?i)^({DAYS})\s*[-:]?\s*', '')}, "
    f"{sub('b', r'(?i)^(breakfast|lunch|dinner)\s*[-:]?\s*', '')}], regexp_extract_all(b, '\\(([^)]*)\\)', 1)), lambda r: {meal('r')}), lambda v: v <> ''))")
MARGIN = """best AS (SELECT title, max(score) AS best, max_by(recipe_id, score) AS recipe_id FROM scored GROUP BY title)
    SELECT title, recipe_id, round(best, 6) AS score FROM best b WHERE best >= 0.81 AND
    (SELECT sum(copies) FROM scored s WHERE s.title = b.title AND b.best - s.score < 0.035) = 1"""
OFFSETS = f"""CASE WHEN weekday IN {names(WEEK)} THEN (list_position({WEEK}, weekday) - 1 - (isodow(cast(start_on AS DATE)) - 1) + 7) % 7 ELSE 8 END AS day_offset,
    CASE lower(meal) WHEN 'breakfast' THEN 0 WHEN 'lunch' THEN 1 WHEN 'dinner' THEN 2 ELSE 4 END AS meal_offset"""
HEADING = """CASE recipe_id % 9 WHEN 0 THEN cast(created_on AS VARCHAR) WHEN 1 THEN 'Week of ' || strftime(created_on, '%-d %B %Y')
    WHEN 2 THEN 'week 3 of ' || strftime(created_on, '%-d %b') WHEN 3 THEN strftime(created_on, '%d %b %y')
    WHEN 4 THEN 'Week ' || strftime(created_on, '%-d %b') WHEN 5 THEN '3' || (recipe_id % 3) || ' feb ' || strftime(created_on, '%Y')
    WHEN 6 THEN upper(strftime(created_on, '%-d %B')) WHEN 7 THEN strftime(created_on, '%Y-%m-') || '31'
    ELSE 'Plan ' || strftime(created_on, '%b') END AS heading"""
KEY = canonical_norm(normalized("name"))
LABEL = let(strip("raw"), "r", f"CASE WHEN r = '' OR {squash(casefold('r'))} = {squash(casefold('name'))} THEN name "
            f"WHEN regexp_matches(r, '\\d+\\.\\d+') OR contains(r, ',') OR regexp_matches(r, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])or{WE}') OR contains(r, '/') THEN r ELSE name END")
SHOP = f"""v_plan AS ({VIEWS['v_plan']}), v_ingredients AS ({VIEWS['v_ingredients']}),
    dishes AS (SELECT o_orderkey AS recipe_id, 'Dish ' || (o_orderkey % 50) AS title FROM orders),
    used AS (SELECT p.week_id, {KEY} AS key, raw AS label, d.recipe_id, d.title FROM v_plan p JOIN dishes d ON d.recipe_id = p.recipe_id
             JOIN v_ingredients i ON i.recipe_id = d.recipe_id),
    sources AS (SELECT week_id, key, recipe_id, title, count(*) AS use_count, title || CASE WHEN count(*) > 1 THEN ' x' || count(*) ELSE '' END AS source_label
                FROM used GROUP BY week_id, key, recipe_id, title),
    firsts AS (SELECT week_id, key, count(*) AS source_count, arg_min(source_label, (lower(title), recipe_id)) AS first_source FROM sources GROUP BY week_id, key),
    shop AS (SELECT week_id, key, CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE key END AS name, count(*) AS total_uses,
                    source_count, first_source FROM used JOIN firsts USING (week_id, key) GROUP BY week_id, key, source_count, first_source)"""


def k(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + "\n" + body


# Plans of six documents each; a line may be several.
WRITTEN = """SELECT file_id, pos - 1 AS line_no, line FROM (SELECT recipe_id // 6 AS file_id, string_split(string_agg(CASE recipe_id % 6
        WHEN 0 THEN 'Week of ' || (1 + recipe_id // 6 % 28) || ' April 2024' || chr(10) || 'Dinners:' || chr(10) || '- [x] ' || title
        WHEN 1 THEN '• ' || title WHEN 2 THEN title || ' https://example.com/a' WHEN 3 THEN 'Lunches' || chr(10) || '- Tuesday: ' || title || chr(10) || '• for two'
        WHEN 4 THEN '- ' || array_to_string(string_split(title, ' ')[1:7], ' ') ELSE chr(10) || 'Friday' || chr(9) || title || chr(9) || 'Soup' END, chr(10) ORDER BY recipe_id), chr(10)) AS ls
        FROM v_docs GROUP BY 1), unnest(ls) WITH ORDINALITY AS u(line, pos)"""
SQL = {
    "plan_lines": k("SELECT file_id, line_no, s AS line, kind0 AS kind FROM kinds", KINDS),
    "lookahead_line": k("SELECT file_id, line_no, before_detail AS standalone FROM kinds WHERE kind0 IN ('entry', 'detail')", KINDS),
    "meal_text": k(f"SELECT file_id, line_no, {meal('line')} AS meal_text FROM lines", f"lines AS ({LINES})"),
    "title_variants": k(f"SELECT entry_id, array_to_string({variants('title')}, '|') AS variants FROM titles", TITLES),
    "entry_cleaners": k(f"SELECT file_id, line_no, {clean('line')} AS clean_entry, {display('line')} AS display_title, {trim_heading('line')} AS trim_heading, "
                        f"{link('line')} AS link_label, {slot_title('line')} AS slot_title FROM lines", f"lines AS ({LINES})"),
    "plan_labels": with_views("SELECT row_id, weekday, CASE lower(meal) WHEN 'breakfast' THEN 'Breakfast' WHEN 'lunch' THEN 'Lunch' WHEN 'dinner' THEN 'Dinner' ELSE meal END AS meal FROM v_plan", "v_plan"),
    "week_start": with_views(f"SELECT recipe_id, {HEADING}, {week_start('heading')} AS start_on FROM v_recipes", "v_recipes"),
    "week_title": with_views(f"""SELECT recipe_id, CASE WHEN start_on <> '' THEN 'Week of ' || strftime(cast(start_on AS DATE), '%-d %B %Y')
        WHEN recipe_id % 2 = 0 THEN heading ELSE 'Undated Week' END AS title
        FROM (SELECT recipe_id, {HEADING}, {week_start('heading')} AS start_on FROM v_recipes)""", "v_recipes"),
    "heading_tests": k(f"SELECT file_id, line_no, {SECTION} AS is_section, {GROUP} AS is_group FROM (SELECT *, line AS s FROM lines)", f"lines AS ({LINES})"),
    "schedule_row": k(f"SELECT file_id, line_no, a[1] AS day, a[2] AS lunch, a[3] AS dinner FROM (SELECT *, {parts('line')} AS a FROM lines) WHERE a IS NOT NULL", f"lines AS ({LINES})"),
    "build_entry": k(f"""SELECT file_id, line_no, {entry_title('t')} AS title, t AS raw_text, {cookable(entry_title('t'))} AS is_recipe,
        CASE WHEN st <> '' THEN lower(st) = 'x' END AS is_complete, {url('t')} AS external_url
        FROM (SELECT *, trim(line) AS b, {CHECK.format(n=1)} AS st, coalesce(nullif({CHECK.format(n=2)}, ''), nullif({BULLET}, '')) AS t FROM lines)
        WHERE t IS NOT NULL""", f"lines AS ({LINES})"),
    "non_recipe_entries": k(f"SELECT file_id, line_no, slot, title FROM entries WHERE {cookable('title')}", ENTRIES),
    "plan_carry_forward": k("SELECT * EXCLUDE (remarks) FROM entries", ENTRIES),
    "recent_weeks": k("SELECT * FROM (SELECT file_id, dense_rank() OVER (PARTITION BY file_id ORDER BY section_no) - 1 AS week_seq, line_no, slot, title FROM entries) WHERE week_seq < 2", ENTRIES),
    "infer_day_meal": k("""SELECT file_id, line_no, slot, start_on, CASE WHEN start_on = '' AND lower(legacy) <> 'new week' THEN legacy ELSE '' END AS legacy_title,
        slot_title AS title, CASE WHEN usable THEN weekday ELSE '' END AS weekday, CASE WHEN usable THEN meal ELSE '' END AS meal,
        usable AND coalesce(is_complete, false) AS completed FROM rows WHERE usable OR (any_row = 0 AND nth = 1)""", ROWS),
    "plan_notes": k(f"SELECT file_id, section_no, {strip('n')} AS notes FROM (SELECT file_id, section_no, string_agg(note, chr(10) ORDER BY group_at, line_no, slot) AS n FROM rows WHERE note <> '' GROUP BY ALL)", ROWS),
    "exact_title_match": k("SELECT * FROM exact", EXACT),
    "fuzzy_title_match": "WITH RECURSIVE " + ", ".join([EXACT, FUZZY, MARGIN.replace("round(best, 6)", "round(best, 4)")]),
    "import_plans": "WITH RECURSIVE " + ", ".join([
        f"v_docs AS ({VIEWS['v_docs']})", ROWS.replace(LINES, WRITTEN),
        EXACT.replace(f"v_docs AS ({VIEWS['v_docs']}), ", "").replace(
            f"titles AS (SELECT recipe_id AS entry_id, {TITLE} AS title FROM v_docs)", "titles AS (SELECT DISTINCT title FROM rows WHERE usable AND is_recipe AND title <> '')"),
        FUZZY, MARGIN.replace("\n    SELECT title, recipe_id, round(best, 6) AS score", ",\n    nearest AS (SELECT title, recipe_id, round(best, 4) AS score") + ")"]) + f"""
        , linked AS (SELECT * FROM nearest UNION ALL SELECT title, recipe_id, 1.0 FROM exact),
        said AS (SELECT file_id, section_no, {strip("string_agg(note, chr(10) ORDER BY group_at, line_no, slot)")} AS notes FROM rows WHERE note <> '' GROUP BY ALL),
        kept AS (SELECT * REPLACE (CASE WHEN usable THEN weekday ELSE '' END AS weekday, CASE WHEN usable THEN meal ELSE '' END AS meal) FROM rows WHERE usable OR (any_row = 0 AND nth = 1))
        SELECT file_id, section_no, start_on, row_number() OVER (PARTITION BY file_id, section_no ORDER BY day_offset, meal_offset, group_at, line_no, slot) AS rank, weekday, meal, slot_title AS title,
            usable AND coalesce(is_complete, false) AS completed, recipe_id, score, notes
        FROM (SELECT *, {OFFSETS} FROM kept) k LEFT JOIN linked l ON l.title = k.title AND k.is_recipe LEFT JOIN said USING (file_id, section_no)""",
    "client_title_match": k(MARGIN.replace("best AS", """scored AS (SELECT title, recipe_id, max(score) AS score, copies FROM (
        SELECT title, recipe_id, copies, CASE WHEN v = norm THEN 1.0 ELSE shared / greatest(nv, nn) * 0.5 + shared / nv * 0.35
               + CASE WHEN contains(norm, v) OR contains(v, norm) THEN 0.15 ELSE 0 END + CASE WHEN shared = nv THEN 0.08 ELSE 0 END
               - CASE WHEN nv = 1 AND shared < nv THEN 0.12 ELSE 0 END END AS score
        FROM (SELECT *, len(list_intersect(tv, tn)) AS shared, len(tv) AS nv, len(tn) AS nn FROM cv, tn_norms WHERE list_has_any(tv, tn)))
        GROUP BY ALL HAVING max(score) >= 0.8),
        best AS""", 1).replace("scored AS", "scored AS", 1), TITLES,
        f"cv AS (SELECT DISTINCT title, v, list_distinct(string_split(v, ' ')) AS tv FROM titles, unnest({CLIENT_VARIANTS}) AS u(v))",
        "tn_norms AS (SELECT *, list_distinct(string_split(norm, ' ')) AS tn FROM norms)", "_x AS (SELECT 1)").replace("_x AS (SELECT 1)\n", "_x AS (SELECT 1),\n"),
    "best_with_margin": k(MARGIN.replace("best AS", "scored AS (SELECT l_orderkey AS title, l_partkey AS recipe_id, round(l_extendedprice / 100000, 4) AS score, count(*) AS copies FROM lineitem GROUP BY ALL), best AS", 1), "_x AS (SELECT 1)").replace("_x AS (SELECT 1)\n", "_x AS (SELECT 1),\n"),
    "resolve_reference": k("""SELECT e.entry_id AS row_id, CASE e.entry_id % 4 WHEN 0 THEN coalesce((SELECT recipe_id FROM v_docs d WHERE d.recipe_id = e.entry_id + 1), x.recipe_id)
        WHEN 2 THEN coalesce((SELECT recipe_id FROM v_docs d WHERE d.recipe_id = e.entry_id * 2), x.recipe_id) ELSE x.recipe_id END AS recipe_id
        FROM titles e LEFT JOIN exact x ON x.title = e.title""", EXACT),
    "sort_plan_rows": with_views("""SELECT week_id, row_id, day_offset, meal_offset,
        row_number() OVER (PARTITION BY week_id ORDER BY day_offset, meal_offset, row_seq) AS rank FROM (SELECT *, """ + OFFSETS + " FROM v_plan)", "v_plan"),
    "plan_link_hydrate": with_views("SELECT row_id, r.recipe_id, priority AS recipe_title FROM v_plan p LEFT JOIN v_recipes r ON r.recipe_id = p.recipe_id", "v_plan", "v_recipes"),
    "next_week_start": with_views("""SELECT plan_id, cast(d - cast(dayofweek(d) AS INT) AS VARCHAR) AS start_on FROM (
        SELECT cookbook_id AS plan_id, max_by(created_on, recipe_id) + 7 AS d FROM v_recipes WHERE recipe_id % 3 <> 0 GROUP BY 1)""", "v_recipes"),
    "shopping_list": k("SELECT week_id, name, total_uses, source_count, first_source, row_number() OVER (PARTITION BY week_id ORDER BY lower(name), lower(first_source), key) AS rank FROM shop", SHOP),
    "shopping_sources": k("SELECT week_id, key, recipe_id, use_count, source_label FROM sources", SHOP),
    "shopping_label": with_views(f"SELECT raw, name, {LABEL} AS label FROM (SELECT DISTINCT CASE WHEN line_no % 3 = 0 THEN regexp_extract(raw, '^[^,]*') ELSE raw END AS raw, name FROM v_ingredients)", "v_ingredients"),
    "plan_stats": k("""SELECT week_id, count(*) FILTER (title <> '') AS planned, count(recipe_id) AS linked, count(*) FILTER (completed AND title <> '') AS completed,
        coalesce((SELECT count(*) FROM shop s WHERE s.week_id = p.week_id), 0) AS shopping_items FROM v_plan p GROUP BY week_id
        UNION ALL SELECT 'all', count(*) FILTER (title <> ''), count(recipe_id), count(*) FILTER (completed AND title <> ''), (SELECT count(*) FROM shop) FROM v_plan""", SHOP),
    "recipe_options": with_views(f"""SELECT recipe_id, title || ' - ' || cookbook_title || ' [' || recipe_id || ']' AS label, {casefold('title')} AS title_key,
        {casefold('cookbook_title')} AS cookbook_key FROM v_docs""", "v_docs"),
    "plan_rows_to_json": with_views("""SELECT o_custkey || '/' || strftime(o_orderdate, '%Y-%m') AS file_id, week_id, start_on, 'r' || row_id AS row_id, weekday,
        CASE lower(meal) WHEN 'breakfast' THEN 'Breakfast' WHEN 'lunch' THEN 'Lunch' WHEN 'dinner' THEN 'Dinner' ELSE meal END AS meal, title, completed,
        cast(recipe_id AS VARCHAR) AS recipe_id FROM v_plan JOIN orders ON o_orderkey = row_id""", "v_plan"),
    "plan_rows_from_json": """SELECT o_orderkey AS file_id, CASE o_orderkey % 3 WHEN 0 THEN 'w1' ELSE 'week-0' END AS week_id, 0 AS week_seq,
        CASE o_orderkey % 3 WHEN 0 THEN '2024-04-14' ELSE '' END AS start_on, CASE o_orderkey % 3 WHEN 1 THEN '11 April 2024' ELSE '' END AS legacy_title,
        '' AS notes, CASE o_orderkey % 3 WHEN 0 THEN 'a' ELSE 'row-0-0' END AS row_id, 0 AS row_seq,
        ['Tuesday', 'friday', ''][o_orderkey % 3 + 1] AS weekday0, ['Dinner', 'Lunch', ''][o_orderkey % 3 + 1] AS meal,
        CASE WHEN o_orderkey % 3 < 2 THEN o_orderpriority ELSE '' END AS title,
        CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 2 = 0 WHEN 1 THEN true ELSE false END AS completed,
        CASE WHEN o_orderkey % 3 = 1 THEN cast(o_orderkey AS VARCHAR) END AS recipe_id FROM orders""".replace("'friday'", "'Friday'").replace("weekday0", "weekday"),
    "plan_format_union": """SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 3 = 0 THEN 'a' END AS row_id,
        CASE WHEN o_orderkey % 3 < 2 THEN o_orderpriority ELSE '' END AS title,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 END AS completed,
        CASE WHEN o_orderkey % 3 = 1 THEN cast(o_orderkey AS VARCHAR) END AS recipe_id FROM orders""",
}
_ = q
