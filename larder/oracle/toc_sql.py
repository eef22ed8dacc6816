"""SQL of the table-of-contents queries."""

from __future__ import annotations

from larder.oracle.sql import VIEWS, squash

IGNORED = "lower(rtrim(label, ':')) IN ('index', 'introduction', 'title', 'contents')"
NAMED = r"(regexp_matches(label, '[A-Za-z]') AND (regexp_matches(label, '(?i)^(?:chapter(?:$|[^\p{L}\p{N}_])|\d+[.:)]\s|\d+\s+-\s)') OR NOT regexp_matches(label, '[a-z]')))"
TWO = f"array_to_string(string_split({squash('l')}, ' ')[1:2], ' ')"
BOOKS = f"""v_docs AS ({VIEWS['v_docs']}),
    toc AS (SELECT recipe_id AS cookbook_id, pos - 1 AS i, len(lines) AS n, [0, 1, 1, 2][(pos - 1) % 4 + 1] AS depth, (pos - 1) % 4 IN (0, 2) AND pos < len(lines) AS has_children,
        CASE (pos - 1) % 5 WHEN 0 THEN 'Chapter ' || (pos - 1) WHEN 1 THEN 'A' || upper(regexp_extract(l, '[A-Za-z]*')) WHEN 2 THEN 'Index' WHEN 3 THEN '3. ' || {TWO} ELSE 'About ' || {TWO} END AS label,
        ((pos - 1) * 3 + recipe_id) % (len(lines) * 2) AS spot FROM v_docs, unnest(lines) WITH ORDINALITY AS u(l, pos)),
    spine AS (SELECT recipe_id AS cookbook_id, unnest(range(0, len(lines) * 2)) AS spot, len(lines) AS n FROM v_docs),
    sib AS (SELECT *, (SELECT min_by(spot, i) FROM toc b WHERE b.cookbook_id = a.cookbook_id AND b.i > a.i AND b.depth <= a.depth) AS next_at FROM toc a)"""


def mapping(name: str, grouped: bool, recipes_only: bool) -> str:
    recipe = "spot % 3 = 1" if recipes_only else "true"
    leaf = f"(depth > 0 AND NOT {NAMED}) OR (depth = 0 AND coalesce(nullif(next_at, 0), 2 * n) - spot <= 1 AND NOT {NAMED} AND NOT {recipe})"
    if grouped:
        leaf += f" OR {recipe}"
    return f"""m_{name} AS (SELECT * FROM sib WHERE NOT ({IGNORED}) AND (has_children OR NOT ({leaf}))),
    c_{name} AS (SELECT cookbook_id, spot, arg_min(label, ({'-depth' if grouped else 'depth'}, i)) AS label FROM m_{name} GROUP BY ALL),
    {name} AS (SELECT s.cookbook_id, s.spot, (SELECT max_by(label, c.spot) FROM c_{name} c WHERE c.cookbook_id = s.cookbook_id AND c.spot <= s.spot) AS label
               FROM spine s WHERE {recipe.replace('spot', 's.spot')}),
    n_{name} AS (SELECT cookbook_id, count(label) AS mapped, count(*) AS wanted FROM {name} GROUP BY cookbook_id)"""


MAPPED = f"""{BOOKS}, {mapping('grouped', True, True)}, {mapping('plain', False, True)},
    chosen AS (SELECT p.cookbook_id, p.spot, CASE WHEN mapped >= greatest(1, wanted // 2) THEN g.label ELSE p.label END AS label
               FROM plain p JOIN grouped g ON g.cookbook_id = p.cookbook_id AND g.spot = p.spot JOIN n_grouped ng ON ng.cookbook_id = p.cookbook_id)"""
DISHES = """picks AS (SELECT recipe_id AS cookbook_id, title, position, (step + recipe_id) % (len(lines) * 2) AS spot, (recipe_id + position) % 4 AS form
        FROM v_docs, (VALUES (0, 0), (1, 3), (2, 6), (3, 40)) t(position, step)),
    dishes AS (SELECT *, cookbook_id * 10 + position AS recipe_id, CASE WHEN form = 3 THEN NULL ELSE spot END AS at_spot, cookbook_id % 5 = 0 AS pdf FROM picks)"""
LABEL = f"""CASE WHEN form = 0 AND lower(title) <> 'own' THEN 'OWN' WHEN pdf AND title <> '' AND len(string_split('Soups', ' ')) <= 8 THEN 'Soups' WHEN form = 3 THEN 'Chapter 12' ELSE 'Recipes' END"""

HALF = MAPPED.replace("AS u(l, pos)),\n    spine", "AS u(l, pos) WHERE pos <= len(lines) // 2),\n    spine")
SCORE = "SELECT cookbook_id, count(label) AS s1, (SELECT count(*) FROM toc t WHERE t.cookbook_id = c.cookbook_id) AS s2 FROM chosen c GROUP BY cookbook_id"


def w(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


SQL = {
    "toc_flatten": w(f"v_docs AS ({VIEWS['v_docs']})", """SELECT cookbook_id, row_number() OVER (PARTITION BY cookbook_id ORDER BY k, o) - 1 AS seq, depth, label, 'p' || i AS href, has_children FROM (
        SELECT recipe_id AS cookbook_id, (pos - 1) // 4 AS k, [0, 1, 3, 2][(pos - 1) % 4 + 1] AS o, [0, 1, 1, 2][(pos - 1) % 4 + 1] AS depth, l AS label, pos - 1 AS i,
               CASE (pos - 1) % 4 WHEN 0 THEN pos < len(lines) WHEN 1 THEN pos + 1 < len(lines) ELSE false END AS has_children
        FROM v_docs, unnest(lines) WITH ORDINALITY AS u(l, pos) WHERE recipe_id % 5 <> 0)"""),
    "next_sibling": w(BOOKS, "SELECT cookbook_id, i AS seq, spot AS at, next_at FROM sib".replace(" AS at,", ' AS "at",')),
    "chapter_map": w(MAPPED, "SELECT cookbook_id, 't/p' || spot AS path, label FROM chosen WHERE label IS NOT NULL"),
    "chapter_map_plain": w(f"{BOOKS}, {mapping('plain', False, False)}", "SELECT cookbook_id, 't/p' || spot AS path, label FROM plain WHERE label IS NOT NULL"),
    "collapse_markers": w(BOOKS, """SELECT cookbook_id, true AS deep, i % 3 AS start, max(depth) AS depth, arg_min(label, (-depth, i)) AS label FROM toc GROUP BY cookbook_id, i % 3
        UNION ALL SELECT cookbook_id, false, i % 3, min(depth), arg_min(label, (depth, i)) FROM toc GROUP BY cookbook_id, i % 3"""),
    "spine_asof": w(BOOKS, """SELECT s.cookbook_id, s.spot AS idx, 't/p' || s.spot AS path, t.label FROM spine s
        LEFT JOIN toc t ON t.cookbook_id = s.cookbook_id AND s.spot > 0 AND t.i = (s.spot - 1) // 2"""),
    "facet_catalog_stats": w(MAPPED, """SELECT cookbook_id, count(label) AS s1, (SELECT count(*) FROM toc t WHERE t.cookbook_id = c.cookbook_id) AS s2, count(label) AS s3
        FROM chosen c GROUP BY cookbook_id UNION ALL SELECT cookbook_id, n, n_plain.mapped, 0 FROM (SELECT DISTINCT cookbook_id, n FROM toc WHERE n = 0) JOIN n_plain USING (cookbook_id)"""),
    "best_toc": f"""WITH f AS (WITH {MAPPED} {SCORE}), h AS (WITH {HALF} {SCORE}),
        pairs AS (SELECT f.cookbook_id, f.s2 AS whole, h.s2 AS half, h.s2 > 0 AND (h.s1 > f.s1 OR (h.s1 = f.s1 AND h.s2 >= f.s2)) AS first_half
                 FROM f JOIN h ON h.cookbook_id = f.cookbook_id)
        SELECT cookbook_id, CASE WHEN first_half THEN 0 ELSE 1 END AS candidate, CASE WHEN first_half THEN half ELSE whole END AS entries FROM pairs""",
    "chapter_label": w(f"{MAPPED}, {DISHES}", f"""SELECT recipe_id, coalesce(c.label, {LABEL}) AS label FROM dishes r
        LEFT JOIN chosen c ON c.cookbook_id = r.cookbook_id AND c.spot = r.at_spot"""),
    "section_from_toc": w(f"""{BOOKS}, {DISHES},
        known AS (SELECT DISTINCT cookbook_id, at_spot AS spot FROM dishes WHERE at_spot IS NOT NULL AND NOT pdf),
        ends AS (SELECT *, coalesce((SELECT min(i) FROM toc b WHERE b.cookbook_id = a.cookbook_id AND b.i > a.i AND b.depth <= a.depth), n) AS fin FROM toc a),
        held AS (SELECT DISTINCT e.cookbook_id, e.i, e.depth, e.label, e.fin, t.spot FROM ends e JOIN toc t ON t.cookbook_id = e.cookbook_id AND t.i >= e.i AND t.i < e.fin
                 JOIN known k ON k.cookbook_id = t.cookbook_id AND k.spot = t.spot),
        big AS (SELECT cookbook_id, depth FROM held GROUP BY cookbook_id, i, depth HAVING count(*) > 1),
        target AS (SELECT cookbook_id, coalesce(min(depth) FILTER (depth > 0), min(depth)) AS depth FROM big GROUP BY cookbook_id),
        owner AS (SELECT h.cookbook_id, h.spot, arg_min(h.label, (fin, -h.depth, i)) AS section, arg_min(i, (fin, -h.depth, i)) AS entry
                  FROM held h JOIN target t ON t.cookbook_id = h.cookbook_id AND t.depth = h.depth GROUP BY h.cookbook_id, h.spot)""",
        f"""SELECT r.cookbook_id, r.recipe_id, coalesce(o.section, {LABEL}) AS section, o.entry FROM dishes r JOIN target t ON t.cookbook_id = r.cookbook_id
        LEFT JOIN owner o ON o.cookbook_id = r.cookbook_id AND o.spot = r.at_spot AND NOT r.pdf"""),
    "order_sections": w(f"""{BOOKS}, labels AS (SELECT cookbook_id, i AS seq, {squash('label')} AS label FROM toc),
        raw AS (SELECT cookbook_id, x.section_no, x.title FROM (SELECT DISTINCT cookbook_id FROM toc), (VALUES (0, 'Index'), (1, 'Index'), (2, 'Nowhere')) x(section_no, title)
                UNION ALL SELECT cookbook_id, 3 + least(n, 3) - 1 - i, {squash('label')} FROM toc WHERE i < 3),
        mine AS (SELECT *, row_number() OVER (PARTITION BY cookbook_id, title ORDER BY section_no) AS nth FROM raw),
        theirs AS (SELECT *, row_number() OVER (PARTITION BY cookbook_id, label ORDER BY seq) AS nth FROM labels)""",
        """SELECT m.cookbook_id, section_no, title, t.seq AS toc_seq, row_number() OVER (PARTITION BY m.cookbook_id ORDER BY t.seq NULLS LAST, section_no) AS rank
        FROM mine m LEFT JOIN theirs t ON t.cookbook_id = m.cookbook_id AND t.label = m.title AND t.nth = m.nth"""),
    "toc_from_ncx": w(f"""v_docs AS ({VIEWS['v_docs']}), pts AS (SELECT recipe_id AS doc, pos - 1 AS i, {squash("translate(l, '<>&', '   ')")} AS l FROM v_docs, unnest(lines) WITH ORDINALITY AS u(l, pos)
        WHERE recipe_id % 6 <> 0), good AS (SELECT * FROM pts WHERE i % 4 <> 3 AND l <> '')""",
        """SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY i, depth) - 1 AS seq, depth, label, href FROM (
        SELECT doc, i, 0 AS depth, l AS label, 'OEBPS/a/p' || i || '.xhtml' AS href FROM good UNION ALL SELECT doc, i, 1, 'Sub', 'OEBPS/s.xhtml' FROM good)"""),
}
