"""Builders of DuckDB expressions and views, the independent side of the checks."""

from __future__ import annotations

WS = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{q(pattern)}', '{q(by)}', 'g')"


def q(s: str) -> str:
    return s.replace("'", "''")


def names(values) -> str:
    return "(" + ", ".join(f"'{q(v)}'" for v in values) + ")"


def squash(x: str) -> str:
    return f"trim({sub(x, WS + '+', ' ')})"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def alnum(x: str) -> str:
    return f"trim({sub(x, '[^a-z0-9]+', ' ')})"


def word_count(x: str) -> str:
    return f"(CASE WHEN {squash(x)} = '' THEN 0 ELSE len(string_split({squash(x)}, ' ')) END)"


def title_case(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), "
        "lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), '')"
    )


def normalized(x: str) -> str:
    y = sub(casefold(f"coalesce({x}, '')"), f"^optional:{WS}*", "")
    y = sub(y, WS + r"*\([^)]*\)", " ")
    return alnum(sub(y, f"^(a|an|the){WS}+", ""))


PASTA = [
    "cavatappi", "conchiglie", "farfalle", "fusilli", "linguine", "macaroni", "orzo", "paccheri",
    "pappardelle", "penne", "rigatoni", "spaghetti", "tagliatelle",
]
CHEESE = ["cheddar", "feta", "gruyere", "halloumi", "mozzarella", "parmesan", "pecorino", "ricotta"]


def canonical_norm(n: str) -> str:
    return (
        f"(CASE WHEN {n} IN ('goats cheese', 'goat s cheese') THEN 'goat cheese' "
        f"WHEN regexp_full_match({n}, '({'|'.join(PASTA)}) pasta') THEN {n}[:-7] "
        f"WHEN regexp_full_match({n}, '({'|'.join(CHEESE)}) cheese') THEN {n}[:-8] ELSE {n} END)"
    )


def with_views(body: str, *views: str) -> str:
    """``body`` with the named views, in the given order, as common table expressions."""
    return "WITH RECURSIVE " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views) + "\n" + body


VIEWS = {
    "v_recipes": """
        SELECT o_orderkey AS recipe_id, o_custkey AS cookbook_id, o_orderkey AS position,
               cast(o_orderdate AS DATE) AS created_on,
               CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'pending_review'
                                  WHEN 'P' THEN 'needs_review' END AS review_status,
               o_orderpriority AS priority
        FROM orders""",
    "v_ingredients": """
        SELECT l_orderkey AS recipe_id, l_partkey AS part_id, l_linenumber AS line_no,
               cast(l_quantity AS INT) || 'g ' || p_name || ', ' || lower(p_type) AS raw, p_name AS name
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_index": """
        SELECT DISTINCT l_orderkey AS recipe_id, p_name AS name
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_parts": "SELECT DISTINCT l_orderkey AS recipe_id, l_partkey AS name FROM lineitem",
    "v_cookbooks": """
        SELECT c_custkey AS cookbook_id, c_name AS title,
               CASE WHEN c_acctbal >= 0 THEN n_name END AS author, n_name AS cuisine,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'nytimes' WHEN 'AUTOMOBILE' THEN 'jamie-oliver'
                    WHEN 'MACHINERY' THEN 'bbc-goodfood' WHEN 'HOUSEHOLD' THEN 'waitrose-recipes'
                    END AS collection_slug,
               CASE WHEN c_custkey % 11 <> 0 THEN
                    CASE WHEN c_custkey % 3 = 0 THEN cast(1990 + c_custkey % 30 AS VARCHAR)
                         ELSE (1990 + c_custkey % 30) || '-' || lpad(cast(1 + c_custkey % 12 AS VARCHAR), 2, '0')
                    END END AS published_at,
               1577836800 + (c_custkey * 7919) % 1000003 AS uploaded_epoch,
               CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 7 END AS recipe_count,
               c_acctbal AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_docs": f"""
        SELECT doc_id AS recipe_id, source AS cookbook_title, lang,
               array_to_string(string_split({squash('text')}, ' ')[1:8], ' ') AS title, text,
               string_split(text, chr(10)) AS lines
        FROM documents""",
    "v_search": f"""
        SELECT recipe_id, title, cookbook_title, lower(title) AS f1, {squash('lang')} AS f2,
               lower(array_to_string(list_filter(lines, lambda x: regexp_matches(x, '[0-9]')), ' ')) AS f3,
               lower(cookbook_title) AS f4, lower(array_to_string(lines, ' ')) AS f5,
               lower(substr(array_to_string(lines[1:4], ' '), 1, 420)) AS f6
        FROM v_docs""",
    "v_toggles": """
        SELECT event_id, ts,
               CASE WHEN event_type IN ('click', 'view') THEN 'favourite' ELSE 'want_to_try' END AS kind,
               cast(json_extract_string(props, '$.k') AS BIGINT) AS recipe_id,
               event_type IN ('click', 'purchase') AS is_on
        FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error')""",
    "v_plan": """
        SELECT 'week-' || start_on AS week_id, start_on, key AS row_id, key AS row_seq,
               CASE WHEN key % 17 <> 0 THEN dayname(day) ELSE '' END AS weekday,
               ['breakfast', 'LUNCH', 'Dinner', 'Tea', ''][key % 5 + 1] AS meal,
               CASE WHEN key % 19 <> 0 THEN 'Order ' || o_orderpriority ELSE '' END AS title,
               o_orderstatus = 'F' AS completed,
               CASE WHEN key % 5 <> 0 THEN CASE WHEN key % 7 <> 0 THEN key ELSE key + 1000000000000 END END AS recipe_id
        FROM (SELECT *, o_orderkey AS key, cast(o_orderdate AS DATE) AS day,
                     cast(cast(o_orderdate AS DATE) - cast(dayofweek(o_orderdate) AS INT) AS VARCHAR) AS start_on
              FROM orders)""",
}


def scored(terms: list[str]) -> str:
    """Keyword score over v_search for the terms, with matched terms joined by a bar."""
    weights = {"f1": 5.0, "f2": 4.0, "f3": 3.0, "f4": 2.0, "f5": 1.5, "f6": 1.0}
    parts = [
        f"CASE WHEN contains({f}, '{t}') THEN {w} ELSE 0 END" for t in terms for f, w in weights.items()
    ]
    distinct = list(dict.fromkeys(terms))
    hit = [
        f"CASE WHEN {' OR '.join(f'contains({f}, {chr(39)}{t}{chr(39)})' for f in weights)} THEN '{t}' END"
        for t in distinct
    ]
    return (
        "SELECT * FROM (SELECT recipe_id, title, cookbook_title, cast(" + " + ".join(parts)
        + " AS DOUBLE) AS score, array_to_string(list_filter([" + ", ".join(hit)
        + "], lambda x: x IS NOT NULL), '|') AS matched_terms FROM v_search) WHERE score > 0"
    )
