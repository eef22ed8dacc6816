"""SQL of the network queries."""

from __future__ import annotations

from larder.oracle.sql import VIEWS

PAIRS = (
    "SELECT a.name AS src, b.name AS dst, count(*) AS weight FROM {v} a JOIN {v} b "
    "ON a.recipe_id = b.recipe_id AND a.name < b.name GROUP BY ALL"
)
NODES = "SELECT name, count(*) AS frequency FROM {v} GROUP BY name HAVING count(*) >= {n}"
COMPONENT_ROUNDS = 12
COMPONENTS = """
    sym AS (SELECT src AS a, dst AS b, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
    l0 AS (SELECT name, name AS least FROM nodes),
    {rounds},
    labels AS (SELECT name, least AS component FROM l{last}),
    sizes AS (SELECT component, count(*) AS size FROM labels GROUP BY component)""".format(
    last=COMPONENT_ROUNDS,
    rounds=",\n    ".join(
        f"l{i + 1} AS MATERIALIZED (SELECT name, min(least) AS least FROM (SELECT * FROM l{i} UNION ALL "
        f"SELECT sym.b, l{i}.least FROM l{i} JOIN sym ON sym.a = l{i}.name) GROUP BY name)"
        for i in range(COMPONENT_ROUNDS)
    ),
)
ROUNDS = 14


def graph(kind: str) -> str:
    if kind == "parts":
        return (
            f"v_parts AS ({VIEWS['v_parts']}), nodes AS ({NODES.format(v='v_parts', n=3)}), "
            "kept AS (SELECT * FROM v_parts WHERE name IN (SELECT name FROM nodes)), "
            f"edges AS MATERIALIZED ({PAIRS.format(v='kept')})"
        )
    return (
        f"v_index AS ({VIEWS['v_index']}), nodes AS ({NODES.format(v='v_index', n=3)}), "
        "kept AS (SELECT * FROM v_index WHERE name IN (SELECT name FROM nodes)), "
        f"edges AS MATERIALIZED ({PAIRS.format(v='kept')})"
    )


def paths(giant: str = "(SELECT component FROM sizes ORDER BY size DESC, component LIMIT 1)") -> str:
    steps = ",\n".join(
        f"w{i + 1} AS (SELECT s, n, min(d) AS d FROM (SELECT * FROM w{i} UNION ALL SELECT w.s, e.b, w.d + 1.0 / e.weight "
        f"FROM w{i} w JOIN inn e ON e.a = w.n) GROUP BY s, n)"
        for i in range(ROUNDS)
    )
    return f"""{COMPONENTS},
    giant AS (SELECT name FROM labels WHERE component = {giant}),
    inn AS (SELECT * FROM sym WHERE a IN (FROM giant) AND b IN (FROM giant)),
    bfs AS (SELECT DISTINCT a AS s, a AS n, 0 AS d FROM inn
            UNION SELECT bfs.s, inn.b, d + 1 FROM bfs JOIN inn ON inn.a = bfs.n WHERE d < 40),
    hops AS (SELECT s, n, min(d) AS d FROM bfs GROUP BY s, n HAVING min(d) > 0),
    close AS (SELECT s AS name, count(*) AS reachable, cast(sum(d) AS BIGINT) AS total_distance, max(d) AS eccentricity,
                     count(*) / sum(d) AS closeness FROM hops GROUP BY s),
    w0 AS (SELECT DISTINCT a AS s, a AS n, cast(0 AS DOUBLE) AS d FROM inn),
    {steps},
    wclose AS (SELECT s AS name, count(*) / sum(d) AS weighted_closeness FROM w{ROUNDS} WHERE s <> n GROUP BY s)"""


DEGREES = """
    deg AS (SELECT a AS name, count(*) AS degree, cast(sum(weight) AS BIGINT) AS strength FROM sym GROUP BY a),
    degrees AS (SELECT n.name, frequency, coalesce(degree, 0) AS degree, coalesce(strength, 0) AS strength,
                       coalesce(degree, 0) / ((SELECT count(*) FROM nodes) - 1) AS degree_centrality
                FROM nodes n LEFT JOIN deg ON deg.name = n.name)"""
COLUMNS = {
    "degree": ("degree_centrality", 24), "strength": ("strength", 48), "closeness": ("closeness", 24),
    "weighted_closeness": ("weighted_closeness", 24), "frequency": ("frequency", 24),
}
LISTS = ("strength", "degree", "closeness", "weighted_closeness", "frequency")


def summary() -> str:
    tops = " UNION ALL ".join(
        f"(SELECT '{n}' AS list, row_number() OVER (ORDER BY value DESC, name) AS rank, name, cast(NULL AS VARCHAR) AS other, "
        f"round(value, 6) AS value FROM (SELECT name, round(cast({c} AS DOUBLE), 9) AS value FROM metrics WHERE {c} IS NOT NULL) "
        f"ORDER BY rank LIMIT {k})"
        for n, (c, k) in COLUMNS.items()
    )
    return f"""WITH RECURSIVE {graph('names')}, {paths()}, {DEGREES},
    metrics AS (SELECT degrees.*, closeness, weighted_closeness FROM degrees LEFT JOIN close USING (name) LEFT JOIN wclose USING (name)),
    summary AS ({tops} UNION ALL (SELECT 'edges', row_number() OVER (ORDER BY weight DESC, src, dst) AS rank, src, dst,
        cast(weight AS DOUBLE) FROM edges ORDER BY rank LIMIT 180)),
    lookups AS (SELECT name, {', '.join(f"max(value) FILTER (list = '{n}') AS {n}" for n in LISTS)}
                FROM summary WHERE list <> 'edges' GROUP BY name)"""


LIVE = f"""WITH RECURSIVE v_parts AS ({VIEWS['v_parts']}),
    nodes AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, name) AS rank FROM ({NODES.format(v='v_parts', n=3)}) ORDER BY rank LIMIT 180),
    kept AS (SELECT * FROM v_parts WHERE name IN (SELECT name FROM nodes)),
    every AS ({PAIRS.format(v='kept')}),
    edges AS (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS rank FROM every ORDER BY rank LIMIT 900),
    {paths("component").replace("SELECT name FROM labels WHERE component = component", "SELECT name FROM nodes")}, {DEGREES}"""

SQL = {
    "node_frequency": f"WITH v_parts AS ({VIEWS['v_parts']}) {NODES.format(v='v_parts', n=30)}",
    "cooccurrence": f"WITH v_parts AS ({VIEWS['v_parts']}) {PAIRS.format(v='v_parts')}",
    "edge_weights": f"WITH v_parts AS ({VIEWS['v_parts']}), nodes AS ({NODES.format(v='v_parts', n=30)}), "
                    f"kept AS (SELECT * FROM v_parts WHERE name IN (SELECT name FROM nodes)) {PAIRS.format(v='kept')}",
    "degree_strength": f"WITH RECURSIVE {graph('names')}, {COMPONENTS}, {DEGREES} "
                       "SELECT * REPLACE (round(degree_centrality, 6) AS degree_centrality) FROM degrees",
    "graph_scalars": f"""WITH {graph('parts')}, c AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)
        SELECT n AS node_count, m AS edge_count, round(2 * m / (n * (n - 1)), 6) AS density, round(2 * m / n, 6) AS average_degree FROM c""",
    "connected_components": f"WITH RECURSIVE {graph('parts')}, {COMPONENTS} SELECT component, size FROM sizes",
    "component_summary": f"WITH RECURSIVE {graph('parts')}, {COMPONENTS} SELECT count(*) AS component_count, max(size) AS giant_size, "
                         "round(max(size) / sum(size), 6) AS giant_share FROM sizes",
    "path_metrics": f"WITH RECURSIVE {graph('names')}, {paths()} SELECT * REPLACE (round(closeness, 6) AS closeness) FROM close",
    "path_scalars": f"WITH RECURSIVE {graph('names')}, {paths()} SELECT round(avg(d), 6) AS average_shortest_path, max(d) AS diameter "
                    "FROM hops WHERE s < n",
    "weighted_closeness": f"WITH RECURSIVE {graph('names')}, {paths()} SELECT name, round(weighted_closeness, 6) AS weighted_closeness FROM wclose",
    "ranked_summaries": summary() + " SELECT * FROM summary",
    "graph_preview_summary": summary() + f""" SELECT rank, s.name, {', '.join(f'coalesce({n}, 0) AS {n}' for n in LISTS)}
        FROM summary s LEFT JOIN lookups USING (name) WHERE list = 'frequency' AND rank <= 100""",
    "graph_preview_summary_links": summary() + """, chosen AS (SELECT name FROM summary WHERE list = 'frequency' AND rank <= 100)
        SELECT src, dst, weight, row_number() OVER (ORDER BY weight DESC, src, dst) AS rank FROM edges
        WHERE weight >= 5 AND src IN (FROM chosen) AND dst IN (FROM chosen) ORDER BY rank LIMIT 420""",
    "graph_preview_live": LIVE + """ SELECT d.name, d.frequency, degree, strength, round(degree_centrality, 6) AS degree_centrality, rank,
        round(coalesce(closeness, 0), 6) AS closeness, round(coalesce(closeness, 0), 6) AS weighted_closeness
        FROM degrees d JOIN nodes n ON n.name = d.name LEFT JOIN close c ON c.name = d.name""",
    "graph_preview_live_links": LIVE + " SELECT src, dst, weight, rank FROM edges",
    "graph_preview_live_counts": LIVE + " SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM every) AS edge_count",
    "network_from_summary": summary() + f""",
        seen AS (SELECT name, list_position({list(LISTS)}, list) AS list_no, rank * 2 AS pos FROM summary WHERE list <> 'edges'
                 UNION ALL SELECT name, 6, rank * 2 FROM summary WHERE list = 'edges'
                 UNION ALL SELECT other, 6, rank * 2 + 1 FROM summary WHERE list = 'edges'),
        firsts AS (SELECT name, row_number() OVER (ORDER BY min(list_no * 100000 + pos)) AS rank FROM seen GROUP BY name),
        listed AS (SELECT name, sum(value) AS total FROM (SELECT name, value FROM summary WHERE list = 'edges'
                   UNION ALL SELECT other, value FROM summary WHERE list = 'edges') GROUP BY name)
        SELECT rank, f.name, coalesce(frequency, 0) AS frequency, coalesce(degree, 0) AS degree_centrality,
               coalesce(strength, total, 0) AS weighted_degree, coalesce(closeness, 0) AS closeness_centrality,
               coalesce(weighted_closeness, 0) AS weighted_closeness
        FROM firsts f LEFT JOIN lookups l ON l.name = f.name LEFT JOIN listed t ON t.name = f.name""",
    "network_summary_sink": summary() + f"""
        SELECT (SELECT count(*) FROM orders) AS recipe_count, 3 AS min_occurrence, n AS node_count, m AS edge_count,
               (SELECT count(*) FROM sizes) AS component_count, (SELECT max(size) FROM sizes) AS giant_size,
               (SELECT max(d) FROM hops) AS diameter, round(2 * m / (n * (n - 1)), 6) AS density, round(2 * m / n, 6) AS average_degree,
               round((SELECT max(size) / sum(size) FROM sizes), 6) AS giant_share,
               round((SELECT avg(d) FROM hops), 6) AS average_shortest_path,
               {', '.join(f"(SELECT string_agg(concat_ws('+', name, other), '|' ORDER BY rank) FROM summary WHERE list = '{n}') AS top_{n}" for n in (*LISTS, 'edges'))}
        FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)""",
}
