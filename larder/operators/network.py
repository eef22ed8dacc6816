"""Ingredient co-occurrence network: edges, degrees, components, paths, previews.

Nodes are ``(name, frequency)``, edges ``(src, dst, weight)`` with ``src < dst``. Iterative
jobs keep a narrow state, write it to the checkpoint folder every round and stop at a fixpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.ordering import ranked, top_ranked
from larder.session import cut_lineage, dealt, stored

# Lengths of the ranked lists.
TOP_NODES = 24
TOP_STRENGTH = 48
TOP_EDGES = 180
# The five lists, in the order in which a preview visits them.
RANKED_LISTS = ("strength", "degree", "closeness", "weighted_closeness", "frequency")
# Groups up to this many rows are paired inside one array; larger ones on a grid.
SMALL_GROUP = 256


def node_frequency(index: DataFrame, min_occurrence: int = 3) -> DataFrame:
    """Dishes per ingredient name; ``index`` holds distinct (recipe_id, name)."""
    counts = index.groupBy("name").agg(F.count("*").alias("frequency"))
    return counts.where(F.col("frequency") >= min_occurrence)


def _array_pairs(rows: DataFrame, group: str, item: str) -> DataFrame:
    names = rows.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("names"))
    later = F.transform(
        "names",
        lambda a, i: F.transform(
            F.slice(F.col("names"), i + 2, F.size("names")), lambda b: F.struct(a.alias("src"), b.alias("dst"))
        ),
    )
    return names.select(F.explode(F.flatten(later)).alias("p")).select("p.src", "p.dst")


def _grid_pairs(rows: DataFrame, sizes: DataFrame, group: str, item: str) -> DataFrame:
    """Pairs of large groups: items fall into blocks, and each pair of blocks is its own task key."""
    blocks = F.ceil(F.col("_rows") / SMALL_GROUP).cast("int")
    placed = (
        rows.select(group, item)
        .distinct()
        .join(sizes, group)
        .select(group, item, blocks.alias("_blocks"), F.pmod(F.xxhash64(item), blocks).cast("int").alias("_block"))
    )
    left = placed.select(
        group, F.col(item).alias("_a"), F.col("_block").alias("_row"),
        F.explode(F.sequence("_block", F.col("_blocks") - 1)).alias("_column"),
    )
    right = placed.select(
        group, F.col(item).alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_row"),
        F.col("_block").alias("_column"),
    )
    return (
        left.join(right, [group, "_row", "_column"])
        .where((F.col("_row") < F.col("_column")) | (F.col("_a") < F.col("_b")))
        .select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"))
    )


def cooccurrence(pairs: DataFrame, group: str = "recipe_id", item: str = "name") -> DataFrame:
    """How many groups hold each pair of distinct items.

    Small groups become one array and pair up without a join. A group with more rows than
    ``SMALL_GROUP`` is spread over a grid of blocks, so no task holds it whole. The pair counts
    themselves are the result and combine before the shuffle. The two columns are written once
    and the input is read once; large groups are at most one in ``SMALL_GROUP`` rows.
    """
    rows = stored(pairs.select(group, item))
    sizes = cut_lineage(
        rows.groupBy(group).agg(F.count("*").alias("_rows")).where(F.col("_rows") > SMALL_GROUP)
    )
    small = _array_pairs(rows.join(sizes, group, "left_anti"), group, item)
    large = _grid_pairs(rows.join(sizes.select(group), group, "left_semi"), sizes, group, item)
    return small.union(large).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def edge_weights(index: DataFrame, min_occurrence: int = 3) -> DataFrame:
    """Co-occurrence among the kept nodes; the nodes are cut before pairs arise."""
    kept = node_frequency(index, min_occurrence).select("name")
    return cooccurrence(index.join(kept, "name", "left_semi"))


def both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
        F.struct(F.col("dst").alias("a"), F.col("src").alias("b")),
    )
    return edges.select(F.explode(ends).alias("e"), "weight").select("e.a", "e.b", "weight")


def degree_strength(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = both_ways(edges).groupBy(F.col("a").alias("name")).agg(
        F.count("*").alias("degree"), F.sum("weight").alias("strength")
    )
    others = max(nodes.count() - 1, 0)
    zero = F.lit(0).cast("bigint")
    return nodes.join(ends, "name", "left").select(
        "name",
        "frequency",
        F.coalesce("degree", zero).alias("degree"),
        F.coalesce("strength", zero).alias("strength"),
        (F.coalesce("degree", zero) / others if others else F.lit(0.0)).alias("degree_centrality"),
    )


def graph_scalars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    counts = nodes.agg(F.count("*").alias("n"), zero.alias("m")).union(
        edges.agg(zero.alias("n"), F.count("*").alias("m"))
    )
    n, m = F.col("node_count"), F.col("edge_count")
    return counts.agg(F.sum("n").alias("node_count"), F.sum("m").alias("edge_count")).select(
        n,
        m,
        F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0).alias("density"),
        F.when(n > 0, 2 * m / n).otherwise(0.0).alias("average_degree"),
    )


def _roots(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(name, component)``: each name hangs on its least neighbour below it, and its component is the top of that tree.

    Trees become flat by pointer jumping. Only tops that hang on others themselves are joined; they are soon few.
    """
    hooks = pairs.groupBy(F.col("high").alias("name")).agg(F.min("low").alias("least"))
    hooks = hooks.join(names.select(F.col("name").alias("least")), "least", "left_semi")
    roots = stored(names.join(hooks, "name", "left").select("name", F.coalesce("least", "name").alias("component")))
    while True:
        in_use = roots.select(F.col("component").alias("name")).distinct()
        moving = roots.where(F.col("name") != F.col("component")).join(in_use, "name", "left_semi").select(
            F.col("name").alias("component"), F.col("component").alias("next")
        )
        moving = stored(moving)
        if moving.isEmpty():
            return roots
        roots = stored(
            roots.join(moving, "component", "left").select("name", F.coalesce("next", "component").alias("component"))
        )


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(name, component)``, the component being its least name.

    All edges are read twice and no more: once for the least neighbour of each node, and once to see which of the trees so
    made they join. Rounds go over the edges between trees, which are few where nodes have many neighbours.
    """
    apart = edges.where(F.col("src") != F.col("dst"))
    pairs = stored(apart.select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")))
    names = stored(nodes.select("name").where(F.col("name").isNotNull()).distinct())
    roots = _roots(names, pairs)
    low, high = (roots.select(F.col("name").alias(c), F.col("component").alias(to)) for c, to in (("low", "_a"), ("high", "_b")))
    between = stored(
        pairs.join(low, "low").join(high, "high").where(F.col("_a") != F.col("_b"))
        .select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst")).distinct()
    )
    ends = F.explode(F.array("src", "dst")).alias("name")
    tops = _least_labels(between.select(ends).distinct(), between.withColumn("weight", F.lit(1)))
    tops = tops.select(F.col("name").alias("component"), F.col("component").alias("top"))
    return roots.join(tops, "component", "left").select("name", F.coalesce("top", "component").alias("component"))


def _least_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(name, component)``, the component being its least name, by rounds over all edges.

    Each round takes the least label around every node, then follows labels one step, which
    shortens long chains. Both joins have a unique side, so a hub only skews the edge side. The
    step joins the distinct labels only: once most nodes share one, that side is small and the
    planner broadcasts it by its size. Edges are dealt and sorted by one end when they are written, so no round
    shuffles or sorts them again; a node's edges are at most as many as the nodes.
    """
    ends = cut_lineage(dealt(both_ways(edges).select("a", "b"), "b").sortWithinPartitions("b"))
    labels = cut_lineage(nodes.select("name", F.col("name").alias("component")))
    while True:
        around = (
            ends.join(labels, ends.b == labels.name)
            .groupBy(F.col("a").alias("name"))
            .agg(F.min("component").alias("least"))
        )
        hooked = labels.join(around, "name", "left").select(
            "name", F.col("component").alias("was"), F.least("component", "least").alias("component")
        )
        hooked = cut_lineage(hooked)
        in_use = hooked.select(F.col("component").alias("name")).distinct()
        target = hooked.join(in_use, "name", "left_semi").select(
            F.col("name").alias("component"), F.col("component").alias("next")
        )
        jumped = cut_lineage(
            hooked.join(target, "component").select("name", "was", F.col("next").alias("component"))
        )
        labels = jumped.select("name", "component")
        if jumped.where(F.col("was") != F.col("component")).isEmpty():
            return labels


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components with their sizes; isolated nodes are components of one."""
    return component_labels(nodes, edges).groupBy("component").agg(F.count("*").alias("size"))


def component_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return connected_components(nodes, edges).agg(
        F.count("*").alias("component_count"),
        F.max("size").alias("giant_size"),
        (F.max("size") / F.sum("size")).alias("giant_share"),
    )


def giant_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Names of the largest component; among equals the one with the least name."""
    labels = component_labels(nodes, edges)
    largest = (
        labels.groupBy("component").agg(F.count("*").alias("size"))
        .orderBy(F.desc("size"), F.asc("component")).limit(1)
    )
    return labels.join(F.broadcast(largest.select("component")), "component", "left_semi").select("name")


def _start(edges: DataFrame, sources: DataFrame | None, distance) -> DataFrame:
    every = both_ways(edges).select(F.col("a").alias("name")).distinct() if sources is None else sources
    return every.select(F.col("name").alias("source"), F.col("name").alias("node"), distance.alias("distance"))


SOURCES_PER_ROW = 64


def numbered_sources(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(source, block, bit)``: 64 sources share a block, each has a bit of its own. All ends of edges by default."""
    every = both_ways(edges).select(F.col("a").alias("name")) if sources is None else sources.select("name")
    placed = ranked(every.distinct(), [F.asc("name")])
    number = F.col("rank") - 1
    return cut_lineage(
        placed.select(
            F.col("name").alias("source"), F.floor(number / SOURCES_PER_ROW).alias("block"),
            (number % SOURCES_PER_ROW).cast("int").alias("bit"),
        )
    )


def hop_rounds(edges: DataFrame, numbered: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """Breadth-first search from 64 sources at once: for each distance the rows ``(block, node, bits)`` of the
    sources that reach a node there first.

    A round sends a node's bits to its neighbours and joins them with an or, so state and messages hold a
    row for each block and node instead of one for each source and node.
    """
    ends = cut_lineage(both_ways(edges).select("a", "b"))
    own = F.expr("shiftleft(1L, bit)")
    fresh = cut_lineage(numbered.select("block", F.col("source").alias("node"), own.alias("bits")))
    seen, distance = fresh, 0
    while True:
        yield distance, fresh
        sent = fresh.join(ends, fresh.node == ends.a).groupBy("block", F.col("b").alias("node"))
        offers = sent.agg(F.bit_or("bits").alias("offer"))
        merged = cut_lineage(
            seen.join(offers, ["block", "node"], "full").select(
                "block", "node",
                F.coalesce("bits", F.lit(0)).bitwiseOR(F.coalesce("offer", F.lit(0))).alias("bits"),
                F.coalesce("offer", F.lit(0)).bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0)))).alias("new"),
            )
        )
        fresh = merged.where("new <> 0").select("block", "node", F.col("new").alias("bits"))
        seen, distance = merged.select("block", "node", "bits"), distance + 1
        if fresh.isEmpty():
            return


def hop_distances(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Breadth-first distances ``(source, node, distance)``.

    The result has |sources| x |nodes| rows; name the sources on large graphs.
    """
    numbered = numbered_sources(edges, sources)
    rounds = [fresh.select("block", "node", "bits", F.lit(d).alias("distance")) for d, fresh in hop_rounds(edges, numbered)]
    every = reduce(DataFrame.union, rounds).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(SOURCES_PER_ROW - 1))).alias("bit")
    )
    held = every.where(F.expr("shiftrightunsigned(bits, bit) & 1 = 1"))
    return held.join(numbered, ["block", "bit"]).select("source", "node", "distance")


def path_metrics(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Per source: nodes reached, total and largest distance, closeness.

    Distances are never listed: a round counts the nodes of each bit, in a row for each block.
    """
    numbered = numbered_sources(edges, sources)
    per_bit = [F.sum(F.expr(f"shiftrightunsigned(bits, {i}) & 1")).alias(f"n{i}") for i in range(SOURCES_PER_ROW)]
    counts = [
        fresh.groupBy("block").agg(*per_bit).select(
            "block", F.lit(d).alias("distance"), F.posexplode(F.array(*[f"n{i}" for i in range(SOURCES_PER_ROW)])).alias("bit", "n")
        )
        for d, fresh in hop_rounds(edges, numbered)
        if d > 0
    ]
    if not counts:
        schema = "name string, reachable bigint, total_distance bigint, eccentricity int, closeness double"
        return edges.sparkSession.createDataFrame([], schema).withColumn("name", F.col("name").cast(numbered.schema["source"].dataType))
    away = reduce(DataFrame.union, counts).where("n > 0").join(numbered, ["block", "bit"])
    return away.groupBy(F.col("source").alias("name")).agg(
        F.sum("n").alias("reachable"),
        F.sum(F.col("n") * F.col("distance")).alias("total_distance"),
        F.max("distance").alias("eccentricity"),
        (F.sum("n") / F.sum(F.col("n") * F.col("distance"))).alias("closeness"),
    )


def path_scalars(metrics: DataFrame) -> DataFrame:
    """Mean shortest path over unordered pairs and the diameter, from all sources' metrics."""
    return metrics.agg(
        (F.sum("total_distance") / F.sum("reachable")).alias("average_shortest_path"),
        F.max("eccentricity").alias("diameter"),
    )


def weighted_distances(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Shortest distances where an edge is ``1 / max(weight, 1)`` long.

    Only nodes that came closer in the last round are relaxed again.
    """
    ends = cut_lineage(
        both_ways(edges).select("a", "b", (1.0 / F.greatest("weight", F.lit(1))).alias("length"))
    )
    best = cut_lineage(_start(edges, sources, F.lit(0.0)))
    active = best
    while True:
        step = (
            active.join(ends, active.node == ends.a)
            .groupBy("source", F.col("b").alias("node"))
            .agg(F.min(F.col("distance") + F.col("length")).alias("offer"))
        )
        merged = cut_lineage(
            best.join(step, ["source", "node"], "full").select(
                "source",
                "node",
                F.least("distance", "offer").alias("distance"),
                F.coalesce(F.col("offer") < F.col("distance"), F.col("distance").isNull()).alias("closer"),
            )
        )
        best = merged.select("source", "node", "distance")
        active = merged.where("closer").select("source", "node", "distance")
        if active.isEmpty():
            return best


def weighted_closeness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    away = weighted_distances(edges, sources).where(F.col("source") != F.col("node"))
    total = F.sum("distance")
    return away.groupBy(F.col("source").alias("name")).agg(
        F.when(total > 0, F.count("*") / total).otherwise(0.0).alias("weighted_closeness")
    )


def within(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends among the names."""
    left = names.select(F.col("name").alias("src"))
    right = names.select(F.col("name").alias("dst"))
    return edges.join(left, "src", "left_semi").join(right, "dst", "left_semi").select("src", "dst", "weight")


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree, strength and both closeness values; closeness only inside the giant component."""
    edges = cut_lineage(edges)
    nodes = cut_lineage(nodes)
    giant = giant_component(nodes, edges)
    inner = within(edges, giant)
    return (
        degree_strength(nodes, edges)
        .join(path_metrics(inner).select("name", "closeness"), "name", "left")
        .join(weighted_closeness(inner), "name", "left")
    )


def ranked_summaries(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """The ranked lists in one table ``(list, rank, name, other, value)``; ties go by name."""
    columns = {
        "degree": ("degree_centrality", TOP_NODES),
        "strength": ("strength", TOP_STRENGTH),
        "closeness": ("closeness", TOP_NODES),
        "weighted_closeness": ("weighted_closeness", TOP_NODES),
        "frequency": ("frequency", TOP_NODES),
    }
    nobody = F.lit(None).cast("string").alias("other")
    lists = []
    for name, (column, n) in columns.items():
        # Sums over different orders may differ in the last bits, so ties are cut at nine digits.
        value = F.round(F.col(column).cast("double"), 9)
        rows = metrics.where(F.col(column).isNotNull()).select("name", value.alias("value"))
        lists.append(
            top_ranked(rows, [F.desc("value"), F.asc("name")], n).select(
                F.lit(name).alias("list"), "rank", "name", nobody, "value"
            )
        )
    top = top_ranked(edges, [F.desc("weight"), F.asc("src"), F.asc("dst")], TOP_EDGES)
    result = top.select(
        F.lit("edges").alias("list"), "rank", F.col("src").alias("name"), F.col("dst").alias("other"),
        F.col("weight").cast("double").alias("value"),
    )
    for rows in lists:
        result = result.union(rows)
    return result


def _lookups(summary: DataFrame) -> DataFrame:
    """One row per listed name with its value in each list."""
    return summary.where(F.col("list") != "edges").groupBy("name").agg(
        *[F.max(F.when(F.col("list") == name, F.col("value"))).alias(name) for name in RANKED_LISTS]
    )


def graph_preview_summary(
    summary: DataFrame, edges: DataFrame, max_nodes: int = 100, max_edges: int = 420, min_weight: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Preview nodes and links of a summary. Values come from the ranked lists only, else zero."""
    chosen = summary.where((F.col("list") == "frequency") & (F.col("rank") <= max_nodes)).select("name", "rank")
    zero = F.lit(0.0)
    nodes = chosen.join(_lookups(summary), "name", "left").select(
        "rank", "name", *[F.coalesce(name, zero).alias(name) for name in RANKED_LISTS]
    )
    inside = within(edges.where(F.col("weight") >= min_weight), chosen)
    return nodes, top_ranked(inside, [F.desc("weight"), F.asc("src"), F.asc("dst")], max_edges)


def graph_preview_live(
    index: DataFrame, min_occurrence: int = 3, max_nodes: int = 180, max_edges: int = 900
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, links and counts of the live preview.

    Degree, strength and closeness come from the links that are shown; ``edge_count`` counts
    all edges among the chosen nodes. Weighted closeness repeats closeness.
    """
    counted = node_frequency(index, min_occurrence)
    nodes = cut_lineage(top_ranked(counted, [F.desc("frequency"), F.asc("name")], max_nodes))
    every = cut_lineage(cooccurrence(index.join(nodes.select("name"), "name", "left_semi")))
    links = cut_lineage(top_ranked(every, [F.desc("weight"), F.asc("src"), F.asc("dst")], max_edges))
    shown = links.select("src", "dst", "weight")
    close = path_metrics(shown, nodes.select("name")).select("name", "closeness")
    measured = (
        degree_strength(nodes.select("name", "frequency"), shown)
        .join(nodes.select("name", "rank"), "name")
        .join(close, "name", "left")
        .withColumn("closeness", F.coalesce("closeness", F.lit(0.0)))
        .withColumn("weighted_closeness", F.col("closeness"))
    )
    scalars = graph_scalars(nodes.select("name"), every).select("node_count", "edge_count")
    return measured, links, scalars


def network_from_summary(summary: DataFrame) -> DataFrame:
    """Nodes of a network rebuilt from the ranked lists alone.

    Nodes keep the order of their first appearance over the five lists, then the edges.
    Strength falls back to the sum of the listed edge values.
    """
    place = F.array_position(F.array(*[F.lit(n) for n in RANKED_LISTS]), F.col("list"))
    listed = summary.where(F.col("list") != "edges").select(
        F.trim("name").alias("name"), place.alias("list_no"), (F.col("rank") * 2).alias("at")
    )
    ends = summary.where(F.col("list") == "edges").select(
        F.explode(
            F.array(
                F.struct(F.trim("name").alias("name"), (F.col("rank") * 2).alias("at")),
                F.struct(F.trim("other").alias("name"), (F.col("rank") * 2 + 1).alias("at")),
            )
        ).alias("e"),
        "value",
    ).select("e.name", F.lit(len(RANKED_LISTS) + 1).cast("bigint").alias("list_no"), "e.at", "value")
    first = (
        listed.union(ends.select("name", "list_no", "at"))
        .where(F.col("name") != "")
        .groupBy("name")
        .agg(F.min(F.struct("list_no", "at")).alias("first"))
    )
    summed = ends.groupBy("name").agg(F.sum("value").alias("edge_strength"))
    zero = F.lit(0.0)
    nodes = first.join(_lookups(summary), "name", "left").join(summed, "name", "left")
    return ranked(nodes, [F.asc("first")]).select(
        "rank",
        "name",
        F.coalesce("frequency", zero).alias("frequency"),
        F.coalesce("degree", zero).alias("degree_centrality"),
        F.coalesce("strength", "edge_strength", zero).alias("weighted_degree"),
        F.coalesce("closeness", zero).alias("closeness_centrality"),
        F.coalesce("weighted_closeness", zero).alias("weighted_closeness"),
    )


def network_summary(
    nodes: DataFrame, edges: DataFrame, recipe_count: int, min_occurrence: int = 3
) -> DataFrame:
    """The whole summary as one row: scalars and the ranked lists as arrays."""
    edges, nodes = cut_lineage(edges), cut_lineage(nodes)
    giant = cut_lineage(giant_component(nodes, edges))
    inner = within(edges, giant)
    paths = cut_lineage(path_metrics(inner))
    metrics = cut_lineage(
        degree_strength(nodes, edges)
        .join(paths.select("name", "closeness"), "name", "left")
        .join(weighted_closeness(inner), "name", "left")
    )
    lists = ranked_summaries(metrics, edges)
    scalars = graph_scalars(nodes, edges).first()
    components = component_summary(nodes, edges).first()
    shortest = path_scalars(paths).first()
    ordered = F.array_sort(F.collect_list(F.struct("rank", "name", "other", "value")))
    arrays = lists.groupBy().pivot("list", [*RANKED_LISTS, "edges"]).agg(ordered)
    return arrays.select(
        F.lit(recipe_count).alias("recipe_count"),
        F.lit(min_occurrence).alias("min_occurrence"),
        *[F.lit(scalars[c]).alias(c) for c in scalars.asDict()],
        *[F.lit(components[c]).alias(c) for c in components.asDict()],
        *[F.lit(shortest[c]).alias(c) for c in shortest.asDict()],
        *[F.col(name).alias(f"top_{name}") for name in (*RANKED_LISTS, "edges")],
    )


def write_network_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)
