"""Queries on the ingredient network.

Counting and the live preview run on part numbers (a wide vocabulary), paths on names; every
edge between kept nodes counts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import network
from larder.session import cut_lineage
from larder.sources import views


def _name_graph(spark, d):
    index = views.ingredient_index(spark, d)
    nodes = network.node_frequency(index)
    return nodes, cut_lineage(network.edge_weights(index))


def _part_graph(spark, d):
    index = views.part_index(spark, d)
    return network.node_frequency(index), network.edge_weights(index)


def node_frequency(spark, d):
    return network.node_frequency(views.part_index(spark, d), 30)


def cooccurrence(spark, d):
    return network.cooccurrence(views.part_index(spark, d))


def edge_weights(spark, d):
    return network.edge_weights(views.part_index(spark, d), 30)


def degree_strength(spark, d):
    nodes, edges = _name_graph(spark, d)
    return network.degree_strength(nodes, edges).withColumn("degree_centrality", F.round("degree_centrality", 6))


def graph_scalars(spark, d):
    found = network.graph_scalars(*_part_graph(spark, d))
    return found.withColumns({c: F.round(c, 6) for c in ("density", "average_degree")})


def connected_components(spark, d):
    return network.connected_components(*_part_graph(spark, d))


def component_summary(spark, d):
    return network.component_summary(*_part_graph(spark, d)).withColumn("giant_share", F.round("giant_share", 6))


def _inner(spark, d):
    nodes, edges = _name_graph(spark, d)
    return network.within(edges, network.giant_component(nodes, edges))


def path_metrics(spark, d):
    return network.path_metrics(_inner(spark, d)).withColumn("closeness", F.round("closeness", 6))


def path_scalars(spark, d):
    return network.path_scalars(network.path_metrics(_inner(spark, d))).withColumn(
        "average_shortest_path", F.round("average_shortest_path", 6)
    )


def weighted_closeness(spark, d):
    return network.weighted_closeness(_inner(spark, d)).withColumn(
        "weighted_closeness", F.round("weighted_closeness", 6)
    )


def _summary(spark, d):
    nodes, edges = _name_graph(spark, d)
    lists = network.ranked_summaries(network.node_metrics(nodes, edges), edges)
    return cut_lineage(lists.withColumn("value", F.round("value", 6))), edges


def ranked_summaries(spark, d):
    return _summary(spark, d)[0]


def graph_preview_summary(spark, d):
    nodes, _links = network.graph_preview_summary(*_summary(spark, d))
    return nodes


def graph_preview_summary_links(spark, d):
    _nodes, links = network.graph_preview_summary(*_summary(spark, d))
    return links


def _live(spark, d):
    return network.graph_preview_live(views.part_index(spark, d))


def graph_preview_live(spark, d):
    return _live(spark, d)[0].withColumns(
        {c: F.round(c, 6) for c in ("degree_centrality", "closeness", "weighted_closeness")}
    )


def graph_preview_live_links(spark, d):
    return _live(spark, d)[1]


def graph_preview_live_counts(spark, d):
    return _live(spark, d)[2]


def network_from_summary(spark, d):
    return network.network_from_summary(_summary(spark, d)[0])


def network_summary_sink(spark, d):
    """The summary row; lists as text so that both sides compare the whole content."""
    nodes, edges = _name_graph(spark, d)
    row = network.network_summary(nodes, edges, views.dishes(spark, d).count())
    names = (*network.RANKED_LISTS, "edges")
    return row.select(
        "recipe_count", "min_occurrence", "node_count", "edge_count", "component_count", "giant_size", "diameter",
        *[F.round(c, 6).alias(c) for c in ("density", "average_degree", "giant_share", "average_shortest_path")],
        *[
            F.array_join(F.transform(f"top_{n}", lambda e: F.concat_ws("+", e["name"], e["other"])), "|").alias(f"top_{n}")
            for n in names
        ],
    )


QUERIES = {
    f.__name__: f
    for f in (
        node_frequency, cooccurrence, edge_weights, degree_strength, graph_scalars, connected_components,
        component_summary, path_metrics, path_scalars, weighted_closeness, ranked_summaries,
        graph_preview_summary, graph_preview_summary_links, graph_preview_live, graph_preview_live_links,
        graph_preview_live_counts, network_from_summary, network_summary_sink,
    )
}
