"""Nodes, edges and hyperedges: merging, views, components and walks (rows G, J06-J11, A15, A21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import discard, stash


def distinct_rows(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """The row with the least id of each key; nulls are equal."""
    return df.join(df.groupBy(*keys).agg(F.min(ident).alias(ident)).select(ident), ident, "left_semi")


def keepers(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Drop, keep for each group: most papers, then confidence, then the highest id stays."""
    order = Window.partitionBy(*group).orderBy(F.desc("support"), F.desc("confidence"), F.desc("node_id"))
    ranked = nodes.withColumn("keep", F.first("node_id").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return ranked.filter("node_id != keep").select(F.col("node_id").alias("drop"), "keep")


def edge_labels(edges: DataFrame, nodes: DataFrame, dangling: bool = False) -> DataFrame:
    """Edges with the names and types of both ends; ``dangling`` keeps edges whose ends are missing."""
    how = "left" if dangling else "inner"
    side = lambda p: nodes.select(F.col("node_id").alias(f"{p}_node"), F.col("node_type").alias(f"{p}_type"), F.col("name").alias(f"{p}_name"))
    return edges.join(side("source"), "source_node", how).join(side("target"), "target_node", how)


def ego(edges: DataFrame, nodes: DataFrame, node: Column | str) -> DataFrame:
    """The neighbours of a node with relation and direction; a loop is one outgoing edge."""
    out = edges.filter(F.col("source_node") == node).select(F.lit("out").alias("direction"), "relation_type", F.col("target_node").alias("node_id"), "confidence")
    inn = edges.filter((F.col("target_node") == node) & (F.col("source_node") != node)).select(F.lit("in").alias("direction"), "relation_type", F.col("source_node").alias("node_id"), "confidence")
    return out.unionByName(inn).join(nodes.select("node_id", "node_type", "name"), "node_id")


def induced(edges: DataFrame, chosen: DataFrame, both: bool = True) -> DataFrame:
    """Edges with both ends, or at least one, among the chosen nodes."""
    left = edges.join(chosen.select(F.col("node_id").alias("source_node")), "source_node", "left_semi")
    if both:
        return left.join(chosen.select(F.col("node_id").alias("target_node")), "target_node", "left_semi").select(edges.columns)
    right = edges.join(chosen.select(F.col("node_id").alias("target_node")), "target_node", "left_semi")
    return left.select(edges.columns).unionByName(right.select(edges.columns)).distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node's degree, 0 for isolated ones."""
    ends = edges.select(F.explode(F.array("source_node", "target_node")).alias("node_id"))
    return nodes.select("node_id").join(ends.groupBy("node_id").agg(F.count("*").alias("degree")), "node_id", "left").fillna(0, ["degree"])


def link_components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each node's component, for all nodes of ``links`` (a, b).

    Large-star and small-star steps alternate until every node points at the
    least of its component, so that rounds grow with the logarithm of the
    graph, not with its diameter; each step is a sum by node and a join with it.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    before, last = None, None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stash(small.filter("u != v").distinct(), "stars")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if last is not None:
            discard(last)
        if state == before:
            break
        before, last = state, edges
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, component: the least node id that each node reaches."""
    found = link_components(edges.select(F.col("source_node").alias("a"), F.col("target_node").alias("b")))
    return nodes.select("node_id").distinct().join(found, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("label", "node_id").alias("component"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node_id, depth: nodes within ``depth`` steps of the seeds, at their least depth."""
    frontier = seeds.select("node_id").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for d in range(1, depth + 1):
        ahead = edges.join(frontier.select(F.col("node_id").alias("source_node")), "source_node", "left_semi").select(F.col("target_node").alias("node_id")).distinct()
        frontier = stash(ahead.join(seen, "node_id", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def orphans(hyperedges: DataFrame, members: DataFrame) -> DataFrame:
    """Hyperedges without members."""
    return hyperedges.join(members.select("hyperedge_id"), "hyperedge_id", "left_anti")


def alias_components(names: DataFrame) -> DataFrame:
    """G02's alias linking: (node_type, node_id, name) joined into components of nodes of one type that share a name."""
    keyed = names.select("node_type", "node_id", T.name_key(F.col("name")).alias("_n")).filter("_n != ''").distinct()
    head = keyed.groupBy("node_type", "_n").agg(F.min("node_id").alias("target_node"))
    edges = keyed.join(head, ["node_type", "_n"]).select(F.col("node_id").alias("source_node"), "target_node")
    return components(names, edges)
