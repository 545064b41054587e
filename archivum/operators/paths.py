"""Shortest paths, comparison and top nodes of weighted graphs given as edge tables (a, b, weight), both directions present."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivum.operators.durable import discard, materialize


def _expand(edges: DataFrame, frontier: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """The nodes next to a frontier that no earlier level has.

    In an undirected graph a neighbour of a level lies in the level before it, in itself or in the next one.
    """
    out = edges.join(frontier.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
    for level in seen[-2:]:
        out = out.join(level, "node", "left_anti")
    return materialize(out, "frontier")


def shortest_path(edges: DataFrame, source: str, target: str, longest: int = 64) -> DataFrame:
    """step, node of the shortest path between two nodes; of several, that of the smallest nodes, step by step from ``source``.

    Searched breadth-first from both ends: the smaller frontier is expanded, so the levels stay small where the graph fans
    out.  Once they meet, the nodes that lie on shortest paths are swept back level by level through both halves, and one
    is taken of each level.  No node limit; no rows if there is no path of at most ``longest`` edges, or an end is unknown.
    ``edges`` must hold both directions; weights and loops don't matter.  The driver holds the path alone.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    edges = edges.select("a", "b").where("a != b")
    start = [materialize(edges.where(F.col("a") == x).select(F.col("a").alias("node")).distinct(), "frontier") for x in (source, target)]
    nothing = spark.createDataFrame([], f"step int, node {kind}")
    if any(s.isEmpty() for s in start):
        return nothing
    if source == target:
        return start[0].select(F.lit(0).alias("step"), "node")
    levels, sizes = [[start[0]], [start[1]]], [1, 1]
    while sum(len(x) - 1 for x in levels) < longest:
        side = 0 if sizes[0] <= sizes[1] else 1
        new = _expand(edges, levels[side][-1], levels[side])
        levels[side].append(new)
        sizes[side] = new.count()
        if not sizes[side]:
            return nothing
        # an end's levels up to here hold all nodes so near to it, so the first meeting is a shortest path's
        if not new.join(levels[1 - side][-1], "node", "left_semi").isEmpty():
            break
    else:
        return nothing
    meeting = levels[0][-1].join(levels[1][-1], "node", "left_semi")
    # nodes on shortest paths, one table for each step from the source
    ahead = [materialize(meeting, "on-path")]
    for level in reversed(levels[0][:-1]):
        near = edges.join(ahead[0].withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")).distinct()
        ahead.insert(0, materialize(level.join(near, "node", "left_semi"), "on-path"))
    for level in reversed(levels[1][:-1]):
        near = edges.join(ahead[-1].withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        ahead.append(materialize(level.join(near, "node", "left_semi"), "on-path"))
    path = [source]
    for level in ahead[1:]:
        near = edges.where(F.col("a") == path[-1]).select(F.col("b").alias("node")).join(level, "node", "left_semi")
        path.append(near.agg(F.min("node")).first()[0])
    discard(*levels[0], *levels[1], *ahead)
    return spark.createDataFrame(list(enumerate(path)), f"step int, node {kind}")


def _sides(old: DataFrame, new: DataFrame, *keys) -> DataFrame:
    """The rows of two edge tables, their weights in columns of their own."""
    nothing = F.lit(None)
    return old.select(*keys, F.col("weight").alias("old"), nothing.alias("new")).unionByName(new.select(*keys, nothing.alias("old"), F.col("weight").alias("new")))


def _added(sides: DataFrame, *keys: str) -> DataFrame:
    """Sums of ``old`` and ``new`` by ``keys``; a key with a null is nothing that two graphs share."""
    unknown = F.array_contains(F.array(*(F.col(k).isNull() for k in keys)), True)
    return sides.groupBy(*keys, F.when(unknown, F.col("old").isNull()).alias("_side")).agg(F.sum("old").alias("old"), F.sum("new").alias("new")).drop("_side")


def compare_weights(sides: DataFrame, change: float = 2.0) -> DataFrame:
    """As ``compare_graphs``, of one table (a, b, old, new): the weight is null where a row belongs to the other graph."""
    found = _added(sides, "a", "b").select("a", "b", F.col("old").alias("old_weight"), F.col("new").alias("new_weight"))
    delta = F.col("new_weight") - F.col("old_weight")
    status = F.when(F.col("old_weight").isNull(), "new").when(F.col("new_weight").isNull(), "lost").when(delta > change, "stronger").when(delta < -change, "weaker")
    return found.where("old_weight is not null or new_weight is not null").withColumn("status", status).where(F.col("status").isNotNull())


def compare_graphs(old: DataFrame, new: DataFrame, change: float = 2.0) -> DataFrame:
    """Edges by what became of them: a, b, old_weight, new_weight, status (new, lost, stronger, weaker).

    One aggregation over both graphs, nothing is sorted or joined; an edge of both is reported if its weight differs by more
    than ``change``.  Repeated edges of one graph are added up.
    """
    return compare_weights(_sides(old, new, "a", "b"), change)


def compare_node_weights(sides: DataFrame) -> DataFrame:
    """As ``compare_nodes``, of one table (node, old, new): the weight is null where a row belongs to the other graph."""
    found = _added(sides, "node").where("old is null or new is null").where("old is not null or new is not null")
    return found.select("node", F.coalesce("new", "old").alias("strength"), F.when(F.col("old").isNull(), "new").otherwise("lost").alias("status"))


def compare_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of one graph only: node, strength (sum of its edges' weights), status (new, lost)."""
    return compare_node_weights(_sides(old, new, F.col("a").alias("node")))


def top_nodes(edges: DataFrame, kind, top: int = 10) -> DataFrame:
    """kind, rank, node, strength: the strongest nodes of each kind (``kind`` is a column over ``node``), equal ones by name."""
    nodes = edges.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("strength")).withColumn("kind", kind)
    order = Window.partitionBy("kind").orderBy(F.desc("strength"), "node")
    return nodes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("kind", "rank", "node", "strength")


def statistics(edges: DataFrame, kind) -> DataFrame:
    """One row: nodes, edges (each direction counts), total weight, density and mean degree; ``kind`` counts nodes by kind."""
    nodes = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weight")).withColumn("kind", kind)
    every = nodes.groupBy("kind").agg(F.count("*").alias("nodes"), F.sum("degree").alias("edges"), F.sum("weight").alias("weight"), F.max("degree").alias("widest"))
    return every.withColumn("mean_degree", F.round(F.col("edges") / F.col("nodes"), 6))
