"""Trees, directed graphs and networks as rounds of equi joins; every round is cut from its lineage in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import durable


def tree_levels(nodes: DataFrame, node: str, parent: str, rounds: int = 200) -> DataFrame:
    """(node, root, depth) of every node of a forest, by levels: each round joins the nodes of the last level with their children.

    A node on a cycle hangs on no root and is left out; an error is raised if levels still grow after `rounds`.
    """
    level = durable(nodes.where(F.col(parent).isNull()).select(F.col(node), F.col(node).alias("root"), F.lit(0).alias("depth")))
    children = nodes.where(F.col(parent).isNotNull()).select(F.col(node), F.col(parent).alias("_up"))
    found = level
    for k in range(1, rounds):
        up = level.select(F.col(node).alias("_up"), "root")
        level = durable(children.join(up, "_up").select(node, "root", F.lit(k).alias("depth")))
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise RuntimeError(f"levels still grew after {rounds} rounds")


def dag_levels(nodes: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, level, leaf) of a directed acyclic graph (src, dst): the longest way from a root. A cycle raises an error."""
    pairs = edges.select("src", "dst").distinct()
    best = durable(nodes.join(pairs.select(F.col("dst").alias("node")), "node", "left_anti").select("node", F.lit(0).alias("level")))
    level, n = best, nodes.count()
    for k in range(1, min(rounds, n + 1) + 1):
        level = durable(level.join(pairs, level["node"] == pairs["src"]).select(F.col("dst").alias("node"), F.lit(k).alias("level")).distinct())
        if level.isEmpty():
            leaf = pairs.select(F.col("src").alias("node"), F.lit(False).alias("leaf")).distinct()
            return best.groupBy("node").agg(F.max("level").alias("level")).join(leaf, "node", "left").select("node", "level", F.coalesce("leaf", F.lit(True)).alias("leaf"))
        best = best.unionByName(level)
    raise RuntimeError("the graph has a cycle, or more levels than rounds")


def reach(edges: DataFrame, starts: DataFrame, backward: bool = False, rounds: int = 1000) -> DataFrame:
    """(origin, node, hops) of all nodes that the origins (origin) reach over directed edges (src, dst), by fewest hops."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("_to"))
    found = front = durable(starts.select("origin", F.col("origin").alias("node"), F.lit(0).alias("hops")))
    for k in range(1, rounds):
        new = front.join(step, "node").select("origin", F.col("_to").alias("node"), F.lit(k).alias("hops")).distinct()
        front = durable(new.join(found.select("origin", "node"), ["origin", "node"], "left_anti"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    raise RuntimeError(f"nodes were still found after {rounds} rounds")


def simple_paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(path) of all paths of at most `depth` edges from the starts (node) that visit no node twice."""
    paths = starts.select(F.array("node").alias("path"))
    out = None
    for _ in range(depth):
        paths = paths.withColumn("src", F.element_at("path", -1)).join(edges.select("src", "dst").distinct(), "src").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        out = paths if out is None else out.unionByName(paths)
    return out


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) by rounds in which a node takes the least label of its neighbours and then that label's own label.

    The pointer jump makes the rounds grow with the logarithm of the diameter in practice. An error is raised if labels still change after `rounds`.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both = durable(both)
    label = durable(nodes.select("node", F.col("node").alias("component")).distinct())
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        least = label.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("new"))
        # the label a node had also takes over the new label
        taken = least.groupBy("component").agg(F.min("new").alias("top"))
        jumped = least.join(taken, "component").select("node", F.least("new", "top").alias("new"), "component")
        up = jumped.select(F.col("node").alias("new"), F.col("new").alias("above"))
        after = durable(jumped.join(up, "new", "left").select("node", "component", F.least("new", F.coalesce("above", "new")).alias("new")))
        if after.where("new <> component").isEmpty():
            return label
        label = after.select("node", F.col("new").alias("component"))
    raise RuntimeError(f"labels still changed after {rounds} rounds")


def cheapest_by(paths: DataFrame, key: str, cost: str = "cost", tie: str = "origin") -> DataFrame:
    """For each `key` the row of least cost, ties to the smaller `tie`."""
    return paths.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(cost, tie))).where("_n = 1").drop("_n")


def edge_cost(length: Column, road_class: Column, speeds: dict[str, float], factor: Column | None = None) -> Column:
    """Hours over an edge: length by the speed of its class, times a factor."""
    speed = F.coalesce(*[F.when(road_class == k, F.lit(v)) for k, v in speeds.items()], F.lit(50.0))
    return length / speed * (factor if factor is not None else F.lit(1.0))
