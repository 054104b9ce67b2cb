"""Graph operators as iterated joins; each round is written to the shared folder, and deleted when its iteration ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Rounds


def descendants(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth) below each root along (parent, child) edges, breadth first; a node counts once, at its least depth.

    Runs until nothing new is found, or down to `max_depth`. Filters belong on `edges`: an edge
    that is left out also cuts what lies below it."""
    rounds = Rounds(edges.sparkSession)
    edges = rounds.keep(edges.select(F.col("parent").alias("node"), "child").distinct())
    seen = frontier = rounds.keep(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct())
    depth = 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        step = frontier.join(edges, "node").select("root", F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        frontier = rounds.keep(step.join(seen, ["root", "node"], "left_anti"))
        seen = seen.unionByName(frontier)  # each round's own files
        seen = rounds.keep(seen) if depth % 16 == 0 else seen  # a plan of few branches, however deep the graph
    return rounds.result(seen.where("depth > 0"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected (a, b) edges: the smallest node reachable.

    Every node hooks to its smallest neighbour, chains of hooks are halved by pointer jumping
    until they are stars, and edges shrink to edges between stars. Each round at least halves
    the nodes that still have edges, whatever the shape. Minima are pre-aggregated and the
    joins may be split where a node has many edges."""
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    rounds = Rounds(edges.sparkSession)
    stable = rounds.keep
    left = stable(edges.where("a <> b").select(low, high).distinct())
    labels = None
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("near")))
        parent = stable(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("top")))
        while True:
            step = parent.join(parent.select(F.col("node").alias("top"), F.col("top").alias("above")), "top").select("node", "top", "above")
            step = stable(step)
            if step.where("top <> above").isEmpty():
                break
            parent = step.select("node", F.col("above").alias("top"))
        if labels is None:
            labels = parent.select("node", F.col("top").alias("component"))
        else:
            labels = stable(labels.join(parent.select(F.col("node").alias("component"), "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component")))
        by_a, by_b = (parent.select(F.col("node").alias(x), F.col("top").alias(f"top_{x}")) for x in ("a", "b"))
        moved = left.join(by_a, "a").join(by_b, "b").where("top_a <> top_b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b"))
        left = stable(moved.select(low, high).distinct())
    return rounds.result(labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component")))


def expand_scores(edges: DataFrame, seeds: DataFrame, decay: float = 0.9, hops: int = 3) -> DataFrame:
    """(node, score): each node's best score over walks of at most `hops` steps from (node, score) seeds, times `decay` a step."""
    rounds = Rounds(edges.sparkSession)
    best = rounds.keep(seeds.select("node", "score"))
    for _ in range(hops):
        reached = best.join(edges.select(F.col("parent").alias("node"), "child"), "node").select(F.col("child").alias("node"), (F.col("score") * F.lit(decay)).alias("score"))
        best = rounds.keep(best.unionByName(reached).groupBy("node").agg(F.max("score").alias("score")))
    return rounds.result(best)


def neighbourhood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose both ends are among the nodes and all they touch."""
    n = nodes.select("node").distinct()
    touched = edges.join(n.withColumnRenamed("node", "a"), "a", "left_semi").unionByName(edges.join(n.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b"))
    reach = touched.select(F.explode(F.array("a", "b")).alias("node")).unionByName(n).distinct()
    return edges.join(reach.withColumnRenamed("node", "a"), "a", "left_semi").join(reach.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
