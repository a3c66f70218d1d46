"""Roots and depths of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("targets"))


def _anchored(single: DataFrame) -> DataFrame:
    """(node, up, dist): the nearest node above with no parent or several, for nodes (node, up, dist) with one parent each.

    Every round doubles the steps that are behind a node, so a chain of n nodes takes about log2(n) rounds."""
    done, rest, rounds = None, saved(single, "up"), single.count().bit_length() + 1
    known = rest
    for _ in range(rounds):
        above = known.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("dist").alias("_dist"))
        # Nodes whose pointer has left the nodes with one parent need no further round.
        here = saved(rest.join(above, "up", "left").select("node", "up", "dist", "_up", "_dist"), "up")
        fixed = here.where("_up is null").select("node", "up", "dist")
        done = fixed if done is None else done.union(fixed)
        rest = here.where("_up is not null").select("node", F.col("_up").alias("up"), (F.col("dist") + F.col("_dist")).alias("dist"))
        if rest.isEmpty():
            return done
        known = saved(done.union(rest), "up")
    raise ValueError("the graph has a cycle")


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): the longest way from a root in an acyclic graph.

    Chains and trees of nodes with one parent are shortened by doubling.  What is left are roots and nodes with several
    parents, joined by ways of known length; their depths are raised until none changes, which takes as many
    rounds as such nodes follow one another on a way.  A cycle raises an error."""
    edges = saved(edges.select("src", "dst").distinct(), "edges")
    parents = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("up"))
    single = parents.where("n = 1").select(F.col("dst").alias("node"), "up", F.lit(1).cast("bigint").alias("dist"))
    anchored = saved(_anchored(single), "anchored")
    several = parents.where("n > 1").select(F.col("dst").alias("node"))
    top = roots(nodes, edges).select("node")
    into = edges.join(several.withColumnRenamed("node", "dst"), "dst", "left_semi")
    by_anchor = into.join(anchored.withColumnRenamed("node", "src"), "src", "left")
    ways = by_anchor.groupBy(F.coalesce("up", "src").alias("up"), F.col("dst").alias("node")).agg((F.max(F.coalesce("dist", F.lit(0))) + 1).alias("dist"))
    ways = saved(ways, "ways")
    found = top.select("node", F.lit(0).cast("bigint").alias("depth"))
    if not ways.isEmpty():
        base, state = saved(found, "depths"), None
        found = base
        for _ in range(ways.select("node").distinct().count() + 2):
            raised = ways.join(found.withColumnRenamed("node", "up"), "up").groupBy("node").agg(F.max(F.col("depth") + F.col("dist")).alias("depth"))
            found = saved(base.union(raised), "depths")
            now = found.agg(F.count("*"), F.sum("depth")).first()
            if now == state:
                break
            state = now
        else:
            raise ValueError("the graph has a cycle")
    below = anchored.join(found.withColumnRenamed("node", "up"), "up").select("node", (F.col("depth") + F.col("dist")).alias("depth"))
    return found.union(below)
