"""Connected components by contraction: every node hooks onto its least neighbour, hooks are followed to their roots, and edges are rewritten
between roots until none is left.

Following doubles the distance each time, so a chain of n hooks takes log2(n) joins. The first two rounds order nodes by their ids, which
finishes stars and rising chains at once; later rounds order them by a hash that changes each round. Any node then has a lesser neighbour with
a chance of one half at least, so nodes with edges halve from round to round, whatever the ids are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import discard, stored

#: Rounds that order nodes by their ids.
BY_ID = 2


def _roots(hooks: DataFrame) -> DataFrame:
    """node and the end of its chain of hooks(node, to); an end hooks onto itself."""
    while True:
        ahead = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
        longer = stored(hooks.join(ahead, "to").select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")), "roots")
        discard(hooks)
        hooks = longer.select("node", "to")
        hooks._stored_at = longer._stored_at
        if longer.filter("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of all nodes in edges(a, b); loops and repeated edges change nothing, and without edges there are no rows. Each
    table is written to the shared folder, none refers to more than the one before. A node with very many edges is only ever aggregated."""
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels, turn = None, 0
    while not edges.isEmpty():

        def order(node: str) -> Column:
            return F.struct(F.col(node) if turn < BY_ID else F.xxhash64(F.col(node), F.lit(turn)), F.col(node).alias("id"))

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        hooks = least.select(F.col("a").alias("node"), F.when(F.col("near") < order("a"), F.col("near.id")).otherwise(F.col("a")).alias("to"))
        roots = _roots(stored(hooks, "hooks"))
        if labels is None:
            moved = roots.toDF("node", "component")
        else:
            moved = labels.join(roots.select(F.col("node").alias("component"), "to"), "component", "left")
            moved = stored(moved.select("node", F.coalesce("to", "component").alias("component")), "labels")
        x, y = roots.toDF("a", "x"), roots.toDF("b", "y")
        left = edges.join(x, "a").join(y, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = stored(left.distinct(), "edges")
        discard(labels, edges)
        if labels is None:
            moved._stored_at = roots._stored_at  # the first labels are the first roots
        else:
            discard(roots)
        labels, edges, turn = moved, left, turn + 1
    if turn > BY_ID:  # roots chosen by hash needn't be the smallest
        smallest = labels.groupBy("component").agg(F.min("node").alias("smallest"))
        labels = stored(labels.join(smallest, "component").select("node", F.col("smallest").alias("component")), "labels")
    discard(edges)
    return labels if labels is not None else edges.toDF("node", "component").limit(0)
