"""Connected components by contraction: nodes hook onto the least of their neighbours, labels jump along these hooks, and
the edges between different labels are the next round's graph. A round has a few aggregations and joins by node, which are
combined before they are shuffled; nothing depends on how large a component is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.stored import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge (a, b) to another: the least node it reaches.

    Nodes are of any type that has an order, structs too. Edges with a null end and loops are ignored. An error after
    ``rounds`` rounds, each of which at least halves the nodes of every component.
    """
    e = stored(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    of = None
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
        # two hooks at once
        over = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = stored(hook.join(over, "up", "left").select("node", F.coalesce("top", "up").alias("up")))
        if of is None:
            of = hook.select("node", F.col("up").alias("component"))
        else:
            of = stored(of.join(hook.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        ends = e.join(hook.select(F.col("node").alias("a"), F.col("up").alias("u")), "a").join(hook.select(F.col("node").alias("b"), F.col("up").alias("v")), "b")
        e = stored(ends.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct())
        if e.isEmpty():
            return of
    raise RuntimeError("components did not converge")
