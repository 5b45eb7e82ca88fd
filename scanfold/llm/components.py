"""Connected components of a distributed edge table by alternating large-star and small-star steps.

Each step is one aggregation and one join on the edge table, so a node with very many edges is combined before its
shuffle and its join may be split by Spark. No edge or label passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import durable


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v."""
    if large:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = e
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u")
    if large:
        # neighbours above u move to the least of u's closed neighbourhood
        out = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        return out.where("u <> v").distinct()
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge to another node; component is the least node that it reaches.

    Null ends and loops are ignored; repeated edges count once; an empty table gives an empty result. Raises if
    ``max_rounds`` rounds, each of which at least halves the long paths, do not converge.
    """
    e = durable.write(
        edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        nxt = durable.write(_star(_star(e, True), False), "edges")
        durable.delete(e)
        e = nxt
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        # a forest of stars: every u has one edge, and no u is the end of another's
        if state[0] == state[2] and (state == before or e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()):
            roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
        before = state
    raise RuntimeError("connected components did not converge")
