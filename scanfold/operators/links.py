"""Co-occurrence links between two sets of nodes as edge tables (src, dst, strength)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_links(hits: DataFrame) -> DataFrame:
    """Number of rows of each (src, dst)."""
    return hits.groupBy("src", "dst").agg(F.count("*").alias("strength"))


def colocated(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Links between src of ``a`` and dst of ``b`` by the rows whose keys agree."""
    left = a.groupBy(*key, "src").agg(F.count("*").alias("n"))
    right = b.groupBy(*key, "dst").agg(F.count("*").alias("m"))
    return left.join(right, key).groupBy("src", "dst").agg(F.sum(F.col("n") * F.col("m")).alias("strength"))


def merge_links(tables: list[DataFrame], alive: DataFrame | None = None) -> DataFrame:
    """Links of all tables added up, without those to targets that are not in ``alive`` (dst)."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    if alive is not None:
        every = every.join(alive.select("dst").distinct(), "dst", "left_semi")
    return every.groupBy("src", "dst").agg(F.sum("strength").alias("strength"))


def best_link(links: DataFrame, score: str = "strength", last: bool = True) -> DataFrame:
    """The best target of each source; ties to the greatest target, or the least with ``last`` false."""
    if last:
        return links.groupBy("src").agg(F.max(F.struct(score, "dst")).alias("m")).select("src", F.col("m.dst").alias("dst"), F.col(f"m.{score}").alias(score))
    return links.groupBy("src").agg(F.min(F.struct((-F.col(score)).alias("neg"), "dst")).alias("m")).select("src", F.col("m.dst").alias("dst"), (-F.col("m.neg")).alias(score))


def full_match(before: DataFrame, after: DataFrame) -> DataFrame:
    """Links of two times side by side; those of one time only are kept."""
    return before.withColumnRenamed("strength", "before").join(after.withColumnRenamed("strength", "after"), ["src", "dst"], "full_outer")


def neighbours_of(links: DataFrame, node: Column) -> DataFrame:
    return links.where(F.col("src") == node).select("dst", "strength")


def to_graphml(links: DataFrame) -> DataFrame:
    """Lines (nr, line) of a bipartite GraphML document, in order of nr."""
    def part(nr: int, rows: DataFrame, line: Column, *order: str) -> DataFrame:
        return rows.select(F.lit(nr).alias("part"), F.concat_ws("|", *order).alias("key"), line.alias("line"))

    spark = links.sparkSession
    fixed = spark.createDataFrame([(0, "", '<graphml><graph edgedefault="directed">'), (4, "", "</graph></graphml>")], "part int, key string, line string")
    src = part(1, links.select("src").distinct(), F.format_string('<node id="s%s"/>', F.col("src").cast("string")), "src")
    dst = part(2, links.select("dst").distinct(), F.format_string('<node id="d%s"/>', F.col("dst").cast("string")), "dst")
    edges = part(3, links, F.format_string('<edge source="s%s" target="d%s"><data key="weight">%d</data></edge>', F.col("src").cast("string"), F.col("dst").cast("string"), F.col("strength")), "src", "dst")
    return fixed.unionAll(src).unionAll(dst).unionAll(edges)
