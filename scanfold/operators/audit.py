"""Statistics of correspondences, audits of frames and repairs of what they assign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfold.stored import stored

from . import learn

OUTLIERS_FROM = 0.9  # share of matches that are kept


def correspondence_stats(matches: DataFrame, by: list[str], reject: bool = True) -> DataFrame:
    """For each group of matches (dist, err, weight): n, mean distance and error and the deviation over weights above 0,
    the distance ``cut`` at nine tenths, and the weighted means and share of outliers when matches beyond it are dropped.

    With ``reject`` false, as in the first rounds of a registration, the cut is the greatest distance. Groups without
    any weight give no row.
    """
    used = matches.where("weight > 0")
    size = F.col("n")
    share = (F.floor(size * OUTLIERS_FROM) + 0.5) / size if reject else F.lit(1.0)
    cut = stored(learn.ranked(used, by, "dist", {"cut": share}).select(*by, F.col("dist").alias("cut")))
    m = matches.join(F.broadcast(cut) if cut.count() <= learn.MOST_BRACKETS else cut, by)
    kept = F.when(F.col("dist") > F.col("cut"), 0.0).otherwise(F.col("weight"))
    total, on = F.sum("weight"), F.col("weight") > 0
    # moments about 0 give the deviation in the same pass as the means
    sums = m.withColumn("kept", kept).groupBy(*by, "cut").agg(
        F.count("*").alias("n"), total.alias("w"), F.sum(F.when(on, F.col("dist"))).alias("d"), F.sum(F.when(on, F.col("err"))).alias("e"),
        F.sum(F.col("weight") * F.col("dist")).alias("wd"), F.sum(F.col("weight") * F.col("dist") * F.col("dist")).alias("wdd"),
        F.sum("kept").alias("k"), F.sum(F.col("kept") * F.col("dist")).alias("kd"), F.sum(F.col("kept") * F.col("err")).alias("ke"),
        F.count_if(F.col("kept") == 0).alias("out"),
    )
    mean = F.col("d") / F.col("w")
    spread = F.col("wdd") / F.col("w") - 2 * mean * F.col("wd") / F.col("w") + mean * mean
    return sums.select(
        *by, "n", "cut", mean.alias("mean_dist"), (F.col("e") / F.col("w")).alias("mean_err"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std_dist"),
        (F.col("kd") / F.col("k")).alias("kept_dist"), (F.col("ke") / F.col("k")).alias("kept_err"), (F.col("out") / F.col("n")).alias("outliers"),
    )


def threshold_weight(d: Column, most: float) -> Column:
    """Weight of a match: 1 up to a distance, beyond it in inverse proportion."""
    return F.when(d > most, F.lit(most) / d).otherwise(1.0)


def fill_from_neighbours(rows: DataFrame, value: str, image: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Rows (``image``, row, col, dist) with ``filled``: a return without a value takes the one that most of its four
    neighbours share. Two agreeing neighbours suffice if the other two differ; two against two decide nothing. A missing
    neighbour counts as a value of its own kind, and four, three or two agreeing on it leave the return without one."""
    near = []
    for axis, other in (("col", "row"), ("row", "col")):
        w = Window.partitionBy(*image, other).orderBy(axis)
        near += [F.when(f(axis).over(w) == F.col(axis) + s, f(value).over(w)) for f, s in ((F.lag, -1), (F.lead, 1))]
    # nulls go last, as the greatest of the four
    t = rows.withColumn("near", F.array_sort(F.array(*near)))
    a, b, c, d = (F.col("near").getItem(i) for i in range(4))
    two = F.when(a.eqNullSafe(b) & ~c.eqNullSafe(d), a).when(c.eqNullSafe(d) & ~a.eqNullSafe(b), c)
    mode = F.when(b.eqNullSafe(c), b).otherwise(two)
    return t.withColumn("filled", F.when(F.col(value).isNull() & F.col("dist").isNotNull(), mode).otherwise(F.col(value))).drop("near")


def seen_through(points: DataFrame, pixels: DataFrame, tolerance: float, grazing: float, sure: float) -> DataFrame:
    """Points without those that should have been seen: (id, px, py, dist, plane, conf, cos) whose pixel's return lies so
    far behind them that ``plane``, their distance from its surface, is over ``tolerance`` tenths of their distance, and
    whose surface is either uncertain (``conf`` below ``sure``) or met at more than ``grazing`` (``cos``).

    ``pixels`` names the pixels that have a return; points on others stay.
    """
    wrong = (F.col("plane") > tolerance * F.col("dist") / 10) & ((F.col("conf") < sure) | (F.col("cos") > grazing))
    gone = points.where(wrong).join(pixels.select("px", "py").distinct(), ["px", "py"], "left_semi").select("id")
    return points.join(gone, "id", "left_anti")


def frame_audit(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    """(frame, pixels, returns, assigned, referenced, orphans, uneven): what the pixels (dist, segment) of each frame hold
    against what its segments (frame, segment, n) claim. ``orphans`` are pixels with a segment but no return, ``uneven``
    whether the counts of assigned and referenced pixels differ. Frames of either table appear."""
    p = pixels.groupBy("frame").agg(F.count("*").alias("pixels"), F.count("dist").alias("returns"), F.count("segment").alias("assigned"), F.count_if(F.col("segment").isNotNull() & F.col("dist").isNull()).alias("orphans"))
    s = segments.groupBy("frame").agg(F.sum("n").alias("referenced"))
    names = ("pixels", "returns", "assigned", "referenced", "orphans")
    j = p.join(s, "frame", "full_outer").select("frame", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])
    return j.withColumn("uneven", F.col("assigned") != F.col("referenced"))


def unused_matches(matches: DataFrame, used: DataFrame) -> DataFrame:
    """Matches (id, near_id, ...) whose target is not in ``used`` (near_id)."""
    return matches.join(used.select("near_id").distinct(), "near_id", "left_anti")
