"""Lives of tracks: states of new ones, ageing, merging and what becomes of a segment's links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanfold.functions.soft import mlog

from .grid import CELL, with_cells


def new_states(points: DataFrame, speed: tuple[float, float, float] = (0.0, 0.0, 0.0), p_rate: Sequence[float] = (7.4, 7.4, 7.4, 100.0, 100.0, 20.0)) -> DataFrame:
    """(segment, x, p): 12 states of a track that starts at a segment's mean point at rest against the ground; its
    positions are certain and its rates are not."""
    mean = points.groupBy("segment").agg(*[F.avg(c).alias(c) for c in "xyz"])
    zero = [F.lit(0.0)] * 3
    x = F.array(*zero, *[F.col(c) for c in "xyz"], *zero, *[F.lit(-float(s)) for s in speed])
    p = F.array(*[F.lit(float(p_rate[i - 6]) if i == j and i >= 6 else 0.0) for i in range(12) for j in range(12)])
    return mean.select("segment", x.alias("x"), p.alias("p"))


def age_tracks(tracks: DataFrame, counts: DataFrame, frame: int, most_idle: int = 30, least_points: int = 3) -> DataFrame:
    """Tracks a frame older, without those not updated for ``most_idle`` frames or of fewer than ``least_points``."""
    t = tracks.join(counts, "uid", "left").withColumn("points", F.coalesce("points", F.lit(0)))
    return t.where((F.lit(frame) - F.col("last_update") < most_idle) & (F.col("points") >= least_points)).withColumn("age", F.col("age") + 1)


def merge_points(kept: DataFrame, added: DataFrame, extent: float) -> DataFrame:
    """Points of two tracks in one frame, those of the second only into cells that the first leaves empty, one a cell."""
    first = with_cells(kept, extent).withColumn("prio", F.lit(0))
    second = with_cells(added, extent).withColumn("prio", F.lit(1))
    w = Window.partitionBy(*CELL).orderBy("prio", "id")
    one = second.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return first.unionByName(one.join(first.select(*CELL).distinct(), list(CELL), "left_anti")).drop("prio")


def with_uids(tracks: DataFrame, first: int, order: str) -> DataFrame:
    """New tracks of a frame numbered from ``first``; a frame's new tracks are few and are ordered together."""
    return tracks.withColumn("uid", (F.row_number().over(Window.partitionBy("frame").orderBy(order)) + first - 1).cast("long"))


def link_features(links: DataFrame, tracks: DataFrame) -> DataFrame:
    """Features f of each link (src, dst, strength, moved, error) from its track (dst, age, points, speed): the logs of
    strength, points and age, the share of the track that the link covers, speed, move and error."""
    t = links.join(tracks, "dst")
    f = [mlog(F.col("strength")), mlog(F.col("points")), mlog(F.col("age")), F.coalesce(F.try_divide(F.col("strength").cast("double"), F.col("points")), F.lit(0.0)), F.col("speed"), F.col("moved"), F.col("error")]
    return t.select("src", "dst", "strength", F.array(*[c.cast("double") for c in f]).alias("f"))


def decide(links: DataFrame, weights: Sequence[float], bias: float, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """(src, dst, score, decision): the best link of each segment by its linear score over features scaled by ``low`` and
    ``high``: merge where the score is above 0 or the link is the only one, keep where it has points, else ignore.
    Equal scores go to the first target."""
    scaled = [F.try_divide(F.element_at("f", i + 1) - F.lit(float(lo)), F.lit(float(hi) - float(lo))) for i, (lo, hi) in enumerate(zip(low, high, strict=True))]
    score = sum((F.lit(float(w)) * F.coalesce(s, F.lit(0.0)) for w, s in zip(weights, scaled, strict=True)), F.lit(float(bias)))
    n = F.count("*").over(Window.partitionBy("src"))
    s = links.withColumn("score", F.when(n == 1, F.greatest(score, F.lit(1.0))).otherwise(score))
    best = s.groupBy("src").agg(F.min(F.struct((-F.col("score")).alias("neg"), "dst", "strength")).alias("b"))
    decision = F.when(F.col("b.neg") < 0, "merge").when(F.col("b.strength") > 0, "keep").otherwise("ignore")
    return best.select("src", F.col("b.dst").alias("dst"), (-F.col("b.neg")).alias("score"), decision.alias("decision"))


def normal_sample(rows: DataFrame, mean: Sequence[float], cov: Sequence[Sequence[float]], seed: int) -> DataFrame:
    """``rows`` with v, a draw from a multivariate normal; a seed gives the same draws for the same partitions."""
    import numpy as np

    factor = np.linalg.cholesky(np.asarray(cov, float))
    z = [F.randn(seed + k) for k in range(len(mean))]
    r = rows.withColumns({f"z{k}": c for k, c in enumerate(z)})
    v = [sum((F.lit(float(factor[i, j])) * F.col(f"z{j}") for j in range(i + 1)), F.lit(float(m))) for i, m in enumerate(mean)]
    return r.withColumn("v", F.array(*v)).drop(*(f"z{k}" for k in range(len(mean))))
