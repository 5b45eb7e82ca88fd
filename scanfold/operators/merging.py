"""What becomes of a young track: ignored, kept, or merged into a track it is linked with.

Stage 1 judges a track by its own features and those of three of its links: the one of least point-to-plane error, of
least point-to-point error and of most strength. Stage 2 scores each link. The features exist in two versions; the first
takes the moves along a surface where those across it were meant, which trained models expect.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfold.functions.soft import mlog

#: Errors and ages above these count as these.
ERROR_MOST, AGE_MOST = 2.0, 20
IGNORE, KEEP, MERGE = 1, 2, 3


def _ratio(a: Column, b: Column, least: float) -> Column:
    return a / F.greatest(b.cast("double"), F.lit(least))


def with_link_statistics(links: DataFrame) -> DataFrame:
    """``links`` (src, nth, dst, strength, plane, point, ...) with errors held to ERROR_MOST and, by src, n_links, total,
    strongest, least_plane, any_moving, and the chosen links by_plane, by_point and by_strength (structs of the link).
    Of equally good links the last in order of ``nth`` is chosen."""
    held = links.withColumns({c: F.least(F.col(c), F.lit(ERROR_MOST)) for c in ("plane", "point")})
    w = Window.partitionBy("src")
    link = F.struct(*[F.col(c) for c in held.columns if c != "src"])
    chosen = {"by_plane": -F.col("plane"), "by_point": -F.col("point"), "by_strength": F.col("strength").cast("double")}
    stats = {"n_links": F.count("*").over(w), "total": F.sum("strength").over(w), "strongest": F.max("strength").over(w), "least_plane": F.min("plane").over(w), "least_point": F.min("point").over(w), "any_moving": F.max(F.col("moving").cast("int")).over(w)}
    return held.withColumns(stats | {n: F.max_by(link, F.struct(by.alias("by"), "nth")).over(w) for n, by in chosen.items()})


def stage1_features(tracks: DataFrame, links: DataFrame, version: int = 2) -> DataFrame:
    """(src, f): 50 features of version 1 or 52 of version 2 of each track.

    ``tracks`` (src, measured, fails, jerk, plane, point, idle, points, normal_move, h0..h3) hold the last update's success,
    failures of the last three, the change between its last two moves, errors, points, the move along the most frequent
    normal and how many normals lie from across (h3) to along (h0) the move. ``links`` also hold measured, idle, age,
    points and moving of their tracks. Tracks without links have zeros.
    """
    one = with_link_statistics(links).groupBy("src").agg(*[F.first(c).alias(c) for c in ("n_links", "total", "strongest", "by_plane", "by_point", "by_strength")])
    t = tracks.join(one, "src", "left")
    points = F.col("points").cast("double")
    h = [F.col(f"h{k}") for k in range(4)]
    own_plane, own_point = (F.least(F.col(c), F.lit(ERROR_MOST)) for c in ("plane", "point"))
    f = [F.col("measured"), F.col("fails"), mlog(F.col("jerk")), own_plane, own_point, F.col("idle"), mlog(points), F.col("normal_move")]
    if version == 2:
        f += [mlog(h[3]), mlog(h[2]), mlog(h[1]), mlog(h[3] + h[2]), h[3] / points, (h[3] + h[2]) / points]
    else:
        f += [mlog(h[0]), mlog(h[0] + h[1]), h[0] / points, (h[0] + h[1]) / points]
    total = F.coalesce("total", F.lit(0))
    f += [F.coalesce("n_links", F.lit(0)), mlog(total)]
    for chosen in ("by_plane", "by_point", "by_strength"):
        link = F.col(chosen).getField
        strength = link("strength")
        f += [link("measured"), mlog(strength), _ratio(strength, total, 1.0), _ratio(strength, F.col("strongest"), 1.0), link("idle"), F.least(link("age"), F.lit(AGE_MOST)), mlog(link("points")), mlog(link("points") / points)]
        f += [link("plane"), link("point"), mlog(_ratio(link("plane"), own_plane, 1e-9)), mlog(_ratio(link("point"), own_point, 1e-9))]
    return t.select("src", F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in f]).alias("f"))


def stage2_features(tracks: DataFrame, links: DataFrame, version: int = 2) -> DataFrame:
    """(src, dst, nth, f): 30 features of version 1 or 32 of version 2 of each link; links also hold ``apart`` (the
    distance of the two states that the link implies), ``apart_src`` and ``apart_dst`` (the same by each one's covariance)."""
    own = tracks.select("src", *[F.col(c).alias("own_" + c) for c in ("plane", "point", "idle", "points", "normal_move", "h0", "h1", "h2", "h3")])
    t = with_link_statistics(links).join(own, "src").withColumns({c: F.least(F.col(c), F.lit(ERROR_MOST)) for c in ("own_plane", "own_point")})
    h = [F.col(f"own_h{k}") for k in range(4)]
    points = F.greatest(F.col("own_points").cast("double"), F.lit(1.0))
    f = [F.col("n_links"), mlog(F.col("strength")), mlog(F.col("total")), _ratio(F.col("strength"), F.col("total"), 1.0), _ratio(F.col("strength"), F.col("strongest"), 1.0)]
    for c in ("plane", "point"):
        f += [F.col("own_" + c), F.col(c), mlog(_ratio(F.col(c), F.col("own_" + c), 1e-9)), mlog(_ratio(F.col(c), F.col("least_" + c), 1e-9))]
    f += [F.col("own_idle"), F.col("idle"), mlog(F.col("own_points")), mlog(F.col("points")), mlog(_ratio(F.col("own_points"), F.col("points"), 1.0))]
    f += [F.col("moving"), F.col("any_moving"), *[mlog(F.col(c)) for c in ("apart", "apart_src", "apart_dst")]]

    def share(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a / b)

    if version == 2:
        f += [mlog(h[3]), mlog(h[2]), mlog(h[1]), mlog(h[3] + h[2]), share(h[2] + h[3], h[0] + h[1]), share(h[1] + h[2] + h[3], h[0]), h[3] / points, (h[3] + h[2]) / points]
    else:  # the last sum takes h2, not h1
        f += [mlog(h[0]), mlog(h[0] + h[1]), share(h[1] + h[0], h[3] + h[2]), share(h[2] + h[1] + h[0], h[3]), h[0] / points, (h[0] + h[2]) / points]
    f.append(F.col("own_normal_move"))
    return t.select("src", "dst", "nth", F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in f]).alias("f"))


@dataclass(frozen=True)
class Model:
    """A linear score over features scaled to 0..1 by their bounds; a feature whose bounds are equal counts as 0."""

    weights: Sequence[float]
    bias: float
    low: Sequence[float]
    high: Sequence[float]

    def score(self, f: Column) -> Column:
        total = F.lit(float(self.bias))
        for i, (w, lo, hi) in enumerate(zip(self.weights, self.low, self.high, strict=True)):
            if hi > lo and w:
                total = total + F.lit(float(w)) * (F.element_at(f, i + 1) - F.lit(float(lo))) / F.lit(float(hi - lo))
        return total


def decide(tracks: DataFrame, links: DataFrame, score: Model, version: int = 2, stage1: Callable[[Column], Column] | None = None, tracking: bool = True) -> DataFrame:
    """(src, decision, dst, score): ignore, keep or merge each track and the track it goes to; kept tracks have none.

    ``stage1`` gives the decision from the features of a track. Without it a track is kept if no link scores above 0, and
    else merged where ``merge_measured`` holds (its merge was registered), ignored where not. With it the best link counts
    whatever its score. The only link of a track that was not measured last scores 1. The first of equal links wins. With
    ``tracking`` off all are merged. If the table holds one track and nothing to link with, it is the world and is kept.
    """
    scored = stage2_features(tracks, links, version).withColumn("score", score.score(F.col("f"))).select("src", "dst", "nth", "score")
    idle = tracks.select("src", F.col("idle").alias("own_idle"))
    alone = F.count("*").over(Window.partitionBy("src")) == 1
    scored = scored.join(idle, "src").withColumn("score", F.when(alone & (F.col("own_idle") > 0), 1.0).otherwise(F.col("score")))
    best = scored if stage1 else scored.where("score > 0")
    best = best.groupBy("src").agg(F.min(F.struct((-F.col("score")).alias("neg"), "nth", "dst")).alias("b"))
    t = tracks.select("src", "merge_measured").join(best, "src", "left")
    linked = F.col("b").isNotNull()
    if stage1:
        first = stage1_features(tracks, links, version).select("src", stage1(F.col("f")).alias("first"))
        t = t.join(first, "src")
        decision = F.when(linked, F.col("first")).otherwise(F.lit(KEEP))
    else:
        decision = F.when(~linked, KEEP).when(F.col("merge_measured"), MERGE).otherwise(IGNORE)
    if not tracking:
        decision = F.when(linked, MERGE).otherwise(KEEP)
    out = t.withColumn("decision", decision)
    goes = F.col("decision") != KEEP
    return out.select("src", "decision", F.when(goes, F.col("b.dst")).alias("dst"), F.when(goes, -F.col("b.neg")).alias("score"))
