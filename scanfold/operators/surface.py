"""Surface normals of range images and their trust, visibility between frames, and reinforced edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfold.functions.vec import cross3, dot3, norm3

from .image import along

SIDES = ("right", "up", "left", "down")


def image_to_points(rows: DataFrame, columns: int, v_start: float, v_step: float) -> DataFrame:
    """``rows`` with the place x, y, z of each return; columns go once around against yaw, rows start at ``v_start``."""
    import math

    from scanfold.functions.geo import bin_center, from_polar

    yaw = bin_center(F.col("col"), math.pi, -math.pi, columns)
    return rows.withColumns(dict(zip("xyz", from_polar(yaw, F.lit(v_start) + F.col("row") * F.lit(v_step), F.col("dist")), strict=True)))


def normals(points: DataFrame, noise: float = 0.015) -> DataFrame:
    """``points`` (frame, row, col, dist, x, y, z, wh, wv: weights of the connections to the next column and row) with
    nx, ny, nz, the unit normal towards the scanner, and weight, the greatest weight of a pair of sides.

    Each pair of neighbouring sides adds the cross product of its unit offsets by the product of the sides' weights; a
    side farther than its centre by twice the noise counts 2. The normal is null where the weights or the sum are small.
    """
    h, v = along(points, "col"), along(points, "row")
    steps = {"right": (h, 1, F.col("wh")), "left": (h, -1, F.lag("wh").over(h)), "down": (v, 1, F.col("wv")), "up": (v, -1, F.lag("wv").over(v))}
    cols = {}
    for side, (w, k, weight) in steps.items():
        other = {c: F.lead(c, 1).over(w) if k > 0 else F.lag(c, 1).over(w) for c in ("dist", "x", "y", "z")}
        off = tuple(other[c] - F.col(c) for c in "xyz")
        size = norm3(off)
        cols |= {f"{side}_{c}": F.coalesce(F.try_divide(o, size), F.lit(0.0)) for c, o in zip("xyz", off, strict=True)}
        far = other["dist"] > F.col("dist") + 2 * noise
        cols[f"{side}_w"] = F.when(other["dist"].isNull(), 0.0).when(far, 2.0).otherwise(F.coalesce(weight, F.lit(0.0)))
    p = points.withColumns(cols)
    pairs = [(a, b) for a, b in zip(SIDES, (*SIDES[1:], SIDES[0]), strict=True)]
    weight = [F.col(f"{a}_w") * F.col(f"{b}_w") for a, b in pairs]
    cross = [cross3(*(tuple(F.col(f"{s}_{c}") for c in "xyz") for s in pair)) for pair in pairs]
    total = [sum(w * c[k] for w, c in zip(weight, cross, strict=True)) for k in range(3)]
    p = p.withColumns({"sw": sum(weight), "weight": F.greatest(*weight), "sx": total[0], "sy": total[1], "sz": total[2]})
    size = norm3((F.col("sx"), F.col("sy"), F.col("sz")))
    facing = F.when(dot3((F.col("sx"), F.col("sy"), F.col("sz")), (F.col("x"), F.col("y"), F.col("z"))) > 0, -1.0).otherwise(1.0)
    ok = (F.col("sw") >= 0.01) & (size >= 0.01) & F.col("dist").isNotNull()
    p = p.withColumns({"n" + c: F.when(ok, facing * F.col("s" + c) / size) for c in "xyz"})
    return p.drop("sw", "sx", "sy", "sz", *(f"{s}_{c}" for s in SIDES for c in ("x", "y", "z", "w")))


def normal_confidence(p: DataFrame, sigma: float = 0.2) -> DataFrame:
    """``conf``: least of 1, the pair weight and the better planarity of both axes; the planarity of an axis falls with
    the angles between the normal's plane and the directions to the neighbours on it."""
    planar = []
    for axis in ("col", "row"):
        w = along(p, axis)
        term = F.lit(1.0)
        for f in (F.lag, F.lead):
            off = tuple(f(c).over(w) - F.col(c) for c in "xyz")
            sine = F.try_divide(F.abs(dot3(off, tuple(F.col("n" + c) for c in "xyz"))), norm3(off))
            term = term * F.exp(-0.5 * F.pow(F.asin(F.least(sine, F.lit(1.0))) / sigma, F.lit(2.0)))
        planar.append(F.coalesce(term, F.lit(0.0)))
    r = p.withColumns({"planar_h": planar[0], "planar_v": planar[1]})
    return r.withColumn("conf", F.when(F.col("nx").isNotNull(), F.least(F.lit(1.0), F.col("weight"), F.greatest("planar_h", "planar_v"))).otherwise(0.0)).drop("planar_h", "planar_v")


def seen_in(points: DataFrame, image: DataFrame, tolerance: float) -> DataFrame:
    """Which points (other, px, py, dist: their frame's neighbour ``other``, and pixel and distance there) are visible in
    it: not hidden behind another point of their pixel, nor behind the return of ``image`` (other, row, col, dist) by more
    than ``tolerance``."""
    w = Window.partitionBy("other", "px", "py")
    there = image.select("other", F.col("col").alias("px"), F.col("row").alias("py"), F.col("dist").alias("there"))
    p = points.withColumn("front", F.min("dist").over(w)).join(there, ["other", "px", "py"], "left")
    return p.withColumn("seen", (F.col("dist") <= F.col("front") + tolerance) & (F.col("there").isNull() | (F.col("dist") <= F.col("there") + tolerance)))


def reinforced(edges: DataFrame) -> DataFrame:
    """Scores sh (to the next column) and sv (to the next row) held to the best way around by a triangle of edges: the
    least of each and the greatest of its four two-edge detours."""
    h, v = along(edges, "col"), along(edges, "row")
    sv_next, sh_below = F.lead("sv").over(h), F.lead("sh").over(v)
    above = {"sh_up": F.lag("sh").over(v), "sv_up": F.lag("sv").over(v), "sv_left": F.lag("sv").over(h), "sh_left": F.lag("sh").over(h)}
    e = edges.withColumns({"sv_next": sv_next, "sh_below": sh_below, **above})
    pair = lambda a, b: F.least(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))
    c = F.col
    best_h = F.greatest(pair(c("sv"), c("sh_below")), pair(c("sv_next"), c("sh_below")), pair(c("sv_up"), c("sh_up")), pair(c("sh_up"), c("sv_next")))
    best_v = F.greatest(pair(c("sh"), c("sv_next")), pair(c("sh_below"), c("sv_next")), pair(c("sh_left"), c("sv_left")), pair(c("sv_left"), c("sh_below")))
    return e.withColumns({"sh": F.least(c("sh"), best_h), "sv": F.least(c("sv"), best_v)}).drop("sv_next", "sh_below", *above)


def track_threshold(same_track: Column, threshold: Column, speed_gap: Column, low: float, high: float) -> Column:
    """Edge threshold that tracks move: 0.8 of it within one track, else up to 1.2 of it as their speeds differ."""
    from scanfold.functions.soft import lin_sat

    return threshold * F.when(same_track, 0.8).otherwise(1.0 + 0.2 * lin_sat(speed_gap, low, high))
