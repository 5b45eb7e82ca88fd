"""Projection of tracks into the image of the next scan, in the order in which they are registered.

Going track by track, a pixel belongs to the nearest of the registered tracks' points that agree with its return, and the
pixels they take are used up; tracks whose registration failed come last and get only pixels that none of these has. The
outcome at a pixel is the least of (failed, distance, place in the order, point), so it is one aggregate a pixel instead of
a pass over tracks. Each buffer of tracks has an image of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfold.functions.vec import dot3, norm3

from .audit import fill_from_neighbours

#: Below this confidence a point's normal is not used.
SURE = 0.3
#: Angles in degrees between ray and surface, up to which a point in front of a return may be hidden: the world's, others'.
GRAZING = (30.0, 10.0)
WORLD = 1
PIXEL = ("frame", "row", "col")


def registration_order(tracks: DataFrame, by: list[str], long_term: int) -> DataFrame:
    """Tracks (``by``, buffer, uid, points) with ``place`` within each group of ``by``: buffers from the long-term one
    down to the newest, in each the tracks of most points first, and the world after all other long-term tracks. Rows of
    one track, such as its points, share its place."""
    world = (F.col("buffer") == long_term) & (F.col("uid") == WORLD)
    w = Window.partitionBy(*by).orderBy(F.desc("buffer"), world, F.desc("points"), "uid")
    return tracks.withColumn("place", F.dense_rank().over(w))


def _at_pixels(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Points on returns with the return (p_dist, p_x, p_y, p_z) of their pixel. Both sides lie in one table in place of a
    join, which would shuffle them by the pixel even where both are dealt by frame."""
    own = points.select("frame", "row", "col", F.struct(*points.columns).alias("point"))
    seen = pixels.where("dist is not null").select("frame", "row", "col", F.struct("dist", "x", "y", "z").alias("p"))
    both = own.unionByName(seen, allowMissingColumns=True).where("frame is not null and row is not null and col is not null")
    both = both.withColumn("p", F.max("p").over(Window.partitionBy("frame", "row", "col"))).where("point is not null and p is not null")
    both = both.select("frame", "row", "col", *[F.col(f"point.{c}") for c in points.columns if c not in PIXEL], *[F.col(f"p.{c}").alias("p_" + c) for c in ("dist", "x", "y", "z")])
    gap = [F.col(c) - F.col("p_" + c) for c in "xyz"]
    plane = F.when(F.col("conf") < SURE, F.col("p_dist") - F.col("dist")).otherwise(dot3(gap, [F.col("n" + c) for c in "xyz"]))
    return both.withColumn("plane", plane)


def project_tracks(points: DataFrame, pixels: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """(frame, buffer, row, col, uid, dist, used): the track of each pixel that has one.

    ``points`` (frame, buffer, place, uid, registered, id, row, col, dist, x, y, z, nx, ny, nz, conf) lie in the scan's
    frame, ``pixels`` (frame, row, col, dist, x, y, z) are its returns, one row a pixel. A point agrees with the return if it is within
    ``tolerance`` tenths of its distance of the return's surface. ``used`` pixels are those of registered tracks.
    """
    most = F.lit(tolerance / 10) * F.col("dist")
    near = _at_pixels(points, pixels).where((F.col("plane") <= most) & (F.col("plane") > -most))
    first = F.min(F.struct((~F.col("registered")).alias("failed"), "dist", "place", "id", "uid")).alias("b")
    owners = near.groupBy("frame", "buffer", "row", "col").agg(first)
    return owners.select("frame", "buffer", "row", "col", "b.uid", "b.dist", (~F.col("b.failed")).alias("used"))


def extended(owners: DataFrame, pixels: DataFrame) -> DataFrame:
    """(frame, buffer, row, col, uid) of all returns: those without a track take that of their neighbours."""
    grid = pixels.select("frame", "row", "col", "dist").join(owners.select("frame", "buffer").distinct(), "frame").withColumn("pixel", F.lit(True))
    both = grid.unionByName(owners.select("frame", "buffer", "row", "col", "uid"), allowMissingColumns=True)
    rows = both.groupBy("frame", "buffer", "row", "col").agg(F.max("dist").alias("dist"), F.max("uid").alias("uid"), F.max("pixel").alias("pixel")).where("pixel")
    # each buffer is an image of its own
    return fill_from_neighbours(rows, "uid", ("frame", "buffer")).select("frame", "buffer", "row", "col", F.col("filled").alias("uid"))


def seen_through(points: DataFrame, pixels: DataFrame, long_term: int, tolerance: float = 0.2) -> DataFrame:
    """(frame, uid, id) of the points of registered long-term tracks that the scan has seen through: in front of the
    return's surface by more than the tolerance, and either unsure of their normal or met at more than a grazing angle,
    which is wider for the world than for other tracks."""
    x, n = [F.col(c) for c in "xyz"], [F.col("n" + c) for c in "xyz"]
    steep = [math.cos(math.radians(90 - a)) for a in GRAZING]
    least: Column = F.when(F.col("uid") == WORLD, steep[0]).otherwise(steep[1])
    cos = F.abs(dot3(x, n)) / norm3(x)
    own = _at_pixels(points.where((F.col("buffer") == long_term) & F.col("registered")), pixels)
    return own.where((F.col("plane") > F.lit(tolerance / 10) * F.col("dist")) & ((F.col("conf") < SURE) | (cos > least))).select("frame", "uid", "id")
