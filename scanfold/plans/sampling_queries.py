"""Queries on wider stencils, cells, sampling and order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfold.functions import geo
from scanfold.operators import grid, image, projection, tracks

from . import scan_queries  # noqa: F401  its SQL is built upon
from .registry import ORACLE, query, rounded
from .track_queries import PLACES, _places
from .views import PIXELS, POINTS, POSES, SCAN, pixels, points, poses, scan


def _square(radius: int) -> str:
    around = f"RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    return f"""WITH {PIXELS}, a AS (SELECT *, list(dist) FILTER (WHERE dist IS NOT NULL) OVER (PARTITION BY frame, row ORDER BY col {around}) AS near FROM pixels),
  b AS (SELECT *, list_sort(flatten(list(coalesce(near, [])) OVER (PARTITION BY frame, col ORDER BY row {around}))) AS m FROM a)
  SELECT frame, row, col, CASE WHEN dist IS NOT NULL THEN m[len(m) // 2 + 1] END AS median FROM b"""


@query(_square(1))
def image_median_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.median_square(pixels(spark, sf_dir), 1).select("frame", "row", "col", "median")


@query(_square(2))
def image_median_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.median_square(pixels(spark, sf_dir), 2).select("frame", "row", "col", "median")


@query(f"WITH {SCAN} SELECT a.frame, a.col, greatest(a.dist, b.dist) AS most, least(a.dist, b.dist) AS least FROM scan a JOIN scan b ON b.frame = a.frame + 1 AND b.col = a.col")
def scan_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(spark, sf_dir)
    return image.elementwise(s, s.withColumn("frame", F.col("frame") - 1), ["frame", "col"])


@query(f"SELECT frame, col, CAST(weight >= 0.5 AS DOUBLE) AS weight FROM ({ORACLE['connectivity_weight']})")
def connectivity_binarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.binarised(rounded(image.connections(scan(spark, sf_dir)), "weight")).select("frame", "col", "weight")


@query(f"""WITH {POINTS}, c AS (SELECT DISTINCT CAST(floor(x / 5) AS INTEGER) AS ix, CAST(floor(y / 5) AS INTEGER) AS iy, CAST(floor(z / 5) AS INTEGER) AS iz FROM points)
  SELECT a.ix, a.iy, a.iz, count(*) AS n FROM c a JOIN c b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 GROUP BY ALL""")
def grid_neighbour_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.neighbour_cells(points(spark, sf_dir), 5.0)


@query(f"""WITH {PLACES} SELECT id, round(360 / pi() * atan(exp((s * 6378137.0 * ln(tan((90 + lat) * pi() / 360)) + 250) / (6378137.0 * s))) - 90, 9) AS lat,
    round((s * lon * pi() * 6378137.0 / 180 + 100) * 180 / (pi() * 6378137.0 * s), 9) AS lon FROM (SELECT *, cos(lat * pi() / 180) AS s FROM places)""")
def places_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = geo.add_metres(F.col("lat"), F.col("lon"), F.lit(100.0), F.lit(250.0))
    return rounded(_places(spark, sf_dir).select("id", lat.alias("lat"), lon.alias("lon")), "lat", "lon", digits=9)


@query(f"""WITH {PLACES}, n AS (SELECT a.id, a.lat, a.lon, cos(a.lat * pi() / 180) AS s, b.lat AS lat2, b.lon AS lon2 FROM places a LEFT JOIN places b ON b.id = a.id + 1)
  SELECT id, round(s * (lon2 - lon) * pi() * 6378137.0 / 180, 3) AS dx, round(s * 6378137.0 * (ln(tan((90 + lat2) * pi() / 360)) - ln(tan((90 + lat) * pi() / 360))), 3) AS dy FROM n""")
def places_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _places(spark, sf_dir)
    nxt = p.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    dx, dy = geo.metres_between(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return rounded(p.join(nxt, "id", "left").select("id", dx.alias("dx"), dy.alias("dy")), "dx", "dy", digits=3)


@query(f"""WITH {POSES} SELECT uid, step, round(cos(yaw), 6) AS r00, round(-sin(yaw), 6) AS r01, round(sin(yaw), 6) AS r10, CAST(1 AS DOUBLE) AS r22, round(x, 6) AS tx, round(y, 6) AS ty, true AS same FROM poses""")
def pose_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    p = poses(spark, sf_dir).withColumn("m", geo.pose_matrix(F.col("yaw"), zero, zero, F.col("x"), F.col("y"), zero))
    r, t = geo.split_pose(F.col("m"))
    p = p.withColumns({"r": r, "t": t}).withColumn("same", geo.join_pose(F.col("r"), F.col("t")) == F.col("m"))
    cells = {"r00": ("r", 0), "r01": ("r", 1), "r10": ("r", 3), "r22": ("r", 8), "tx": ("t", 0), "ty": ("t", 1)}
    return rounded(p.select("uid", "step", *[F.col(a).getItem(i).alias(c) for c, (a, i) in cells.items()], "same"), *cells)


@query(f"""WITH {POINTS} SELECT label, round(count(DISTINCT (floor(atan2(ny, nx) / 0.5), floor(acos(nz) / 0.5))) / pow(2 * pi() / 0.5, 2), 6) AS coverage FROM points GROUP BY label""")
def normal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied cells of the normals' angles, by label, as a share of all."""
    cells = F.count_distinct(F.floor(F.atan2("ny", "nx") / 0.5), F.floor(F.acos("nz") / 0.5))
    return rounded(points(spark, sf_dir).groupBy("label").agg((cells / (2 * math.pi / 0.5) ** 2).alias("coverage")), "coverage")


@query(f"""WITH {POSES}, s AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n, row_number() OVER (PARTITION BY uid ORDER BY step) AS k FROM poses),
  z AS (SELECT *, greatest(CASE WHEN n <= 20 THEN n ELSE 20 + CAST(ceil(2 * sqrt(n - 20)) AS BIGINT) END, 1) AS size FROM s)
  SELECT uid, step, size FROM z WHERE floor(k * (CAST(size AS DOUBLE) / n)) <> floor((k - 1) * (CAST(size AS DOUBLE) / n))""")
def track_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = Window.partitionBy("uid")
    p = poses(spark, sf_dir).withColumns({"n": F.count("*").over(every), "k": F.row_number().over(every.orderBy("step"))})
    p = p.withColumn("size", tracks.subsample_size(F.col("n"), 20)).withColumn("share", F.col("size").cast("double") / F.col("n"))
    return p.where(F.floor(F.col("k") * F.col("share")) != F.floor((F.col("k") - 1) * F.col("share"))).select("uid", "step", "size")


@query(f"""WITH {PIXELS}, s AS (SELECT frame, row, col, row <= 3 AS upper, row * 1000 + col AS spot FROM pixels WHERE dist IS NOT NULL),
  k AS (SELECT *, least(1.0::DOUBLE, CASE WHEN upper THEN 6.0 ELSE 2.0 END::DOUBLE / count(*) OVER (PARTITION BY frame, upper)) AS share, row_number() OVER (PARTITION BY frame, upper ORDER BY spot) AS k FROM s)
  SELECT frame, row, col, upper FROM k WHERE floor(k * share) <> floor((k - 1) * share)""")
def stratified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).where("dist is not null").withColumn("spot", F.col("row") * 1000 + F.col("col"))
    return tracks.stratified(p, 8, F.col("row") <= 3, "spot", "frame").where("taken").select("frame", "row", "col", "upper")


@query(f"WITH {POSES} SELECT uid, step, round(lag(x) OVER w, 6) AS x1, round(lag(x, 2) OVER w, 6) AS x2, round(x - lag(x, 2) OVER w, 6) AS over2 FROM poses WINDOW w AS (PARTITION BY uid ORDER BY step)")
def last_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("uid").orderBy("step")
    one, two = F.lag("x").over(w), F.lag("x", 2).over(w)
    return rounded(poses(spark, sf_dir).select("uid", "step", one.alias("x1"), two.alias("x2"), (F.col("x") - two).alias("over2")), "x1", "x2", "over2")


@query(f"WITH {POSES} SELECT uid, step, round(x, 6) AS x FROM poses WHERE step BETWEEN 5 AND 25")
def play_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(poses(spark, sf_dir).where(F.col("step").between(5, 25)).select("uid", "step", "x"), "x")


@query(f"""WITH {POSES}, t AS (SELECT uid, uid % 16 AS frame, (max(step) // 10) % 4 AS buffer, count(*) AS points FROM poses GROUP BY uid)
  SELECT uid, frame, buffer, points, CAST(row_number() OVER (PARTITION BY frame ORDER BY buffer DESC, buffer = 3 AND uid = 1, points DESC, uid) AS INTEGER) AS place FROM t""")
def registration_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of each frame in the order of their registration."""
    t = poses(spark, sf_dir).groupBy("uid").agg((F.floor(F.max("step") / 10) % 4).alias("buffer"), F.count("*").alias("points"))
    return projection.registration_order(t.withColumn("frame", F.col("uid") % 16), ["frame"], 3).select("uid", "frame", "buffer", "points", "place")
