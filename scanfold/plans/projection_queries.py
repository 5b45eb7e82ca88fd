"""Queries on tracks projected into images: points near the returns of ``pixels``, of tracks of five columns each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfold.functions import geo
from scanfold.operators import projection

from .registry import query
from .views import PIXELS, pixels

LONG_TERM = 2
YAW, PITCH = 0.02, 0.03
# steep sides of tracks' points: thresholds as in the operator
_STEEP = [math.cos(math.radians(90 - a)) for a in projection.GRAZING]

#: Each return gives a point to its own pixel and one to the next; both are off by a share of their distance.
CLOUD = f"""img AS (SELECT frame, row, col, dist, dist * cos({PITCH} * row) * cos({YAW} * col) AS x, dist * cos({PITCH} * row) * sin({YAW} * col) AS y, -dist * sin({PITCH} * row) AS z FROM pixels),
  pts AS (SELECT frame, (col // 5) % 3 AS buffer, col // 5 + 1 AS uid, (col // 5) % 4 <> 3 AS registered, row * 100000 + col * 10 + s AS id, row, col + s AS col, dist * (1 + ((row * 7 + col * 3 + s) % 9 - 4) * 0.006) AS dist, ((row + col) % 5) / 4 AS conf,
    s, row AS r0 FROM pixels, (VALUES (0), (1)) o(s) WHERE dist IS NOT NULL),
  cloud AS (SELECT *, dist * cos({PITCH} * r0) * cos({YAW} * col) AS x, dist * cos({PITCH} * r0) * sin({YAW} * col) AS y, -dist * sin({PITCH} * r0) AS z, 0.6 AS nx, 0.0 AS ny, 0.8 AS nz FROM pts),
  trk AS (SELECT frame, buffer, uid, count(*) AS points FROM cloud GROUP BY ALL),
  plc AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY buffer DESC, buffer = {LONG_TERM} AND uid = 1, points DESC, uid) AS place FROM trk),
  atp AS (SELECT c.*, place, CASE WHEN conf < 0.3 THEN i.dist - c.dist ELSE (c.x - i.x) * nx + (c.y - i.y) * ny + (c.z - i.z) * nz END AS plane FROM cloud c JOIN plc USING (frame, buffer, uid) JOIN img i ON i.frame = c.frame AND i.row = c.row AND i.col = c.col AND i.dist IS NOT NULL)"""
OWNERS = f"""{CLOUD}, own AS (SELECT frame, buffer, row, col, uid, registered AS used FROM atp WHERE plane <= 0.02 * dist AND plane > -0.02 * dist
  QUALIFY row_number() OVER (PARTITION BY frame, buffer, row, col ORDER BY NOT registered, dist, place, id) = 1)"""


def _image(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    xyz = geo.from_polar(F.col("col") * YAW, F.col("row") * PITCH, F.col("dist"))
    return p.withColumns(dict(zip("xyz", xyz, strict=True)))


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).where("dist is not null").withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    track = F.floor(F.col("col") / 5)
    off = 1 + ((F.col("row") * 7 + F.col("col") * 3 + F.col("s")) % 9 - 4) * 0.006
    p = p.select("frame", (track % 3).alias("buffer"), (track + 1).alias("uid"), (track % 4 != 3).alias("registered"), (F.col("row") * 100000 + F.col("col") * 10 + F.col("s")).alias("id"), "row", (F.col("col") + F.col("s")).alias("col"), (F.col("dist") * off).alias("dist"), (((F.col("row") + F.col("col")) % 5) / 4).alias("conf"))
    xyz = geo.from_polar(F.col("col") * YAW, F.col("row") * PITCH, F.col("dist"))
    p = p.withColumns({**dict(zip("xyz", xyz, strict=True)), "nx": F.lit(0.6), "ny": F.lit(0.0), "nz": F.lit(0.8)})
    p = p.withColumn("points", F.count("*").over(Window.partitionBy("frame", "buffer", "uid")))
    return projection.registration_order(p, ["frame"], LONG_TERM).drop("points")


@query(f"WITH {PIXELS}, {CLOUD} SELECT frame, buffer, uid, points, CAST(place AS INTEGER) AS place FROM plc")
def registration_order_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cloud(spark, sf_dir)
    return c.groupBy("frame", "buffer", "uid").agg(F.count("*").alias("points"), F.first("place").alias("place"))


@query(f"WITH {PIXELS}, {OWNERS} SELECT frame, buffer, row, col, uid, used FROM own")
def tracks_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track of each pixel, in each buffer."""
    return projection.project_tracks(_cloud(spark, sf_dir), _image(spark, sf_dir)).drop("dist")


@query(f"""WITH {PIXELS}, {OWNERS}, g AS (SELECT p.frame, buffer, p.row, p.col, p.dist, o.uid AS v FROM pixels p JOIN (SELECT DISTINCT frame, buffer FROM own) USING (frame) LEFT JOIN own o USING (frame, buffer, row, col)),
  n AS (SELECT g.*, l.v AS l, r.v AS r, u.v AS u, d.v AS d FROM g LEFT JOIN g l ON l.frame = g.frame AND l.buffer = g.buffer AND l.row = g.row AND l.col = g.col - 1 LEFT JOIN g r ON r.frame = g.frame AND r.buffer = g.buffer AND r.row = g.row AND r.col = g.col + 1
    LEFT JOIN g u ON u.frame = g.frame AND u.buffer = g.buffer AND u.col = g.col AND u.row = g.row - 1 LEFT JOIN g d ON d.frame = g.frame AND d.buffer = g.buffer AND d.col = g.col AND d.row = g.row + 1),
  s AS (SELECT *, list_sort([l, r, u, d], 'ASC', 'NULLS LAST') AS t FROM n)
  SELECT frame, buffer, row, col, CASE WHEN v IS NOT NULL OR dist IS NULL THEN v WHEN t[2] IS NOT DISTINCT FROM t[3] THEN t[2] WHEN t[1] IS NOT DISTINCT FROM t[2] AND t[3] IS DISTINCT FROM t[4] THEN t[1]
    WHEN t[3] IS NOT DISTINCT FROM t[4] AND t[1] IS DISTINCT FROM t[2] THEN t[3] END AS uid FROM s""")
def tracks_projected_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected tracks with the returns between them."""
    image = _image(spark, sf_dir)
    return projection.extended(projection.project_tracks(_cloud(spark, sf_dir), image), image)


@query(f"""WITH {PIXELS}, {CLOUD} SELECT frame, uid, id FROM atp WHERE registered AND buffer = {LONG_TERM} AND plane > 0.02 * dist
  AND (conf < 0.3 OR abs(x * nx + y * ny + z * nz) / sqrt(x * x + y * y + z * z) > CASE WHEN uid = 1 THEN {_STEEP[0]!r} ELSE {_STEEP[1]!r} END)""")
def tracks_seen_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of long-term tracks that the scan has seen through."""
    return projection.seen_through(_cloud(spark, sf_dir), _image(spark, sf_dir), LONG_TERM)
