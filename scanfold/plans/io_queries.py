"""Queries that write the views to files of each format and read them back."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions import geo
from scanfold.operators.grid import with_cells
from scanfold.runs import dealt
from scanfold.sources import datasets, files, pointfiles, rangeimg, textual
from scanfold.stored import new_path, stored

from .registry import query, rounded
from .views import PIXELS, POINTS, POSES, pixels, points, poses


@query(f"WITH {PIXELS} SELECT frame, row, col, floor(dist * 500) / 500 AS dist FROM pixels WHERE floor(dist * 500) > 0")
def range_images_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame as a range image of 16 bits, written and read."""
    folder = new_path(spark, "images")
    frame = F.col("frame").cast("string")
    # a thousand folders, so that tasks do not wait for one; the files' names are kept, so that none is listed
    images = rangeimg.encode_frames(pixels(spark, sf_dir)).select(F.concat(F.pmod("frame", F.lit(1000)).cast("string"), F.lit("/"), frame, F.lit(".png")).alias("name"), "content")
    done = stored(files.write_files(images, folder))
    rows = rangeimg.range_images(files.read_files(dealt(done, "path"))).where("dist is not null")
    return rows.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("frame"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "dist")


@query(f"WITH {POINTS} SELECT round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, CAST(floor(conf * 255) AS SMALLINT) AS intensity FROM points")
def points_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with intensities as binary files, written by the data source and read by its ranges."""
    pointfiles.register(spark)
    folder = new_path(spark, "points")
    rows = points(spark, sf_dir).select("x", "y", "z", F.floor(F.col("conf") * 255).cast("short").alias("intensity"))
    rows.write.format("points").mode("append").option("path", folder).option("kind", "p3dib").save()
    return rounded(spark.read.format("points").load(folder).select("x", "y", "z", "intensity"), "x", "y", "z", digits=9)


@query(f"""WITH {POINTS} SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(nx, 6) AS nx, round(conf, 6) AS conf, CAST(1 AS INTEGER) AS hits, CAST(id % 200 AS SMALLINT) AS intensity FROM points""")
def map_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as the surfaces of a map in text."""
    folder = new_path(spark, "map")
    p = points(spark, sf_dir).withColumns({"pose": F.lit(0), "range": F.lit(1.0), "hits": F.lit(1), "intensity": F.col("id") % 200, **{"o" + c: F.lit(0.0) for c in "xyz"}})
    textual.map_lines(p).write.text(folder)
    return rounded(textual.read_map(spark, folder).select("x", "y", "z", "nx", "conf", "hits", "intensity"), "x", "y", "z", "nx", "conf")


@query(f"WITH {POSES} SELECT ts_us * 1000 AS ts_ns, round(x, 6) AS x, round(y, 6) AS y, round(cos(yaw), 6) AS c, round(sin(yaw), 6) AS s FROM poses")
def trajectory_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses as lines of a stamp and a matrix."""
    folder, zero = new_path(spark, "trajectory"), F.lit(0.0)
    m = geo.pose_matrix(F.col("yaw"), zero, zero, F.col("x"), F.col("y"), zero)
    textual.trajectory_lines(poses(spark, sf_dir).select((F.col("ts_us") * 1000).alias("ts_ns"), m.alias("htm"))).write.text(folder)
    at = F.col("htm").getItem
    return rounded(textual.read_trajectory(spark, folder).select("ts_ns", at(3).alias("x"), at(7).alias("y"), at(0).alias("c"), at(4).alias("s")), "x", "y", "c", "s")


#: A projection whose rows are not evenly spaced, in degrees.
ROWS = (-60.0, -50.0, -35.0, -20.0, -12.0, -5.0, 0.0, 4.0, 9.0, 15.0, 27.0, 40.0, 58.0)
PROJECTION = datasets.projection(["180", str(len(ROWS)), "180", "-180", *map(str, ROWS)])
_SPACING = math.radians(ROWS[-1] - ROWS[0]) / (len(ROWS) - 1)


@query(f"""WITH {POINTS}, a AS (SELECT id, atan2(y, x) AS yaw, atan2(-z, sqrt(x * x + y * y)) AS pitch FROM points),
  g AS (SELECT id, ((pi() - yaw) % (2 * pi()) + 2 * pi()) % (2 * pi()) AS t, [{", ".join(f"abs({math.radians(r)!r} - pitch)" for r in ROWS)}] AS g FROM a),
  n AS (SELECT *, coalesce(list_position([g[i + 1] > g[i] FOR i IN range(1, {len(ROWS)})], true), {len(ROWS)}) AS k FROM g)
  SELECT id, CASE WHEN g[k] <= {_SPACING!r} THEN CAST(k - 1 AS INTEGER) END AS row, CAST(floor(t / (2 * pi() / 180)) AS INTEGER) AS col FROM n""")
def irregular_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of points in a projection with a list of row angles."""
    p = points(spark, sf_dir)
    yaw, pitch, _ = geo.to_polar(F.col("x"), F.col("y"), F.col("z"))
    return p.select("id", PROJECTION.row(pitch).alias("row"), PROJECTION.column(yaw).alias("col"))


@query(f"""WITH {POINTS} SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM points WHERE x * x + y * y + z * z > 64 AND id % 3 <> 0""")
def evicted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells far from the sensor appended as text, two batches; those hit once only are not kept."""
    from scanfold.streaming.stateful import append_evicted

    folder = new_path(spark, "evicted")
    p = with_cells(points(spark, sf_dir), 1.0).withColumns({"hits": F.when(F.col("id") % 3 == 0, 1).otherwise(2)})
    for half in (0, 1):
        append_evicted(p.where(F.col("id") % 2 == half), (0.0, 0.0, 0.0), 8.0, folder)
    return rounded(pointfiles.read_points(spark, folder).select("x", "y", "z"), "x", "y", "z")
