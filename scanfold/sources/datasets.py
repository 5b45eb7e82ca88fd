"""Folders of recorded drives: projection files, frames with their images, times and poses, and the choice of a reader."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions import geo
from scanfold.functions.text import parse_ns

from .files import exists, lines, names
from .rangeimg import read_range_images

#: Lines before the first record of an inertial file.
HEADER_LINES = 8
#: Distances of images whose projection file gives no multiplier.
MULTIPLIER = 500.0


@dataclass(frozen=True)
class Projection:
    """Columns at a regular spacing from ``h_start`` down to ``h_stop``, and rows at a regular spacing or at ``rows``; radians."""

    width: int
    height: int
    h_start: float
    h_stop: float
    v_start: float
    v_stop: float
    rows: tuple[float, ...] | None
    multiplier: float | None

    def column(self, yaw: Column) -> Column:
        return geo.regular_bin(yaw, self.h_start, self.h_stop, self.width)

    def row(self, pitch: Column) -> Column:
        if self.rows is None:
            return geo.regular_bin(pitch, self.v_start, self.v_stop, self.height)
        return geo.first_near_angle(pitch, list(self.rows))

    def angles(self, row: Column, col: Column) -> tuple[Column, Column]:
        """(yaw, pitch) of a pixel's centre."""
        pitch = geo.bin_center(row, self.v_start, self.v_stop, self.height) if self.rows is None else F.element_at(F.array(*map(F.lit, self.rows)), (row + 1).cast("int"))
        return geo.bin_center(col, self.h_start, self.h_stop, self.width), pitch

    def sphere(self, spark: SparkSession) -> DataFrame:
        """(row, col, x, y, z): the direction of each pixel, of length 1."""
        pixels = spark.range(self.width * self.height).select((F.col("id") / self.width).cast("int").alias("row"), (F.col("id") % self.width).cast("int").alias("col"))
        yaw, pitch = self.angles(F.col("row"), F.col("col"))
        return pixels.select("row", "col", *[c.alias(n) for c, n in zip(geo.from_polar(yaw, pitch, F.lit(1.0)), "xyz", strict=True)])

    def points(self, image: DataFrame) -> DataFrame:
        """``image`` (row, col, dist) with x, y and z."""
        yaw, pitch = self.angles(F.col("row"), F.col("col"))
        return image.withColumns(dict(zip("xyz", geo.from_polar(yaw, pitch, F.col("dist")), strict=True)))


def projection(fields: list[str]) -> Projection:
    """The projection of a file's first record, by its number of fields: 6 or 7 are two regular spacings, 4 or 5 and as
    many angles as the image has rows an irregular one; the odd first field is the multiplier. Angles are in degrees."""
    n = len(fields)
    if n < 6:
        raise ValueError("not enough fields")

    def whole(i: int) -> int | None:
        try:
            return int(float(fields[i]))
        except ValueError:
            return None

    regular = n in (6, 7)
    first = int(n == 7 or n == 5 + (whole(2) or 0))
    if not regular and n != first + 4 + (whole(1 + first) or -1):
        raise ValueError(f"unexpected number of fields: {n}")
    v = [float(f) for f in fields]
    turn = [math.radians(a) for a in v[2 + first :]]
    if turn[1] >= turn[0]:
        raise ValueError("columns must run clockwise")
    if regular and turn[3] <= turn[2]:
        raise ValueError("rows must run downwards")
    rows = None if regular else tuple(turn[2:])
    return Projection(int(v[first]), int(v[first + 1]), turn[0], turn[1], turn[2], turn[3] if regular else turn[-1], rows, v[0] if first else None)


def read_projection(spark: SparkSession, path: str) -> Projection:
    """Of the first line that is neither empty nor a comment."""
    found = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").limit(1).first()
    if found is None:
        raise ValueError(f"{path} has no valid line")
    return projection([f for f in found.value.replace(";", " ").split() if f])


def _with_intensity(images: DataFrame, others: DataFrame, name: Column) -> DataFrame:
    return images.withColumn("key", name).join(others.select(F.col("name").alias("key"), F.col("path").alias("intensity")), "key", "left").drop("key")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(nr, fields) of an inertial file, the first record with nr 0; empty lines count."""
    return lines(spark, path).where(F.col("nr") >= HEADER_LINES).select((F.col("nr") - HEADER_LINES).alias("nr"), F.filter(F.split("value", ";"), lambda f: F.trim(f) != "").alias("fields"))


def _field(i: int) -> Column:
    return F.try_element_at("fields", F.lit(i + 1)).try_cast("double")


def slam_frames(spark: SparkSession, base: str) -> DataFrame:
    """(nr, image, intensity, ts_ns, lat, lon, alt, yaw, pitch, roll, pose_valid) of a folder of ``scan*.png`` with ``imu.cfg``.

    As many frames as there are images and, where there is an inertial file, records. Position and angles are null, and
    the pose not valid, for records of fewer than 8 fields.
    """
    images = names(spark, base, r"scan.*\.png")
    both = _with_intensity(images, names(spark, base, r"intens.*\.png"), F.regexp_replace("name", "^scan", "intens"))
    frames = both.select("nr", F.col("path").alias("image"), "intensity")
    records = _records(spark, f"{base}/imu.cfg")
    if exists(spark, f"{base}/imu.cfg"):
        frames = frames.join(records, "nr")
    else:
        frames = frames.withColumn("fields", F.array().cast("array<string>"))
    full = F.size("fields") > 7
    pose = {c: F.when(full, _field(i)) for i, c in enumerate(("lat", "lon", "alt", "yaw", "pitch", "roll"), 2)}
    return frames.select("nr", "image", "intensity", F.when(F.size("fields") > 0, parse_ns(F.trim(F.element_at("fields", 1)))).alias("ts_ns"), *[c.alias(n) for n, c in pose.items()], full.alias("pose_valid"))


def tracking_frames(spark: SparkSession, base: str) -> DataFrame:
    """The columns of ``slam_frames`` for a folder of ``velodyne_dist/data/*.png`` with ``timestamps.txt``: as many frames as
    both have; there are no poses."""
    images = names(spark, f"{base}/velodyne_dist/data", r".*\.png")
    both = _with_intensity(images, names(spark, f"{base}/velodyne_intens/data", r".*\.png"), F.col("name"))
    stamps = lines(spark, f"{base}/velodyne_dist/timestamps.txt")
    frames = both.join(stamps, "nr").select("nr", F.col("path").alias("image"), "intensity", parse_ns(F.trim("value")).alias("ts_ns"))
    return frames.select("*", *[F.lit(None).cast("double").alias(c) for c in ("lat", "lon", "alt", "yaw", "pitch", "roll")], F.lit(False).alias("pose_valid"))


def tracker_frames(spark: SparkSession, base: str) -> DataFrame:
    """(nr, image, intensity, ts_ns, pose) for tracking: all images of a folder but masks and intensities, with the pose of
    ``imu.cfg`` (records of over 16 fields) if there is one; otherwise the images of ``velodyne_dist/data``, whose number must
    be that of the lines of ``timestamps_start.txt``. ``pose`` is a 4 x 4 matrix or null."""
    if exists(spark, f"{base}/imu.cfg"):
        images = names(spark, base, r".*\.png", r"mask\.png|intens.*\.png")
        rows = images.join(_records(spark, f"{base}/imu.cfg"), "nr", "left")
        full = F.size(F.coalesce("fields", F.array().cast("array<string>"))) > 16
        pose = geo.pose_matrix(*[_field(i) for i in (5, 6, 7, 14, 15, 16)])
        return rows.select("nr", F.col("path").alias("image"), F.lit(None).cast("string").alias("intensity"), F.when(full, parse_ns(F.trim(F.element_at("fields", 1)))).alias("ts_ns"), F.when(full, pose).alias("pose"))
    folder = f"{base}/velodyne_dist/data"
    if not exists(spark, folder):
        raise FileNotFoundError(f"{base} has neither imu.cfg nor velodyne_dist/data")
    images, stamps = names(spark, folder, r".*\.png"), lines(spark, f"{base}/velodyne_dist/timestamps_start.txt").where("trim(value) <> ''")
    counts = images.agg(F.count("*")).first()[0], stamps.count()
    if counts[0] != counts[1]:
        raise ValueError(f"{counts[0]} images but {counts[1]} times")
    others = names(spark, f"{base}/velodyne_intens/data", r".*\.png").select("nr", F.col("path").alias("intensity"))
    rows = images.join(others, "nr", "left").join(stamps, "nr")
    return rows.select("nr", F.col("path").alias("image"), "intensity", parse_ns(F.trim("value")).alias("ts_ns"), F.lit(None).cast("array<double>").alias("pose"))


def mapping_frames(spark: SparkSession, base: str) -> tuple[DataFrame, str]:
    """The frames of a drive for mapping and the path of its projection file: those of ``slam_frames`` if there are any,
    else of ``tracking_frames``."""
    slam = slam_frames(spark, base)
    if not slam.isEmpty():
        return slam, f"{base}/img.cfg"
    return tracking_frames(spark, base), f"{base}/velodyne_dist/velodyne_config.txt"


def frame_points(spark: SparkSession, frames: DataFrame, folder: str, config: str, pattern: str = "*.png") -> DataFrame:
    """(nr, row, col, dist, x, y, z) of the frames' images below ``folder``; an image of another size than the projection's is
    an error of the task that reads it."""
    p = read_projection(spark, config)
    images = read_range_images(spark, folder, p.multiplier or MULTIPLIER, pattern)
    fits = F.col("row").between(0, p.height - 1) & F.col("col").between(0, p.width - 1)
    size = F.when(fits, F.col("dist")).otherwise(F.raise_error(F.concat(F.lit("image larger than its projection: "), F.col("path"))).cast("double"))
    rows = images.join(frames.select("nr", F.col("image").alias("path")), "path").select("nr", "row", "col", size.alias("dist"))
    return p.points(rows)
