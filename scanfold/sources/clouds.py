"""Binary point clouds, file listings and drive folders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_clouds(spark: SparkSession, path: str, pattern: str = "*.bin", kind: str = "<f4", columns: tuple[str, ...] = ("x", "y", "z", "reflectance")) -> DataFrame:
    """(path, nr, columns...) of files of little-endian records, in file order; a broken last record is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = np.dtype(kind).itemsize * len(columns)
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                v = np.frombuffer(content[: len(content) // size * size], kind).reshape(-1, len(columns)).astype(np.float64)
                yield pd.DataFrame({"path": name, "nr": np.arange(len(v)), **{c: v[:, i] for i, c in enumerate(columns)}})

    return files.select("path", "content").mapInPandas(run, "path string, nr long, " + ", ".join(f"{c} double" for c in columns))


def list_files(spark: SparkSession, path: str, contains: str = "", matches: str = "") -> DataFrame:
    """(path, length, nr): files below a folder whose name contains a piece and matches a pattern, numbered by path.

    Numbers follow the sorted paths of each folder; contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    files = files.where(name.contains(contains)).where(name.rlike(matches) if matches else F.lit(True))
    return files.withColumn("folder", F.regexp_extract("path", r"^(.*)/", 1)).withColumn("nr", F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1)


def with_companion(images: DataFrame, others: DataFrame, kind: str, other_kind: str) -> DataFrame:
    """Images with the file of the other kind of the same name, null where there is none."""
    key = F.regexp_replace("path", rf"{kind}([^/]*)$", "*$1")
    right = others.select(F.regexp_replace("path", rf"{other_kind}([^/]*)$", "*$1").alias("key"), F.col("path").alias("companion"))
    return images.withColumn("key", key).join(right, "key", "left").drop("key")


def cloud_to_image(points: DataFrame, bins_h: int, bins_v: int, v_start: float, v_stop: float) -> DataFrame:
    """(path, row, col, dist): the last point, in file order, of each pixel."""
    import math

    from scanfold.functions.geo import regular_bin, to_polar

    yaw, pitch, dist = to_polar(F.col("x"), F.col("y"), F.col("z"))
    p = points.select("path", "nr", dist.alias("dist"), regular_bin(yaw, math.pi, -math.pi, bins_h).alias("col"), regular_bin(pitch, v_start, v_stop, bins_v).alias("row"))
    return p.where("col is not null and row is not null").groupBy("path", "row", "col").agg(F.max_by("dist", "nr").alias("dist"))


def positional(frames: DataFrame, lines: DataFrame, offset: int = 0) -> DataFrame:
    """Frames (nr) with the line (nr) at their place plus ``offset``; missing lines give nulls."""
    return frames.join(lines.withColumn("nr", F.col("nr") - offset), "nr", "left")
