"""Text formats: delimited lines, point streams, trajectories, map surfaces and track results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAP_COLUMNS = ("pose", "x", "y", "z", "ox", "oy", "oz", "nx", "ny", "nz", "conf", "range", "hits", "intensity")


def read_delimited(spark: SparkSession, path: str, separators: str = " ;", comment: str = "#", empty_fields: bool = False) -> DataFrame:
    """(path, fields) of each line that is neither empty nor a comment, split at any of the separators."""
    cls = "[" + "".join("\\" + c for c in separators) + "]" + ("" if empty_fields else "+")
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), F.rtrim("value").alias("value"))
    rows = rows.where((F.col("value") != "") & ~F.col("value").startswith(comment))
    return rows.select("path", F.split("value", cls).alias("fields"))


def field(index: int, kind: str = "double") -> Column:
    """A line's field, from 0, as a type; null where it is missing or of another form."""
    return F.try_element_at("fields", F.lit(index + 1)).try_cast(kind)


def field_counts(lines: DataFrame) -> DataFrame:
    """(path, lines, least): number of lines and least number of fields of each file."""
    return lines.groupBy("path").agg(F.count("*").alias("lines"), F.min(F.size("fields")).alias("least"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """Map surfaces; files without hit counts have 1, without intensity 0."""
    lines = read_delimited(spark, path, " ")
    out = lines.select("path", *[field(i).alias(c) for i, c in enumerate(MAP_COLUMNS)])
    return out.withColumns({"pose": F.col("pose").cast("int"), "hits": F.coalesce("hits", F.lit(1)).cast("int"), "intensity": F.coalesce("intensity", F.lit(0)).cast("smallint")})


def map_lines(surfaces: DataFrame, kind: str = "surfaces") -> DataFrame:
    """Text lines of surfaces, of points or of points with intensity."""
    cols = {"surfaces": MAP_COLUMNS, "points": ("x", "y", "z"), "intensities": ("x", "y", "z", "intensity")}[kind]
    return surfaces.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]).alias("value"))


def read_point_stream(spark: SparkSession, path: str, intensity: bool = False) -> DataFrame:
    """(path, nr, x, y, z[, i]) of files of numbers without line structure, three or four to a point."""
    stride = 4 if intensity else 3
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("t"))
    one = text.select("path", "t", F.explode(F.sequence(F.lit(0), (F.size("t") / stride).cast("int") - 1)).alias("nr")).where(F.size("t") >= stride)
    at = lambda k: F.try_element_at("t", F.col("nr") * stride + k + 1).try_cast("double")
    return one.select("path", "nr", *[at(k).alias(c) for k, c in enumerate("xyzi"[:stride])])


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """(path, ts_ns, htm): a stamp and 16 row-major numbers a line."""
    return read_delimited(spark, path).select("path", field(0, "bigint").alias("ts_ns"), F.array(*[field(i + 1) for i in range(16)]).alias("htm"))


def trajectory_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(" ", F.col("ts_ns").cast("string"), F.transform("htm", lambda x: x.cast("string"))).alias("value"))


def track_lines(tracks: DataFrame, points: DataFrame) -> DataFrame:
    """(frame, uid, value): ``[uid] age last r g b state covariance vips points (px py pz nx ny nz conf)*``, marked points
    first. ``tracks`` has frame, uid, age, last_update, r, g, b, x and p; ``points`` frame, uid, vip, nr and the seven numbers."""
    seven = [F.col(c).cast("string") for c in ("px", "py", "pz", "nx", "ny", "nz", "conf")]
    each = points.select("frame", "uid", "vip", "nr", F.concat_ws(" ", *seven).alias("s"))
    lists = each.groupBy("frame", "uid").agg(F.count_if("vip").alias("vips"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((~F.col("vip")).alias("k"), "nr", "s"))).alias("l"))
    text = lambda c: F.concat_ws(" ", F.transform(c, lambda x: x.cast("string")))
    row = tracks.join(lists, ["frame", "uid"], "left")
    head = [F.concat(F.lit("["), F.col("uid").cast("string"), F.lit("]")), *[F.col(c).cast("string") for c in ("age", "last_update", "r", "g", "b")]]
    tail = [F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("vips", "n")]
    return row.select("frame", "uid", F.concat_ws(" ", *head, text("x"), text("p"), *tail, F.concat_ws(" ", F.transform("l", lambda s: s["s"]))).alias("value"))


def parse_tracks(lines: DataFrame, n: int = 12) -> DataFrame:
    """Tracks of result lines (value): uid, age, last_update, r, g, b, x, p, vips and points (structs of seven numbers)."""
    t = lines.select(F.split(F.rtrim("value"), r"\s+").alias("fields"))
    numbers = lambda a, k: F.transform(F.slice("fields", a + 1, k), lambda x: x.try_cast("double"))
    base = 6 + n + n * n
    count = F.coalesce(field(base + 1, "int"), F.lit(0))
    rest = F.transform(F.slice("fields", base + 3, F.greatest(count * 7, F.lit(0))), lambda x: x.try_cast("double"))
    names = ("px", "py", "pz", "nx", "ny", "nz", "conf")
    out = t.select(
        F.regexp_extract(F.element_at("fields", 1), r"\[(\d+)\]", 1).try_cast("bigint").alias("uid"), *[field(i + 1, "int").alias(c) for i, c in enumerate(("age", "last_update", "r", "g", "b"))],
        numbers(6, n).alias("x"), numbers(6 + n, n * n).alias("p"), field(base, "int").alias("vips"), count.alias("n"), rest.alias("rest"),
    )
    pts = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(*[F.try_element_at("rest", i * 7 + k + 1).alias(c) for k, c in enumerate(names)])))
    return out.withColumn("points", F.coalesce(pts, F.array().cast("array<struct<px:double,py:double,pz:double,nx:double,ny:double,nz:double,conf:double>>"))).drop("rest", "n")


def training_lines(rows: DataFrame) -> DataFrame:
    """Tab-separated features, an arrow and the label, from (f, label)."""
    return rows.select(F.concat(F.concat_ws("\t", F.transform("f", lambda x: x.cast("string"))), F.lit("\t-->\t"), F.col("label").cast("string")).alias("value"))


def normalizer_line(fit: DataFrame, clip: bool = True) -> DataFrame:
    """One line: number of dimensions, their bounds and whether values are clipped, from (dim, lo, hi)."""
    all_dims = fit.agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("l"))
    bounds = F.flatten(F.transform("l", lambda s: F.array(s["lo"].cast("string"), s["hi"].cast("string"))))
    return all_dims.select(F.concat_ws(" ", F.size("l").cast("string"), bounds, F.lit(str(int(clip)))).alias("value"))


def parse_normalizer(lines: DataFrame) -> DataFrame:
    """(dim, lo, hi) of a normaliser's ``fields``."""
    t = lines.select("fields", F.explode(F.sequence(F.lit(0), F.element_at("fields", 1).cast("int") - 1)).alias("dim"))
    return t.select("dim", *[F.element_at("fields", F.col("dim") * 2 + k).cast("double").alias(c) for k, c in ((2, "lo"), (3, "hi"))])
