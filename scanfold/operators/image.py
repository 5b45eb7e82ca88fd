"""Stencils over range images: long tables (frame, row, col, dist), a missing distance is null.

Frames are independent, so every window is partitioned by frame and the engine scales with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfold.functions.soft import connectivity


def along(rows: DataFrame, axis: str = "col") -> Window:
    """Order along one axis within a frame and, if there is one, the other axis."""
    other = [c for c in ("row", "col") if c != axis and c in rows.columns]
    return Window.partitionBy("frame", *other).orderBy(axis)


def far_filter(rows: DataFrame, most: float) -> DataFrame:
    """Distances above ``most`` become missing."""
    return rows.withColumn("dist", F.when(F.col("dist") <= most, F.col("dist")))


def edge_mask(rows: DataFrame, margin: int, columns: int) -> DataFrame:
    """The first and last ``margin`` columns (from 1) become missing."""
    return rows.withColumn("dist", F.when((F.col("col") > margin) & (F.col("col") <= columns - margin), F.col("dist")))


def fill_gaps(rows: DataFrame, pixels: int, slope: float, axis: str = "col") -> DataFrame:
    """Holes narrower than ``pixels`` between two returns are filled linearly where the signed slope is at most
    ``slope``; the last filled pixel equals the far end."""
    w = along(rows, axis)
    at = F.when(F.col("dist").isNotNull(), F.col(axis))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    r = rows.withColumns({
        "d0": F.last("dist", True).over(back), "c0": F.last(at, True).over(back),
        "d1": F.first("dist", True).over(ahead), "c1": F.first(at, True).over(ahead),
    })
    gap = F.col("c1") - F.col("c0") - 1
    step = F.when(gap > 0, (F.col("d1") - F.col("d0")) / gap)
    filled = F.when((gap < pixels) & (step <= slope), F.col("d0") + step * (F.col(axis) - F.col("c0")))
    return r.withColumn("dist", F.coalesce("dist", filled)).drop("d0", "d1", "c0", "c1")


def smooth(rows: DataFrame, most: float) -> DataFrame:
    """Mean of each return and those of its four neighbours that differ by less than ``most``."""
    near = []
    for axis in ("row", "col"):
        if axis in rows.columns:
            w = along(rows, axis)
            near += [F.lag("dist").over(w), F.lead("dist").over(w)]
    r = rows.withColumn("near", F.filter(F.array(*near), lambda d: F.abs(d - F.col("dist")) < most))
    mean = (F.aggregate("near", F.col("dist"), lambda s, d: s + d)) / (F.size("near") + 1)
    return r.withColumn("dist", F.when(F.col("dist").isNotNull(), mean)).drop("near")


def derivative(rows: DataFrame, axis: str = "col", name: str = "d") -> DataFrame:
    """Difference to the next pixel along an axis, null where either is missing."""
    return rows.withColumn(name, F.col("dist") - F.lead("dist").over(along(rows, axis)))


def frame_difference(rows: DataFrame) -> DataFrame:
    """Difference to the same pixel of the frame before."""
    key = [c for c in ("row", "col") if c in rows.columns]
    return rows.withColumn("change", F.col("dist") - F.lag("dist").over(Window.partitionBy(*key).orderBy("frame")))


def upper_median(values: Column) -> Column:
    """The upper median of an array's non-null values."""
    v = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    return F.try_element_at(v, (F.floor(F.size(v) / 2) + 1).cast("int"))


def median4(rows: DataFrame) -> DataFrame:
    """Upper median of each return and its neighbours along the axes there are; missing stays missing."""
    near = [F.col("dist")]
    for axis in ("row", "col"):
        if axis in rows.columns:
            w = along(rows, axis)
            near += [F.lag("dist").over(w), F.lead("dist").over(w)]
    return rows.withColumn("median", F.when(F.col("dist").isNotNull(), upper_median(F.array(*near))))


def connections(rows: DataFrame, axis: str = "col", name: str = "weight", **parameters: float) -> DataFrame:
    """Weight of the connection of each pixel with the next along an axis."""
    w = along(rows, axis)
    nxt = F.lead("dist").over(w)
    left = F.lag("dist").over(w) - F.col("dist")
    right = nxt - F.lead("dist", 2).over(w)
    r = rows.withColumns({"nxt": nxt, "left_d": left, "right_d": right})
    return r.withColumn(name, connectivity(F.col("dist"), F.col("nxt"), F.col("left_d"), F.col("right_d"), **parameters)).drop("nxt", "left_d", "right_d")


def match_features(rows: DataFrame, most: float = 5.0) -> DataFrame:
    """Differences to the pixels one before and two after on both axes, held to +-most; a missing one counts as most."""
    out = {}
    for axis in ("col", "row"):
        w = along(rows, axis)
        for name, other in (("before", F.lag("dist").over(w)), ("after", F.lead("dist", 2).over(w))):
            diff = other - F.col("dist")
            out[f"{axis}_{name}"] = F.when(diff.isNull(), most).otherwise(F.least(F.greatest(diff, F.lit(-most)), F.lit(most)))
    return rows.withColumns(out)


def nearest_per_pixel(projected: DataFrame, tolerance: float) -> DataFrame:
    """Rows (px, py, dist, ...) that are not hidden: at most ``tolerance`` of its distance behind the nearest of a pixel."""
    w = Window.partitionBy("px", "py")
    return projected.withColumn("front", F.min("dist").over(w)).where(F.col("dist") <= F.col("front") * (1 + tolerance))


def preprocess(rows: DataFrame, most: float = 50.0, pixels_h: int = 5, pixels_v: int = 2, slope: float = 0.2, near: float = 0.5) -> DataFrame:
    """Far filter, horizontal then vertical gap filling and smoothing, in this order."""
    out = far_filter(rows, most).transform(fill_gaps, pixels_h, slope, "col")
    if "row" in rows.columns:
        out = out.transform(fill_gaps, pixels_v, slope, "row")
    return out.transform(smooth, near)


def median_square(rows: DataFrame, radius: int) -> DataFrame:
    """Upper median of each return over the square of ``radius`` pixels around it, cut at the border; missing stays
    missing. All pixels of an image are rows, missing returns with a null ``dist``."""
    across = Window.partitionBy("frame", "row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy("frame", "col").orderBy("row").rangeBetween(-radius, radius)
    r = rows.withColumn("near", F.collect_list("dist").over(across))
    return r.withColumn("median", F.when(F.col("dist").isNotNull(), upper_median(F.flatten(F.collect_list("near").over(down))))).drop("near")


def elementwise(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest and least of the returns of two images at the same pixel, a missing one left aside."""
    both = a.select(*keys, F.col("dist").alias("da")).join(b.select(*keys, F.col("dist").alias("db")), keys)
    return both.select(*keys, F.greatest("da", "db").alias("most"), F.least("da", "db").alias("least"))


def binarised(rows: DataFrame, name: str = "weight", least: float = 0.5) -> DataFrame:
    """Connections as 1.0 from ``least`` on and else 0.0."""
    return rows.withColumn(name, (F.col(name) >= least).cast("double"))
