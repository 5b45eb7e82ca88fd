"""Nearest neighbours over a k-d split, radius joins by cells, and what is computed from matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kdtree
from .grid import AXES, neighbours

def squared(cols: tuple[str, ...] = AXES, weights: dict[str, float] | None = None) -> Column:
    """Squared distance of a_* and b_* columns, each weighted."""
    w = weights or {}
    return sum(((F.col("a_" + c) - F.col("b_" + c)) * F.lit(w.get(c, 1.0))) ** 2 for c in cols)


def knn(queries: DataFrame, points: DataFrame, k: int, same_table: bool = True, extra: dict[str, float] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, near_id, d2, nth) of the k nearest points of each query by x, y, z and the ``extra`` columns, with their weights
    and those of the axes in ``weights``; fewer only where the table has fewer points.

    Ties go to the lesser id. With ``same_table`` a point is not its own neighbour. Rows with a null or non-finite value in
    any of the columns are left out. To search a table repeatedly, see ``index`` and ``search`` of ``kdtree``.
    """
    return kdtree.search(kdtree.index(points, (*AXES, *(extra or {})), {**(weights or {}), **(extra or {})}, k), queries, k, same_table)


def map_matches(scan: DataFrame, surface: DataFrame, centre: tuple[float, float, float], reach: float, k: int = 1, stretch: float = 2.0) -> DataFrame:
    """(id, near_id, dist, w, nth): the ``k`` nearest of the surface points within ``reach`` of the scan's centre, in place,
    heights stretched, and normal. ``dist`` is the true distance; a match weighs as much less as it is farther than the first."""
    at = sum((F.col(a) - F.lit(float(c))) ** 2 for a, c in zip(AXES, centre, strict=True))
    near_by = surface.where(at < F.lit(float(reach) ** 2))
    m = matched(scan, near_by, knn(scan, near_by, k, False, {"n" + a: 1.0 for a in AXES}, {"z": stretch}))
    m = m.withColumn("dist", F.sqrt(squared()))
    first = F.min(F.when(F.col("nth") == 1, F.col("dist"))).over(Window.partitionBy("id"))
    return m.select("id", "near_id", "dist", F.least(F.lit(1.0), first / F.greatest(F.col("dist"), F.lit(1e-8))).alias("w"), "nth")


def radius_pairs(points: DataFrame, radius: float, apart: int = 0) -> DataFrame:
    """Ordered pairs (a_id, b_id, d2) within ``radius`` whose ids differ by at least ``apart``."""
    p = neighbours(points.select("id", *AXES), points.select("id", *AXES), radius, 1).where("a_id <> b_id")
    p = p.withColumn("d2", squared()).where(F.col("d2") <= radius * radius)
    return p.where(F.abs(F.col("a_id") - F.col("b_id")) >= apart).select("a_id", "b_id", "d2")


def radius_count(points: DataFrame, radius: float) -> DataFrame:
    """Number of others within ``radius`` of each point."""
    n = radius_pairs(points, radius).groupBy("a_id").agg(F.count("*").alias("n"))
    return points.select("id").join(n.withColumnRenamed("a_id", "id"), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def correspondence_weight(d: Column, first: Column, half: float) -> Column:
    """Weight of a match at distance ``d``: halves every ``half``, by ``first`` / d beyond the first, 0 past the cutoff."""
    most = F.lit(half) / F.log(F.lit(2.0))
    w = F.exp(-d / most) * F.when(d > first, first / d).otherwise(1.0)
    return F.when(d > most, 0.0).otherwise(w)


def plane_distance(n: tuple[Column, ...], a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Signed distance of a from the plane through b with unit normal n."""
    return sum(x * (p - q) for x, p, q in zip(n, a, b, strict=True))


def matched(queries: DataFrame, points: DataFrame, near: DataFrame) -> DataFrame:
    """Rows of ``knn`` with the columns of both ends as a_* and b_*."""
    a = queries.select(F.col("id"), *[F.col(c).alias("a_" + c) for c in queries.columns if c != "id"])
    b = points.select(F.col("id").alias("near_id"), *[F.col(c).alias("b_" + c) for c in points.columns if c != "id"])
    return near.join(a, "id").join(b, "near_id")


def project_on_planes(m: DataFrame) -> DataFrame:
    """Each query moved onto its neighbour's plane: (id, near_id, off, px, py, pz)."""
    n, a, b = (tuple(F.col(p + c) for c in AXES) for p in ("b_n", "a_", "b_"))
    off = plane_distance(n, a, b)
    return m.select("id", "near_id", off.alias("off"), *[(x - off * y).alias("p" + c) for x, y, c in zip(a, n, AXES, strict=True)])


def registration_error(m: DataFrame, half: float) -> DataFrame:
    """Weighted mean point-to-plane and point-to-point distances over first neighbours, null under a weight of 0.001."""
    n, a, b = (tuple(F.col(p + c) for c in AXES) for p in ("b_n", "a_", "b_"))
    d = F.sqrt("d2")
    rows = m.where("nth = 1").select(correspondence_weight(d, d, half).alias("w"), d.alias("d"), F.abs(plane_distance(n, a, b)).alias("off"))
    s = rows.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("off")).alias("plane"), F.sum(F.col("w") * F.col("d")).alias("point"))
    return s.select("w", *[F.when(F.col("w") >= 0.001, F.col(c) / F.col("w")).alias(f"mean_{c}") for c in ("plane", "point")])


def plane_shift(points: DataFrame, extent: float, radius: int = 1, most: float = 0.5, least: int = 3) -> DataFrame:
    """Shift of each point along its normal towards the planes of its neighbours: (id, n, shift), shift null where it is
    not below ``most`` or there are fewer than ``least`` neighbours that agree."""
    p = neighbours(points, points, extent, radius).where("a_id <> b_id")
    n, m = tuple(F.col("a_n" + c) for c in AXES), tuple(F.col("b_n" + c) for c in AXES)
    cos = sum(x * y for x, y in zip(n, m, strict=True))
    off = plane_distance(m, tuple(F.col("a_" + c) for c in AXES), tuple(F.col("b_" + c) for c in AXES))
    p = p.select("a_id", cos.alias("c"), off.alias("b"), F.exp(-F.sqrt(F.sqrt(squared()))).alias("wd")).where("c > 0")
    p = p.withColumn("w", F.col("wd") * F.col("c") * F.col("c"))
    s = p.groupBy("a_id").agg(F.count("*").alias("n"), F.sum(F.col("c") * F.col("w") * F.col("b")).alias("g"), F.sum(F.col("c") * F.col("w") * F.col("c")).alias("h"))
    shift = -F.col("g") / F.col("h")
    return s.select(F.col("a_id").alias("id"), "n", F.when((F.col("n") >= least) & (F.abs(shift) < most), shift).alias("shift"))
