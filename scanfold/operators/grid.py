"""Points in the cells of a regular grid."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanfold.functions.cells import cell_center, cell_index

from . import kdtree

AXES = ("x", "y", "z")
CELL = ("ix", "iy", "iz")


def with_cells(points: DataFrame, extent: float) -> DataFrame:
    """``points`` with the cell (ix, iy, iz) of x, y and z."""
    return points.withColumns({i: cell_index(F.col(a), extent) for i, a in zip(CELL, AXES, strict=True)})


def cell_summary(points: DataFrame, extent: float) -> DataFrame:
    """Count, centroid, centre and mean confidence of each occupied cell."""
    out = with_cells(points, extent).groupBy(*CELL).agg(F.count("*").alias("n"), *[F.avg(a).alias("m" + a) for a in AXES], F.avg("conf").alias("mconf"))
    return out.withColumns({"c" + a: cell_center(F.col(i), extent) for i, a in zip(CELL, AXES, strict=True)})


def last_per_cell(points: DataFrame, extent: float, order: str = "id") -> DataFrame:
    """The last point of each cell in ``order``; combined before the shuffle."""
    p = with_cells(points, extent)
    cols = [c for c in p.columns if c not in CELL]
    return p.groupBy(*CELL).agg(F.max_by(F.struct(*cols), F.col(order)).alias("p")).select(*CELL, "p.*")


def insert_if_empty(kept: DataFrame, added: DataFrame, extent: float) -> DataFrame:
    """``kept`` and those of ``added`` whose cell holds none of ``kept``."""
    used = with_cells(kept, extent).select(*CELL).distinct()
    return with_cells(kept, extent).unionByName(with_cells(added, extent).join(used, list(CELL), "left_anti"))


def offsets(radius: int, dims: Iterable[str] = CELL) -> list[tuple[int, ...]]:
    """All offsets of the cubic neighbourhood, -radius to radius on each axis."""
    out: list[tuple[int, ...]] = [()]
    for _ in dims:
        out = [(*o, d) for o in out for d in range(-radius, radius + 1)]
    return out


def spread(points: DataFrame, radius: int) -> DataFrame:
    """A row of each point for every cell within ``radius`` cells of its own, for an equi-join on cells."""
    around = F.array(*[F.struct(*[F.lit(d).alias(i) for d, i in zip(o, CELL, strict=True)]) for o in offsets(radius)])
    out = points.withColumn("off", F.explode(around))
    return out.withColumns({i: F.col(i) + F.col(f"off.{i}") for i in CELL}).drop("off")


def neighbours(a: DataFrame, b: DataFrame, extent: float, radius: int) -> DataFrame:
    """Pairs (columns of a as a_*, of b as b_*) whose cells are within ``radius`` of each other on each axis."""
    left = with_cells(a.select(*[F.col(c).alias(c) for c in a.columns]), extent)
    left = spread(left, radius).select(*CELL, *[F.col(c).alias("a_" + c) for c in a.columns])
    right = with_cells(b, extent).select(*CELL, *[F.col(c).alias("b_" + c) for c in b.columns])
    return left.join(right, list(CELL)).drop(*CELL)


def nearest_in_cell(a: DataFrame, b: DataFrame, extent: float) -> DataFrame:
    """For each point of ``a`` the nearest of ``b`` in the same cell, ties to the lesser id.

    A search by place and cell, cells apart counting for more than a cell's diagonal: what it finds in another cell is
    dropped. So a crowded cell is split like any other place, and its pairs are not made.
    """
    cols, apart = (*AXES, *CELL), dict.fromkeys(CELL, 2 * extent)
    p, q = (with_cells(d.select("id", *AXES), extent) for d in (a, b))
    # the squared distance holds nothing of the cells where they are equal
    found = kdtree.search(kdtree.index(q, cols, apart), p, 1, same_table=True).where(F.col("d2") < (2 * extent) ** 2)
    best = found.groupBy("id").agg(F.min(F.struct("d2", "near_id")).alias("m"))
    return best.select("id", F.col("m.near_id").alias("near_id"), F.sqrt("m.d2").alias("dist"))


def remove_neighbourhood(points: DataFrame, seeds: DataFrame, extent: float, radius: int = 1) -> DataFrame:
    """``points`` without those within ``radius`` cells of any seed."""
    used = spread(with_cells(seeds, extent).select(*CELL).distinct(), radius).distinct()
    return with_cells(points, extent).join(used, list(CELL), "left_anti")


def decimate(points: DataFrame, extent: float, factor: int) -> DataFrame:
    """Points of the cells whose indices are all multiples of ``factor``."""
    keep = F.lit(True)
    for i in CELL:
        keep = keep & (F.pmod(F.col(i), F.lit(factor)) == 0)
    return with_cells(points, extent).where(keep)


def sample_cells(points: DataFrame, extent: float, per_cell: int) -> DataFrame:
    """Up to ``per_cell`` points of each cell, those of least id: a sample uniform over cells."""
    w = Window.partitionBy(*CELL).orderBy("id")
    return with_cells(points, extent).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_cell)


def elect(points: DataFrame, extent: float, order: str = "id", least_gain: float = 0.3) -> DataFrame:
    """One surface for each cell, elected in order: a new point replaces the held one if it is nearer the centre (L1,
    in cells by 1.5), nearer to its sensor and surer by more than ``least_gain`` in sum. ``hits`` counts all points.

    The outcome depends on the order, so each cell is folded in one task.
    """
    p = with_cells(points, extent).withColumn("range", F.sqrt(sum(F.col(a) ** 2 for a in AXES)))

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        centre = (np.array(key, float) + 0.5) * extent
        off = np.abs(pdf[list(AXES)].to_numpy() - centre).sum(axis=1) / extent
        rng, conf = pdf["range"].to_numpy(), pdf["conf"].to_numpy()
        held = 0
        for i in range(1, len(pdf)):
            gain = (off[held] - off[i]) / 1.5 + (rng[held] - rng[i]) / max(rng[held], 1e-9) + conf[i] - conf[held]
            if gain > least_gain:
                held = i
        return pd.DataFrame({"ix": [key[0]], "iy": [key[1]], "iz": [key[2]], "id": [pdf["id"].iloc[held]], "hits": [len(pdf)]})

    return p.groupBy(*CELL).applyInPandas(fold, "ix int, iy int, iz int, id long, hits long")


def neighbour_cells(points: DataFrame, extent: float, radius: int = 1) -> DataFrame:
    """(ix, iy, iz, n): each occupied cell with the number of occupied cells within ``radius`` on each axis, itself included."""
    cells = with_cells(points, extent).select(*CELL).distinct()
    seen = spread(cells, radius).groupBy(*CELL).agg(F.count("*").alias("n"))
    return cells.join(seen, list(CELL))
