"""Uncertainty: deviations of normals by simulation, point covariances and covariances of registrations."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions.vec import cross3, norm3

from .energies import Energy
from .icp import rotation_from

#: The table covers side lengths up to SIDE_MOST metres at a distance of 10 m in BINS steps on both axes.
BINS = 80
SIDE_MOST = 4.0
REFERENCE = 10.0


def simulate_sigma(a: float, b: float, noise: float, draws: int, rng: np.random.Generator) -> float:
    """Mean angle between the normal of a right-angled corner with sides a and b and that of its noisy copies."""
    corner, one, two = rng.normal(0, noise, (3, draws, 3))
    n = np.cross(one + [a, 0, 0] - corner, two + [0, b, 0] - corner)
    size = np.linalg.norm(n, axis=1)
    return float(np.arccos(np.clip(n[:, 2] / np.maximum(size, 1e-12), -1, 1)).mean())


def sigma_table(spark: SparkSession, noise: float = 0.015, draws: int = 1000, bins: int = BINS, most: float = SIDE_MOST, seed: int = 42) -> DataFrame:
    """(i, j, sigma) for sides at the centres of bins i and j. Each cell has a generator of its own seed and cell, so
    the table is the same however it is partitioned."""

    def run(batches):
        for pdf in batches:
            cells = [(int(k) // bins, int(k) % bins) for k in pdf["id"]]
            sig = [simulate_sigma((i + 0.5) * most / bins, (j + 0.5) * most / bins, noise, draws, np.random.default_rng([seed, i, j])) for i, j in cells]
            yield pd.DataFrame({"i": [c[0] for c in cells], "j": [c[1] for c in cells], "sigma": sig})

    return spark.range(bins * bins).mapInPandas(run, "i int, j int, sigma double")


def with_sigma(rows: DataFrame, table: DataFrame, bins: int = BINS, most: float = SIDE_MOST) -> DataFrame:
    """``rows`` (dist, side_a, side_b) with the table's sigma for the sides scaled to REFERENCE metres, pi / 2 outside.

    The table has bins * bins rows whatever the input, so it is broadcast."""
    cell = lambda c: F.floor(F.try_divide(F.col(c) * REFERENCE, F.col("dist")) / (most / bins)).cast("int")
    r = rows.withColumns({"i": cell("side_a"), "j": cell("side_b")}).join(F.broadcast(table), ["i", "j"], "left")
    return r.withColumn("sigma", F.coalesce("sigma", F.lit(np.pi / 2))).drop("i", "j")


def point_covariance(x: Column, y: Column, z: Column, range_sigma: float, angle_sigma: float) -> Column:
    """Nine numbers, row-major: the covariance of a point measured with deviations along and across its ray."""
    d2 = x * x + y * y + z * z
    along, across = F.lit(range_sigma**2), d2 * F.lit(angle_sigma**2)
    p = (x, y, z)
    return F.array(*[F.try_divide(p[i] * p[j], d2) * (along - across) + (across if i == j else F.lit(0.0)) for i in range(3) for j in range(3)])


def propagated(f: Callable[[list[Column]], list[Column]], mean: list[Column], root: list[list[Column]], spread: float = 1.0) -> list[list[Column]]:
    """Covariance of ``f`` at ``mean`` from sigma points: the mean plus and minus each column of ``root`` times ``spread``.

    ``root`` is a square root of the inputs' covariance, by columns. The mean of the squares about f(mean) is taken over
    all 2n points, so a ``spread`` of sqrt(n) gives a linear map's covariance exactly, and 1 an n-th of it.
    """
    base = f(mean)
    apart = []
    for column in root:
        for sign in (spread, -spread):
            apart.append([a - b for a, b in zip(f([m + sign * c for m, c in zip(mean, column, strict=True)]), base, strict=True)])
    return [[sum(p[i] * p[j] for p in apart) / len(apart) for j in range(len(base))] for i in range(len(base))]


def normal_covariance(dist: Column, across: Column, above: Column, range_sigma: float = 0.015, angle_sigmas: tuple[float, float] = (0.0015, 0.00017), steps: tuple[float, float] = (0.0072, 0.0075)) -> list[list[Column]]:
    """Covariance, 3 x 3, of the unit normal at a pixel from its distance and those of its neighbours beside and above.

    Twelve sigma points: each neighbour's range and its two angles vary by a deviation. The pixel itself is the origin; the
    neighbour above is lifted by the first of ``steps`` and the one beside moved by the second, as in the tables of normals.
    """
    zero = F.lit(0.0)
    top, left = [above, zero, above * math.sin(steps[0])], [across, across * math.sin(steps[1]), zero]
    turn = [math.sin(a) for a in angle_sigmas]

    def normal(v: list[Column]) -> list[Column]:
        a, b = ([v[k] - dist, v[k + 1], v[k + 2]] for k in (0, 3))
        n = cross3(a, b)
        size = norm3(n)
        return [F.try_divide(c, size) for c in n]

    roots = [F.lit(range_sigma), F.abs(above * turn[0]), F.abs(above * turn[1]), F.lit(range_sigma), F.abs(across * turn[0]), F.abs(across * turn[1])]
    return propagated(normal, [*top, *left], [[r if i == k else zero for i in range(6)] for k, r in enumerate(roots)])


#: Turns and shifts of the lattice at which an energy is sampled.
TURNED, SHIFTED = math.pi / 8, 1.0


def lattice() -> list[tuple[float, ...]]:
    """The 63 corners other than the origin of the cube of moves (roll, pitch, yaw, x, y, z)."""
    return [tuple(s * (TURNED if i < 3 else SHIFTED) for i, s in enumerate(c)) for c in itertools.product((0, 1), repeat=6) if any(c)]


def sampled_covariance(m: DataFrame, energy: Energy) -> DataFrame:
    """(i, j, value): the 6 x 6 covariance of a registration from its energy at the moves of ``lattice``.

    One pass over the matches (a_*, b_*, b_n*, b_sigma, b_conf, w) gives the mean energy at all moves. Each move is scaled
    to where a quadratic energy would have risen by five times that of the matches as they are; the covariance is that of
    the scaled moves. No rows without weight.
    """
    moves = [(0.0,) * 6, *lattice()]
    a, b, n = ([F.col(p + c) for c in "xyz"] for p in ("a_", "b_", "b_n"))
    sums = []
    for k, x in enumerate(moves):
        r = rotation_from(np.array(x[:3]))
        d = [sum((F.lit(float(r[i, j])) * a[j] for j in range(3)), F.lit(x[3 + i])) - b[i] for i in range(3)]
        sums.append(F.sum(F.col("w") * energy.value(d, n, F.col("b_sigma"), F.col("b_conf"))).alias(f"e{k}"))
    mean = m.agg(F.sum("w").alias("w"), *sums).where("w > 0").select(*[(F.abs(F.col(f"e{k}")) / F.col("w")).alias(f"e{k}") for k in range(len(moves))])
    base = F.col("e0")
    scales = F.array(*[5 * base / F.greatest(base / 500, F.col(f"e{k}") - base) for k in range(1, len(moves))])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.array(*[F.lit(x[i] * x[j] / (len(moves) - 2)) for x in moves[1:]]).alias("c")) for i in range(6) for j in range(6)])
    rows = mean.select(scales.alias("s"), F.explode(cells).alias("v"))
    return rows.select("v.i", "v.j", F.aggregate(F.zip_with("s", "v.c", lambda s, c: s * c), F.lit(0.0), lambda t, x: t + x).alias("value"))


def estimated_covariance(h: np.ndarray, mean_energy: float, ridge: float = 1e-5) -> np.ndarray:
    """Covariance of a pose from the Hessian of its energy: the inverse times twice the mean energy, 0.001 at least."""
    return np.linalg.inv(h + ridge * np.eye(6)) * max(0.001, 2 * mean_energy)
