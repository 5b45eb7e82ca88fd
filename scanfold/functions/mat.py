"""3 x 3 matrices as arrays of nine doubles in row-major order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cells(m: Column) -> list[Column]:
    return [m.getItem(i) for i in range(9)]


def _cofactors(e: list[Column]) -> list[Column]:
    """Cofactor of each cell: rows and columns taken cyclically carry the signs."""
    at = lambda r, c: e[3 * (r % 3) + c % 3]
    return [at(r + 1, c + 1) * at(r + 2, c + 2) - at(r + 1, c + 2) * at(r + 2, c + 1) for r in range(3) for c in range(3)]


def determinant(m: Column) -> Column:
    e = _cells(m)
    return sum((e[i] * k for i, k in enumerate(_cofactors(e)[1:3], 1)), e[0] * _cofactors(e)[0])


def inverse(m: Column) -> Column:
    """The inverse, null where the determinant is 0."""
    k, d = _cofactors(_cells(m)), determinant(m)
    return F.when(d != 0, F.array(*[k[3 * c + r] / d for r in range(3) for c in range(3)]))


def ridged(m: Column, ridge: float) -> Column:
    """The matrix with ``ridge`` added on its diagonal."""
    return F.transform(m, lambda x, i: x + F.when(i % 4 == 0, F.lit(ridge)).otherwise(0.0))


def orthonormalised(m: Column, rounds: int = 12) -> Column:
    """The rotation of the polar decomposition: the matrix and its transposed inverse averaged until they agree."""

    def step(a: Column, _: Column) -> Column:
        e = _cells(a)
        k = _cofactors(e)
        d = e[0] * k[0] + e[1] * k[1] + e[2] * k[2]
        return F.array(*[(x + c / d) / 2 for x, c in zip(e, k, strict=True)])

    return F.when(determinant(m) != 0, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), m, step))


def eigenvalues(m: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric matrix, greatest first, by the trigonometric solution of its cubic."""
    e = _cells(m)
    mean = (e[0] + e[4] + e[8]) / 3
    off = e[1] * e[1] + e[2] * e[2] + e[5] * e[5]
    p = F.sqrt(((e[0] - mean) * (e[0] - mean) + (e[4] - mean) * (e[4] - mean) + (e[8] - mean) * (e[8] - mean) + 2 * off) / 6)
    b = F.array(*[F.when(p > 0, (x - mean if i % 4 == 0 else x) / p).otherwise(0.0) for i, x in enumerate(e)])
    turn = F.acos(F.greatest(F.least(determinant(b) / 2, F.lit(1.0)), F.lit(-1.0))) / 3
    first, last = mean + 2 * p * F.cos(turn), mean + 2 * p * F.cos(turn + 2 * math.pi / 3)
    return first, 3 * mean - first - last, last


def ellipsoid(m: Column, factor: float = 1.0, least: float = 1e-4, most: float = 50.0) -> tuple[Column, ...]:
    """Half axes of a covariance's ellipsoid, greatest first, each held between ``least`` and ``most``."""
    return tuple(F.greatest(F.least(factor * F.sqrt(F.greatest(v, F.lit(0.0))), F.lit(most)), F.lit(least)) for v in eigenvalues(m))


def times(m: Column, v: tuple[Column, ...]) -> tuple[Column, ...]:
    e = _cells(m)
    return tuple(e[3 * r] * v[0] + e[3 * r + 1] * v[1] + e[3 * r + 2] * v[2] for r in range(3))
