"""Energies of a match as functions of the move that is sought.

A move turns a point by small angles about x, y and z and shifts it. To first order the gap d between the moved point and
its match is linear in these six numbers, so an energy that is known as a function of d, with its slope and curvature
there, has a gradient J'e and a full Hessian J'EJ in the move. Each energy is an object that gives value, slope and
curvature as columns of d, the match's normal, its deviation and its confidence.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.functions.vec import dot3

#: Indices of the upper triangles of symmetric 3 x 3 and 6 x 6 matrices.
THREE = [(i, j) for i in range(3) for j in range(i, 3)]
SIX = [(i, j) for i in range(6) for j in range(i, 6)]
#: Least deviation of a normal, and squared gap under which points count as equal.
SIGMA_LEAST = 0.01
SAME = 1e-4

Vector = Sequence[Column]


class Energy:
    """Override ``value``, ``slope`` (three columns) and ``curvature`` (six, as in THREE)."""

    def value(self, d: Vector, n: Vector, sigma: Column, conf: Column) -> Column:
        raise NotImplementedError

    def slope(self, d: Vector, n: Vector, sigma: Column, conf: Column) -> list[Column]:
        raise NotImplementedError

    def curvature(self, d: Vector, n: Vector, sigma: Column, conf: Column) -> list[Column]:
        raise NotImplementedError


class PointToPoint(Energy):
    """d'd."""

    def value(self, d, n, sigma, conf):
        return dot3(d, d)

    def slope(self, d, n, sigma, conf):
        return [2 * c for c in d]

    def curvature(self, d, n, sigma, conf):
        return [F.lit(2.0 if i == j else 0.0) for i, j in THREE]


class PointToPlane(Energy):
    """(d'n)^2."""

    def value(self, d, n, sigma, conf):
        return dot3(d, n) ** 2

    def slope(self, d, n, sigma, conf):
        return [2 * dot3(d, n) * c for c in n]

    def curvature(self, d, n, sigma, conf):
        return [2 * n[i] * n[j] for i, j in THREE]


@dataclass(frozen=True)
class PointToNoisyPlane(Energy):
    """(d'n)^2 / (d'd)^power / deviation: the sine of the angle between gap and plane, squared, where power is 1.
    Points closer than a centimetre have none."""

    power: float = 1.0

    def _parts(self, d, n, sigma):
        return 1 / F.greatest(sigma, F.lit(SIGMA_LEAST)), dot3(d, n), dot3(d, d)

    def _unless_same(self, r: Column, c: Column) -> Column:
        return F.when(r < SAME, 0.0).otherwise(c)

    def value(self, d, n, sigma, conf):
        a, s, r = self._parts(d, n, sigma)
        return self._unless_same(r, a * s * s / r**self.power)

    def slope(self, d, n, sigma, conf):
        a, s, r = self._parts(d, n, sigma)
        e = self.power
        return [self._unless_same(r, 2 * a * s / r**e * (m - e * s / r * c)) for m, c in zip(n, d, strict=True)]

    def curvature(self, d, n, sigma, conf):
        a, s, r = self._parts(d, n, sigma)
        e = self.power
        out = []
        for i, j in THREE:
            c = n[i] * n[j] - 2 * e * s / r * (n[i] * d[j] + d[i] * n[j]) + 2 * e * (e + 1) * s * s / (r * r) * d[i] * d[j]
            out.append(self._unless_same(r, 2 * a / r**e * (c - e * s * s / r if i == j else c)))
        return out


@dataclass(frozen=True)
class Blend(Energy):
    """``sure`` as far as the match's normal is trusted, ``unsure`` for the rest."""

    sure: Energy
    unsure: Energy

    def _mixed(self, conf, a, b):
        return conf * a + (1 - conf) * b

    def value(self, d, n, sigma, conf):
        return self._mixed(conf, self.sure.value(d, n, sigma, conf), self.unsure.value(d, n, sigma, conf))

    def slope(self, d, n, sigma, conf):
        return [self._mixed(conf, a, b) for a, b in zip(self.sure.slope(d, n, sigma, conf), self.unsure.slope(d, n, sigma, conf), strict=True)]

    def curvature(self, d, n, sigma, conf):
        return [self._mixed(conf, a, b) for a, b in zip(self.sure.curvature(d, n, sigma, conf), self.unsure.curvature(d, n, sigma, conf), strict=True)]


@dataclass(frozen=True)
class Either(Energy):
    """``first`` where the boolean column ``when`` holds, ``second`` elsewhere: the choice may differ by track."""

    when: str
    first: Energy
    second: Energy

    def _chosen(self, a: Column, b: Column) -> Column:
        return F.when(F.col(self.when), a).otherwise(b)

    def value(self, d, n, sigma, conf):
        return self._chosen(self.first.value(d, n, sigma, conf), self.second.value(d, n, sigma, conf))

    def slope(self, d, n, sigma, conf):
        return [self._chosen(a, b) for a, b in zip(self.first.slope(d, n, sigma, conf), self.second.slope(d, n, sigma, conf), strict=True)]

    def curvature(self, d, n, sigma, conf):
        return [self._chosen(a, b) for a, b in zip(self.first.curvature(d, n, sigma, conf), self.second.curvature(d, n, sigma, conf), strict=True)]


def _jacobian(p: Vector) -> list[list[Column | None]]:
    """Rows x, y, z of the derivative of a gap by the three angles and the three shifts; None is zero."""
    one = F.lit(1.0)
    return [[None, p[2], -p[1], one, None, None], [-p[2], None, p[0], None, one, None], [p[1], -p[0], None, None, None, one]]


def approximation(energy: Energy, carry: Sequence[str] = (), centre: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """From matches (a_*, b_*, b_n*, b_sigma, b_conf, w) to the columns ``carry``, w, e and its gradient g0..g5 and Hessian
    h00..h55 (upper triangle) in a move of a_* about the columns ``centre``, or about the origin. The columns are made once."""
    mid = [F.col(c) for c in centre] or [F.lit(0.0)] * 3
    gaps = [(F.col("a_" + c) - F.col("b_" + c)).alias("d" + c) for c in "xyz"]
    from_mid = [(F.col("a_" + c) - k).alias("p" + c) for c, k in zip("xyz", mid, strict=True)]
    chosen = [energy.when] if isinstance(energy, Either) else []
    at = ([F.col("d" + c) for c in "xyz"], [F.col("b_n" + c) for c in "xyz"], F.col("b_sigma"), F.col("b_conf"))
    terms = [energy.value(*at).alias("e"), *[c.alias(f"s{i}") for i, c in enumerate(energy.slope(*at))], *[c.alias(f"c{i}{j}") for (i, j), c in zip(THREE, energy.curvature(*at), strict=True)]]
    jac = _jacobian([F.col("p" + c) for c in "xyz"])
    curve = {(i, j): F.col(f"c{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    g = [sum((jac[r][k] * F.col(f"s{r}") for r in range(3) if jac[r][k] is not None), F.lit(0.0)).alias(f"g{k}") for k in range(6)]
    # the curvature times the Jacobian first: it is needed in six rows
    half = [sum((curve[r, q] * jac[q][k] for q in range(3) if jac[q][k] is not None), F.lit(0.0)).alias(f"k{r}{k}") for r in range(3) for k in range(6)]
    h = [sum((jac[r][i] * F.col(f"k{r}{j}") for r in range(3) if jac[r][i] is not None), F.lit(0.0)).alias(f"h{i}{j}") for i, j in SIX]

    def of(m: DataFrame) -> DataFrame:
        rows = m.select(*carry, "w", *from_mid, *gaps, *["b_n" + c for c in "xyz"], "b_sigma", "b_conf", *chosen)
        rows = rows.select(*carry, "w", "px", "py", "pz", *terms)
        return rows.select("*", *half).select(*carry, "w", "e", *g, *h)

    return of


def approximated(m: DataFrame, energy: Energy) -> DataFrame:
    return approximation(energy)(m)


def weighted_sums() -> list[Column]:
    """Aggregates of ``approximated``: w, e, g0..g5 and h00..h55, weighted."""
    return [F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("e", *(f"g{k}" for k in range(6)), *(f"h{i}{j}" for i, j in SIX))]]
