"""Soft thresholds and other scalar shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def soft_threshold(x: Column, at: float | Column, slope: float | Column) -> Column:
    """A smooth step from 1 (far below ``at``) to 0 (far above) of algebraic shape."""
    u = (x - at) * slope
    return F.lit(0.5) - F.lit(0.5) * u / F.sqrt(1 + u * u)


def lin_sat(x: Column, low: float, high: float) -> Column:
    """0 below ``low``, 1 above ``high``, linear between."""
    return F.least(F.greatest((x - low) / F.lit(high - low), F.lit(0.0)), F.lit(1.0))


def mlog(x: Column) -> Column:
    """Logarithm of 1 + x, 0 for negative x."""
    return F.log(F.greatest(F.lit(1.0), 1 + x))


def sign(x: Column) -> Column:
    return F.signum(x)


def connectivity(d1: Column, d2: Column, left: Column, right: Column, *, near: float = 0.2, ratio: float = 0.2, a: float = 1.0, b: float = 1.0, c: float = 0.02, side: float = 0.1) -> Column:
    """Weight of the connection of neighbouring distances ``d1`` and ``d2`` given the differences on either side.

    0 where a distance is missing or tiny, 1 where both are within ``near``, 0 where a side difference is tiny or
    missing, else the least of soft thresholds on the relative difference and its change against either side.
    """
    diff = d1 - d2
    m = F.least(d1, d2)
    slope = F.lit(a) - F.lit(b) * F.exp(-m * F.lit(c))

    def change(other: Column) -> Column:
        return soft_threshold(F.abs((diff - other) / other), side, slope)

    least = F.least(soft_threshold(F.abs(diff) / m, ratio, 2.0 / ratio), change(left), change(right))
    tiny = (F.abs(d1) < 0.01) | (F.abs(d2) < 0.01)
    flat = left.isNull() | right.isNull() | (F.abs(left) < 0.01) | (F.abs(right) < 0.01)
    return F.when(d1.isNull() | d2.isNull() | tiny, 0.0).when(F.abs(diff) < near, 1.0).when(flat, 0.0).otherwise(least)
