"""Vectors: three coordinates as columns, or arrays of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot3(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross3(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm3(a: Sequence[Column]) -> Column:
    return F.sqrt(dot3(a, a))


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l1(a: Column, b: Column) -> Column:
    """Manhattan distance, null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance, null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(doubles(a), lambda x: x * k)
