"""Integer cells of a regular grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_index(x: Column, extent: float) -> Column:
    """Cell of a coordinate: truncated quotient, one less for negative coordinates (so -extent is in cell -2)."""
    return (x / F.lit(extent)).cast("int") - (x < 0).cast("int")


def cell_center(i: Column, extent: float) -> Column:
    return (i + F.lit(0.5)) * F.lit(extent)
