"""All queries of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import feature_queries, geometry_queries, grid_queries, io_queries, lifecycle_queries, map_queries, merging_queries, projection_queries, registration_queries, sampling_queries, scan_queries, track_queries  # noqa: F401  they register themselves
from .registry import ORACLE, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
