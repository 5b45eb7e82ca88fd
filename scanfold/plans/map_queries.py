"""Queries on maps that grow scan by scan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.stored import new_path
from scanfold.streaming.maps import CubeMap

from .registry import query, rounded
from .views import POINTS, points

EXTENT, REACH, MARGIN = 1.5, 14.0, 3.0
#: Where the scans are taken from; the second hardly moved.
CENTRES = ((0.0, 0.0, 0.0), (0.01, 0.0, 0.0), (9.0, 1.0, -1.0))
_CELL = ", ".join(f"CAST(trunc({c} / {EXTENT}) AS INTEGER) - CAST({c} < 0 AS INTEGER) AS i{c}" for c in "xyz")
_NEAR = " OR ".join(f"(id % 3 = {k} AND (x - {c[0]}) ** 2 + (y - {c[1]}) ** 2 + (z - {c[2]}) ** 2 < {REACH**2})" for k, c in enumerate(CENTRES) if k != 1)
_FROM = " + ".join(f"((i{a} + 0.5) * {EXTENT} - {c}) ** 2" for a, c in zip("xyz", CENTRES[2], strict=True))


@query(f"""WITH {POINTS}, c AS (SELECT *, {_CELL} FROM points WHERE {_NEAR}), g AS (SELECT ix, iy, iz, count(*) AS hits, arg_max(id, (conf, -id)) AS id, max(conf) AS conf FROM c GROUP BY ALL)
  SELECT ix, iy, iz, hits, id, round(conf, 6) AS conf FROM g WHERE sqrt({_FROM}) + {EXTENT * math.sqrt(3) / 2} <= {REACH + MARGIN}""")
def map_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map after three scans, the second of which is skipped, without the cells that went out of sight."""
    p = points(spark, sf_dir)
    folder = new_path(spark, "map")
    cubes = CubeMap(spark, folder, EXTENT, REACH, side=4, evicted=f"{folder}-evicted", margin=MARGIN)
    for k, c in enumerate(CENTRES):
        cubes.add(p.where(F.col("id") % 3 == k), c)
    return rounded(cubes.table().select("ix", "iy", "iz", "hits", "id", "conf"), "conf")
