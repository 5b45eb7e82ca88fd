"""Parameters of a run and their archive."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


# The defaults below are those of mapping runs.
@dataclass(frozen=True)
class Params:
    """Defaults of a mapping run; ``TRACKER`` holds the tuned values of a tracking run."""

    max_distance: float = 50.0
    resolution: float = 0.05
    gap_pixels_h: int = 5
    gap_pixels_v: int = 2
    conn_max_dst: float = 0.2
    conn_max_dst_ratio: float = 0.2
    conn_a: float = 1.0
    conn_b: float = 1.0
    conn_c: float = 0.02
    conn_d: float = 0.1
    seg_conv_thresh: float = 6.0
    seg_conv_fac: float = 1.0
    seg_norm_thresh: float = 18.0
    seg_min_score: float = 0.4
    seg_min_size: int = 10
    most_idle_frames: int = 30


# The tuned parameters of tracking runs, which results depend on.
TRACKER = replace(Params(), conn_max_dst=0.202108, conn_max_dst_ratio=1.81887, conn_a=0.520373, conn_b=-1.05362, conn_c=0.103174, conn_d=0.456825, seg_conv_thresh=-2.41372, seg_conv_fac=2.09533, seg_norm_thresh=15.4985, seg_min_score=0.522013, seg_min_size=8)


def save(spark: SparkSession, params: Params, path: str) -> None:
    """The parameters as one JSON line in a folder."""
    spark.createDataFrame([(json.dumps(asdict(params), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Params:
    return Params(**json.loads(spark.read.text(path).agg(F.max("value")).first()[0]))
