"""Stateful streams: tracks filtered as their poses arrive, decimated trajectories and accumulated maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanfold.operators.grid import CELL, with_cells
from scanfold.operators.tracks import kalman_step
from scanfold.sources import pointfiles


def stream_kalman(poses: DataFrame, dt: float = 0.1, noise: float = 0.05, q_pos: float = 0.015, q_rate: float = 0.15, p_rate: float = 100.0, idle_ms: int = 0) -> DataFrame:
    """(uid, step, age, x, vx, y, vy) after each pose (uid, step, x, y) of an append stream.

    The state of a track is its filter, so any number of tracks are kept apart by uid. With ``idle_ms`` a track that
    gets no pose for that long is dropped. Poses of a batch are taken in order of step.
    """
    q, r = np.diag([q_pos**2] * 2 + [q_rate**2] * 2), np.eye(2) * noise**2

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        age, x, p = -1, None, None
        if state.exists:
            age, flat_x, flat_p = state.get
            x, p = np.array(flat_x), np.array(flat_p).reshape(4, 4)
        out = []
        for row in pd.concat(list(batches)).sort_values("step").itertuples(index=False):
            z = np.array([row.x, row.y], float)
            if x is None:
                x, p = np.array([z[0], z[1], 0.0, 0.0]), np.diag([0.0, 0.0, p_rate, p_rate])
            else:
                x, p = kalman_step(x, p, z, r, q, dt)
            age += 1
            out.append((key[0], row.step, age, x[0], x[2], x[1], x[3]))
        state.update((age, x.tolist(), p.ravel().tolist()))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["uid", "step", "age", "x", "vx", "y", "vy"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return poses.groupBy("uid").applyInPandasWithState(step, "uid long, step int, age int, x double, vx double, y double, vy double", "age int, x array<double>, p array<double>", "append", timeout)


def stream_keep_moved(poses: DataFrame, least: float) -> DataFrame:
    """Poses of an append stream at least ``least`` from the last kept pose of their track."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = np.array(state.get) if state.exists else None
        keep = []
        for row in pd.concat(list(batches)).sort_values("step").itertuples(index=False):
            p = np.array([row.x, row.y], float)
            if last is None or np.hypot(*(p - last)) >= least:
                keep.append((key[0], row.step, row.x, row.y))
                last = p
        state.update((float(last[0]), float(last[1])))
        yield pd.DataFrame(keep, columns=["uid", "step", "x", "y"])

    return poses.groupBy("uid").applyInPandasWithState(step, "uid long, step int, x double, y double", "x double, y double", "append", GroupStateTimeout.NoTimeout)


def windowed_speed(poses: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Number and mean value of events by window and user, from a stream with ``ts``; windows close ``late`` after."""
    return poses.withWatermark("ts", late).groupBy(F.window("ts", width), "uid").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))


def merge_into_map(batch: DataFrame, held: DataFrame | None, extent: float) -> DataFrame:
    """A map of one point for each cell after a batch: hits add up and the surest point stays, ties to the least id."""
    cols = ["id", "x", "y", "z", "conf"]
    best = F.max(F.struct("conf", (-F.col("id")).alias("neg"), *cols[:4])).alias("b")
    new = with_cells(batch.select(*cols), extent).withColumn("hits", F.lit(1).cast("long"))
    every = new if held is None else new.unionByName(held)
    out = every.groupBy(*CELL).agg(best, F.sum("hits").alias("hits"))
    return out.select("b.id", "b.x", "b.y", "b.z", "b.conf", *CELL, "hits")


def evict_far(held: DataFrame, centre: tuple[float, float, float], most: float) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted) points of a map by their distance from the sensor."""
    d = sum((F.col(c) - F.lit(v)) ** 2 for c, v in zip("xyz", centre, strict=True))
    return held.where(d <= most * most), held.where(d > most * most)


def append_evicted(held: DataFrame, centre: tuple[float, float, float], most: float, folder: str, kind: str = "p3d", least_hits: int = 2) -> DataFrame:
    """The map (with hits, and intensity where ``kind`` asks for it) without the cells farther than ``most``, which are
    appended to the files of points in ``folder``: those of at least ``least_hits``, or all of them with intensities."""
    pointfiles.register(held.sparkSession)
    kept, gone = evict_far(held, centre, most)
    intensity = pointfiles.form("a." + kind)[1]
    rows = gone if intensity else gone.where(F.col("hits") >= least_hits)
    rows.select("x", "y", "z", *(["intensity"] if intensity else [])).write.format("points").mode("append").option("path", folder).option("kind", kind).save()
    return kept


class MapSink:
    """A ``foreachBatch`` sink that keeps the map as a table: each batch writes the next version in the given folder."""

    def __init__(self, folder: str, extent: float):
        self.folder, self.extent = folder.rstrip("/"), extent

    def path(self, version: int) -> str:
        return f"{self.folder}/v{version}"

    def __call__(self, batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        held = spark.read.parquet(self.path(version - 1)) if version else None
        merge_into_map(batch, held, self.extent).write.mode("overwrite").parquet(self.path(version))
