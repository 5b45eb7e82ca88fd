"""Poses, trajectories and tracked states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_step() -> WindowSpec:
    """A track's poses in order."""
    return Window.partitionBy("uid").orderBy("step")


def with_motion(poses: DataFrame, default_dt: float = 0.1) -> DataFrame:
    """dt (seconds; ``default_dt`` for the first or under 1e-5), length of the step and speed of each pose."""
    dt = (F.col("ts_us") - F.lag("ts_us").over(by_step())) / 1e6
    d = F.sqrt((F.col("x") - F.lag("x").over(by_step())) ** 2 + (F.col("y") - F.lag("y").over(by_step())) ** 2)
    out = poses.withColumn("dt", F.when(dt >= 1e-5, dt).otherwise(default_dt)).withColumn("moved", F.coalesce(d, F.lit(0.0)))
    return out.withColumn("speed", F.col("moved") / F.col("dt"))


def frame_gaps(poses: DataFrame, window: int = 9, pick: int = 5, factor: float = 1.1) -> DataFrame:
    """dt, the usual period (the ``pick``-th of the last ``window`` - 1 sorted gaps) and what a gap means: early, normal
    or missing; share is the part of the usual motion to extrapolate by."""
    dt = F.col("ts_us") - F.lag("ts_us").over(by_step())
    p = poses.withColumn("dt", dt)
    past = F.sort_array(F.filter(F.collect_list("dt").over(by_step().rowsBetween(-(window - 2), 0)), lambda x: x.isNotNull()))
    usual = F.try_element_at(past, F.greatest(F.lit(1), F.least(F.lit(pick + 1), F.size(past))))
    p = p.withColumn("usual", usual)
    kind = F.when(F.col("dt").isNull(), "first").when(F.col("dt") < F.col("usual") / factor, "early").when(F.col("dt") < F.col("usual") * factor, "normal").otherwise("missing")
    return p.withColumn("kind", kind).withColumn("share", F.when(F.col("kind") == "missing", F.try_divide(F.col("dt").cast("double"), F.col("usual").cast("double"))))


def trajectory_length(poses: DataFrame) -> DataFrame:
    return with_motion(poses).groupBy("uid").agg(F.count("*").alias("n"), F.sum("moved").alias("length"))


def main_direction(poses: DataFrame, far: float = 4.0, near: float = 0.5) -> DataFrame:
    """Direction from a track's first pose to the first pose beyond ``far``, else to the last beyond ``near``."""
    w = by_step().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = poses.withColumns({"dx": F.col("x") - F.first("x").over(w), "dy": F.col("y") - F.first("y").over(w)})
    p = p.withColumn("d", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))
    at = F.struct("step", "dx", "dy")
    s = p.groupBy("uid").agg(F.min(F.when(F.col("d") > far, at)).alias("a"), F.max(F.when(F.col("d") > near, at)).alias("b"))
    best = F.coalesce("a", "b")
    return s.select("uid", best["step"].alias("step"), F.atan2(best["dy"], best["dx"]).alias("heading"))


def keep_moved(poses: DataFrame, least: float) -> DataFrame:
    """Poses at least ``least`` from the last kept one; the first is kept. A fold along each track."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        xy = pdf[["x", "y"]].to_numpy(float)
        keep, last = [], None
        for i, p in enumerate(xy):
            if last is None or np.hypot(*(p - last)) >= least:
                keep.append(i)
                last = p
        return pdf.iloc[keep]

    return poses.groupBy("uid").applyInPandas(fold, poses.schema)


def predict_once(tracks: DataFrame, dt: float = 0.1) -> DataFrame:
    """One step of a constant-velocity filter on (x, v) with covariance (pxx, pxv, pvv) and process noise (qx, qv)."""
    return tracks.select(
        "uid", (F.col("x") + dt * F.col("v")).alias("x"), "v", (F.col("pxx") + 2 * dt * F.col("pxv") + dt * dt * F.col("pvv") + F.col("qx")).alias("pxx"), (F.col("pxv") + dt * F.col("pvv")).alias("pxv"), (F.col("pvv") + F.col("qv")).alias("pvv")
    )


def transition(n: int, dt: float) -> np.ndarray:
    """I with dt above the diagonal: n positions and n rates."""
    f = np.eye(2 * n)
    f[:n, n:] = dt * np.eye(n)
    return f


def kalman_step(x: np.ndarray, p: np.ndarray, z: np.ndarray | None, r: np.ndarray, q: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Predict, then update with the measured positions z if there are any."""
    n = len(x) // 2
    f = transition(n, dt)
    x, p = f @ x, f @ p @ f.T + q
    if z is not None:
        s = p[:n, :n] + r
        w = np.linalg.solve(s, p[:n, :]).T
        x = x + w @ (z - x[:n])
        p = p - w @ s @ w.T
    return x, (p + p.T) / 2


def kalman_tracks(poses: DataFrame, dims: tuple[str, ...] = ("x", "y"), dt: float = 0.1, noise: float = 0.05, q_pos: float = 0.015, q_rate: float = 0.15, p_rate: float = 100.0) -> DataFrame:
    """(uid, step, age, measured, x, p): filtered state and covariance (row-major) after each pose; null positions only
    predict. Each track is folded in order in one task."""
    n = len(dims)
    q = np.diag([q_pos**2] * n + [q_rate**2] * n)
    r = np.eye(n) * noise**2

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        x, p, out = None, None, []
        for age, row in enumerate(pdf.itertuples(index=False)):
            z = np.array([getattr(row, d) for d in dims], float)
            seen = bool(np.isfinite(z).all())
            if x is None:
                x, p = np.concatenate((np.where(np.isfinite(z), z, 0.0), np.zeros(n))), np.diag([0.0] * n + [p_rate] * n)
            else:
                x, p = kalman_step(x, p, z if seen else None, r, q, dt)
            out.append((row.uid, row.step, age, seen, x.tolist(), p.ravel().tolist()))
        return pd.DataFrame(out, columns=["uid", "step", "age", "measured", "x", "p"])

    return poses.select("uid", F.col("step").cast("int"), *[F.col(d).cast("double") for d in dims]).groupBy("uid").applyInPandas(fold, "uid long, step int, age int, measured boolean, x array<double>, p array<double>")


def robust_extent(values: DataFrame, trim: float = 0.35, ratio: float = 0.3) -> DataFrame:
    """(uid, low, high): extent of each track's values without outliers at either end.

    With r = floor(n * trim), the low end is the first of v[1..r-1] from which the r-th next is near against the step
    from its predecessor, (v[l+r] - v[l]) / (v[l+r] - v[l-1]) < ratio, else the least value; the high end likewise.
    """
    s = values.groupBy("uid").agg(F.sort_array(F.collect_list("v")).alias("v")).withColumn("n", F.size("v")).withColumn("r", F.floor(F.col("n") * trim).cast("int"))
    v = lambda i: F.element_at("v", i)  # noqa: E731  from 1
    steps = F.when(F.col("r") > 1, F.sequence(F.lit(1), F.col("r") - 1)).otherwise(F.array().cast("array<int>"))
    low = F.filter(steps, lambda i: (v(i + F.col("r") + 1) - v(i + 1)) < ratio * (v(i + F.col("r") + 1) - v(i)))
    n = F.col("n")
    high = F.filter(steps, lambda i: (v(n - i) - v(n - i - F.col("r"))) < ratio * (v(n - i + 1) - v(n - i - F.col("r"))))
    return s.select("uid", F.when(F.size(low) > 0, v(F.element_at(low, 1) + 1)).otherwise(v(1)).alias("low"), F.when(F.size(high) > 0, v(n - F.element_at(high, 1))).otherwise(v(n)).alias("high"))


def first_line_pose(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Every row of a file with the value of its first row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("first_" + value, F.first(value).over(w))


def systematic(rows: DataFrame, share: float, order: str, by: str) -> DataFrame:
    """The rows at which floor(k * share) rises, k the rank in ``order`` within ``by``."""
    w = Window.partitionBy(by).orderBy(order)
    k = F.row_number().over(w)
    return rows.withColumn("k", k).withColumn("taken", F.floor(F.col("k") * share) != F.floor((F.col("k") - 1) * share))


def subsample_size(n: Column, least: int) -> Column:
    """Points kept of ``n``: all up to ``least``, beyond it the root of the surplus doubled; one at least."""
    return F.greatest(F.when(n <= least, n).otherwise(F.lit(least) + F.ceil(2 * F.sqrt(n - least))).cast("long"), F.lit(1).cast("long"))


def stratified(rows: DataFrame, wanted: int, upper: Column, order: str, by: str) -> DataFrame:
    """Rows of which about ``wanted`` a ``by`` are taken, three from the upper stratum for one from the lower: within a
    stratum those at which floor(k * share) rises. ``share`` is at most 1."""
    r = rows.withColumn("upper", upper)
    stratum = Window.partitionBy(by, "upper")
    share = F.least(F.lit(1.0), F.when(F.col("upper"), 0.75 * wanted).otherwise(0.25 * wanted) / F.count("*").over(stratum))
    k = F.row_number().over(stratum.orderBy(order))
    r = r.withColumns({"share": share, "k": k})
    return r.withColumn("taken", F.floor(F.col("k") * F.col("share")) != F.floor((F.col("k") - 1) * F.col("share"))).drop("share", "k")


def result_filter(static: bool = True, age: int | None = None, idle: int | None = None, points: int | None = None, distance: float | None = None, flatness: float | None = None, volume: float | None = None) -> Column:
    """Whether a result (uid, age, idle, points, x, y, z, ex, ey, ez) is shown: older than ``age``, idle for fewer than
    ``idle`` frames, of more than ``points``, nearer than ``distance``, with a log of its width by its height below
    ``flatness`` and less than ``volume``. The world, uid 1, is shown if ``static``; filters left out pass all."""
    ok = F.lit(True) if static else F.col("uid") != 1
    wide = F.log(F.try_divide(F.greatest("ex", "ey"), F.col("ez")))
    for value, rule in ((age, lambda v: F.col("age") > v), (idle, lambda v: F.col("idle") < v), (points, lambda v: F.col("points") > v),
                        (distance, lambda v: F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) < v), (flatness, lambda v: F.coalesce(wide < v, F.lit(False))),
                        (volume, lambda v: F.col("ex") * F.col("ey") * F.col("ez") < v)):
        if value is not None:
            ok = ok & rule(value)
    return ok
