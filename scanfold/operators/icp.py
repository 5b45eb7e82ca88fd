"""Iterative registration of points to surfaces.

Each iteration is one distributed nearest-neighbour join and one aggregation of the normal equations; only the 27
sums of a 6 x 6 system reach the driver, which solves it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kdtree, knn


@dataclass
class Pose:
    rotation: np.ndarray
    translation: np.ndarray
    error: float = float("nan")
    rounds: int = 0


def rotation_from(r: np.ndarray) -> np.ndarray:
    """Rotation of three small angles, yaw times pitch times roll."""
    (cx, cy, cz), (sx, sy, sz) = np.cos(r), np.sin(r)
    return np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])


def moved(points: DataFrame, pose: Pose) -> DataFrame:
    """Points, and their normals, under a pose."""
    r, t = pose.rotation, pose.translation

    def turn(p: str, row: int, shift: float):
        return sum((F.col(p + c) * F.lit(float(r[row, j])) for j, c in enumerate("xyz")), F.lit(shift))

    cols = {c: turn("", i, float(t[i])) for i, c in enumerate("xyz")} | {"n" + c: turn("n", i, 0.0) for i, c in enumerate("xyz")}
    return points.withColumns(cols)


def normal_equations(m: DataFrame, half: float, last: float | None = None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(H, g, weighted squared error, weight) of the linearised point-to-plane energy over matches; those whose squared
    error is above the mean of the round before, ``last``, count as much less as they are above it."""
    a, n, b = (tuple(F.col(p + c) for c in "xyz") for p in ("a_", "b_n", "b_"))
    d = F.sqrt("d2")
    off = knn.plane_distance(n, a, b)
    row = (a[1] * n[2] - a[2] * n[1], a[2] * n[0] - a[0] * n[2], a[0] * n[1] - a[1] * n[0], *n)
    w = knn.correspondence_weight(d, d, half)
    if last is not None:
        w = w * F.when(off * off > last, F.lit(last) / (off * off)).otherwise(1.0)
    q = m.select(w.alias("w"), off.alias("b"), *[x.alias(f"r{i}") for i, x in enumerate(row)])
    sums = [F.sum(F.col("w") * F.col(f"r{i}") * F.col(f"r{j}")).alias(f"h{i}{j}") for i in range(6) for j in range(i, 6)]
    sums += [F.sum(F.col("w") * F.col(f"r{i}") * F.col("b")).alias(f"g{i}") for i in range(6)]
    s = q.agg(*sums, F.sum(F.col("w") * F.col("b") * F.col("b")).alias("e"), F.sum("w").alias("w")).first()
    h = np.zeros((6, 6))
    for i in range(6):
        for j in range(i, 6):
            h[i, j] = h[j, i] = s[f"h{i}{j}"] or 0.0
    return h, np.array([s[f"g{i}"] or 0.0 for i in range(6)]), s["e"] or 0.0, s["w"] or 0.0


def register(scan: DataFrame, surface: DataFrame, half: float = 5.0, most_rounds: int = 10, tolerance: float = 0.01, ridge: float = 1e-6) -> Pose:
    """The pose that lays ``scan`` on ``surface``, from the identity: stops when three changes of the error are below
    ``tolerance``; angles of a step are held to 0.1 rad."""
    pose, errors = Pose(np.eye(3), np.zeros(3)), []
    index = kdtree.index(surface, knn.AXES)
    for k in range(most_rounds):
        now = moved(scan, pose)
        m = knn.matched(now, surface, kdtree.search(index, now, 1, same_table=False))
        h, g, e, w = normal_equations(m, half, errors[-1] ** 2 if errors else None)
        if w < 1:
            break
        errors.append(float(np.sqrt(e / w)))
        x = -np.linalg.solve(h + ridge * np.eye(6), g)
        x[:3] = np.clip(x[:3], -0.1, 0.1)
        r = rotation_from(x[:3])
        pose = Pose(r @ pose.rotation, r @ pose.translation + x[3:], errors[-1], k + 1)
        last = errors[-4:]
        if len(last) == 4 and all(abs(a - b) <= tolerance * (a + b + 1e-12) for a, b in zip(last, last[1:], strict=False)):
            break
    return pose


#: A small move, from which registrations are tried.
KNOWN_START = Pose(rotation_from(np.array([0.004, -0.006, 0.01])), np.array([0.05, -0.04, 0.03]))


def register_known_move(points: DataFrame) -> DataFrame:
    """(term, value): pose and error of the registration of slightly moved points onto the points themselves."""
    pose = register(moved(points, KNOWN_START), points)
    rows = [(f"r{i}{j}", float(pose.rotation[i, j])) for i in range(3) for j in range(3)] + [(f"t{i}", float(pose.translation[i])) for i in range(3)] + [("error", pose.error)]
    return points.sparkSession.createDataFrame(rows, "term string, value double")


def rigid_fit(m: DataFrame) -> Pose:
    """The rotation and translation that best lay the points a_x, a_y, a_z of matches on b_x, b_y, b_z by weight ``w``.

    One pass sums the weighted moments; the singular vectors of their 3 x 3 cross-covariance give the rotation. The
    identity without any weight.
    """
    a, b = ([F.col(p + c) for c in "xyz"] for p in ("a_", "b_"))
    w = F.col("w")
    sums = [F.sum(w).alias("w")] + [F.sum(w * c).alias(f"{n}{i}") for n, p in (("a", a), ("b", b)) for i, c in enumerate(p)]
    sums += [F.sum(w * a[i] * b[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)] + [F.sum(w * sum(x * x for x in p)).alias(n) for n, p in (("aa", a), ("bb", b))]
    s = m.agg(*sums).first()
    if not s["w"]:
        return Pose(np.eye(3), np.zeros(3))
    ma, mb = (np.array([s[f"{n}{i}"] for i in range(3)]) / s["w"] for n in "ab")
    cross = np.array([[s[f"c{i}{j}"] for j in range(3)] for i in range(3)]) / s["w"] - np.outer(ma, mb)
    u, _, vt = np.linalg.svd(cross)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    r = vt.T @ flip @ u.T
    rest = (s["aa"] / s["w"] - ma @ ma) + (s["bb"] / s["w"] - mb @ mb) - 2 * np.trace(r @ cross)
    return Pose(r, mb - r @ ma, float(np.sqrt(max(rest, 0.0))), 1)


def register_points(scan: DataFrame, target: DataFrame, half: float = 5.0, most_rounds: int = 10, tolerance: float = 1e-3) -> Pose:
    """The pose that lays ``scan`` on ``target`` by points alone: nearest neighbours and ``rigid_fit`` in turn, until the
    error changes by less than ``tolerance`` of itself."""
    pose = Pose(np.eye(3), np.zeros(3))
    index = kdtree.index(target, knn.AXES)
    for k in range(most_rounds):
        now = moved(scan, pose)
        m = knn.matched(now, target, kdtree.search(index, now, 1, same_table=False))
        d = F.sqrt("d2")
        step = rigid_fit(m.withColumn("w", knn.correspondence_weight(d, d, half)))
        last, pose = pose.error, Pose(step.rotation @ pose.rotation, step.rotation @ pose.translation + step.translation, step.error, k + 1)
        if abs(last - pose.error) <= tolerance * (pose.error + 1e-12):
            break
    return pose
