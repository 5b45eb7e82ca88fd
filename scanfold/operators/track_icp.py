"""Registration of many tracks at once.

Each track has points and a predicted pose with its covariance. A round moves all points by their track's pose, matches
them with the scan (one search for all tracks), and sums each track's energy, gradient and Hessian; the small systems are
then solved in batches. A round is one job whatever the number of tracks, and nothing of a track reaches the driver.

The energy is point to plane where the normals of a track are trusted on average, and point to point, with twice as many
rounds, elsewhere. Tracks of few points are turned by yaw only. A step that is not valid (angles beyond the linear range,
too few matches) is replaced by a shift of the centres, once in a row. A track ends when its error has settled, or has
grown too far. The result is accepted if it is within reach of the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.stored import stored

from . import kdtree, knn
from .energies import SIX, Either, Energy, PointToPlane, PointToPoint, approximation, weighted_sums
from .icp import rotation_from

#: Largest turn of a step in radians: the energies are linear in the angles near 0.
TURN_MOST = 0.1
#: Lowest sum of weights of a valid step.
MATCHES_LEAST = 3.0
#: Variance of what a registration does not determine, and least mean error of one.
VARIANCE_MOST = 1e6
ERROR_LEAST = 0.001


@dataclass(frozen=True)
class Settings:
    """When a track ends: after ``least`` to ``most`` rounds (twice as many point to point), once three changes of the
    error are below ``settled``, or if it is above ``fine`` and ``grown`` times the first."""

    least: int = 4
    most: int = 10
    settled: float = 0.01
    grown: float = 1.2
    fine: float = 0.045
    confident: float = 0.7
    yaw_only_below: int = 50
    half: float = 5.0
    ridge: float = 1e-6
    reach: float = 2.0


_STATE = "uid long, plane boolean, yaw_only boolean, pose array<double>, centre array<double>, round int, first double, last double, changes array<double>, shifted boolean, good boolean, over boolean, covariance array<double>"
_SUMS = ["w", "e", *(f"g{k}" for k in range(6)), *(f"h{i}{j}" for i, j in SIX), "dist", *(f"{p}{c}" for p in "mq" for c in "xyz")]


def _applied(rows: DataFrame, names: list[str], to: list[str]) -> DataFrame:
    p = [F.col("pose").getItem(i) for i in range(12)]
    turned = {t: sum((p[4 * r + k] * F.col(c) for k, c in enumerate(names)), p[4 * r + 3]) for r, t in enumerate(to)}
    return rows.withColumns(turned)


def _step(h: np.ndarray, g: np.ndarray, yaw_only: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps and inverse Hessians of a batch of 6 x 6 systems; those for yaw only leave roll and pitch alone."""
    x, inverse = np.zeros((len(h), 6)), np.tile(np.eye(6) * 1e-6, (len(h), 1, 1))
    for mask, lo in ((yaw_only, 2), (~yaw_only, 0)):
        if mask.any():
            own = h[mask][:, lo:, lo:] + ridge * np.eye(6 - lo)
            inv = np.linalg.pinv(own, hermitian=True)
            inverse[np.ix_(np.flatnonzero(mask), range(lo, 6), range(lo, 6))] = inv
            x[np.ix_(np.flatnonzero(mask), range(lo, 6))] = -np.einsum("nij,nj->ni", inv, g[mask][:, lo:])
    return x, inverse


def _advance(settings: Settings):
    """The state of each track after its sums: the error that the last step led to, and the next step if it goes on."""
    names = [x.split()[0] for x in _STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            sums = {k: np.array([r[k] or 0.0 for r in rows]) for k in _SUMS}
            h = np.zeros((len(rows), 6, 6))
            for i, j in SIX:
                h[:, i, j] = h[:, j, i] = sums[f"h{i}{j}"]
            g = np.stack([sums[f"g{k}"] for k in range(6)], axis=1)
            x, inverse = _step(h, g, np.array([r["yaw_only"] for r in rows]), settings.ridge)
            for k, r in enumerate(rows):
                w = sums["w"][k]
                error = sums["dist"][k] / w if w > 0 else float("nan")
                good = bool(r["good"]) and w >= 1
                if r["round"] > 0:
                    if r["round"] == 1:
                        r["first"] = error
                    change = 0.0 if error == 0 else abs(r["last"] - error) / (r["last"] + error)
                    r["changes"] = [*r["changes"][1:], change]
                    twice = 1 if r["plane"] else 2
                    if r["round"] + 1 >= twice * settings.least:
                        r["over"] = good and all(c < settings.settled for c in r["changes"])
                        if not r["over"] and error > settings.fine and error > settings.grown * r["first"]:
                            r["over"], good = True, False
                    r["over"] = r["over"] or r["round"] + 1 >= twice * settings.most
                r["last"], r["good"] = error, good
                spread = inverse[k] * max(ERROR_LEAST, 2 * sums["e"][k] / w if w > 0 else 0.0)
                diagonal = np.diag(h[k])
                spread[np.diag_indices(6)] = np.where(diagonal < settings.ridge, VARIANCE_MOST, np.diag(spread))
                r["covariance"] = spread.ravel().tolist()
                if r["over"] or not np.isfinite(error):
                    r["over"], r["good"] = True, r["good"] and np.isfinite(error)
                    continue
                step = x[k].copy()
                valid = bool((diagonal >= settings.ridge).any())
                if valid:
                    limited = np.clip(step[:3], -TURN_MOST, TURN_MOST)
                    valid = bool((limited == step[:3]).all()) and w >= MATCHES_LEAST
                    step[:3] = limited
                    if not valid and not r["shifted"]:
                        step[:3] = 0
                        step[3:] = [(sums[f"q{c}"][k] - sums[f"m{c}"][k]) / w for c in "xyz"]
                        r["shifted"] = True
                    else:
                        r["shifted"] = False
                    turn, centre = rotation_from(step[:3]), np.array(r["centre"])
                    shift = step[3:] + centre - turn @ centre
                    pose = np.array(r["pose"]).reshape(3, 4)
                    pose = np.column_stack((turn @ pose[:, :3], turn @ pose[:, 3] + shift))
                    r["pose"], r["centre"] = pose.ravel().tolist(), (turn @ centre + shift).tolist()
                r["good"], r["round"] = valid, r["round"] + 1
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=batch.schema.empty_table().select(names).schema)

    return run


def _angles(pose: np.ndarray) -> np.ndarray:
    """(roll, pitch, yaw, x, y, z) of a 3 x 4 pose."""
    r = pose[:, :3]
    return np.array([np.arctan2(r[2, 1], r[2, 2]), np.arctan2(-r[2, 0], np.hypot(r[2, 1], r[2, 2])), np.arctan2(r[1, 0], r[0, 0]), *pose[:, 3]])


def _judged(reach: float):
    """Accepted, and its distance from the prediction in deviations: both are compared where the track's centre goes, so
    that small turns of far tracks do not count as shifts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            off = []
            for r in rows:
                mean = np.array(r["mean"])
                states = []
                for pose in (np.array(r["pose"]).reshape(3, 4), np.array(r["predicted"]).reshape(3, 4)):
                    s = _angles(pose)
                    s[3:] = pose[:, :3] @ mean + pose[:, 3]
                    states.append(s)
                gap = states[0] - states[1]
                gap[:3] = (gap[:3] + np.pi) % (2 * np.pi) - np.pi
                inverse = np.linalg.inv(np.array(r["expected"]).reshape(6, 6) + 1e-12 * np.eye(6))
                off.append(float(np.sqrt(max(gap @ inverse @ gap, 0.0))))
            ok = [bool(r["good"]) and o <= reach for r, o in zip(rows, off, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(ok, pa.bool_()), pa.array(off, pa.float64()), *(batch.column(c) for c in ("plane", "yaw_only", "pose", "covariance", "last", "round"))], names=["uid", "accepted", "deviations", "plane", "yaw_only", "pose", "covariance", "error", "rounds"])

    return run


def register_tracks(points: DataFrame, tracks: DataFrame, scan: DataFrame, settings: Settings = Settings(), sure: Energy | None = None, unsure: Energy | None = None) -> DataFrame:
    """(uid, accepted, deviations, plane, yaw_only, pose, covariance, error, rounds) of each track with points.

    ``points`` (uid, id, x, y, z, conf) are in their track's frame, ``tracks`` (uid, pose, covariance) hold the predicted
    3 x 4 pose, row-major, and the 6 x 6 covariance of (roll, pitch, yaw, x, y, z); ``scan`` (id, x, y, z, nx, ny, nz,
    conf and perhaps sigma) is what they are laid on. Points with nulls take no part; tracks without points or with a null
    pose are left out.
    """
    energy = Either("plane", sure or PointToPlane(), unsure or PointToPoint())
    usable = points.where(sum((F.abs(F.col(c)) for c in "xyz"), F.lit(0.0)) < F.lit(float("inf")))
    found = usable.groupBy("uid").agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.array(*[F.avg(c) for c in "xyz"]).alias("mean"))
    known = stored(tracks.where("uid is not null and pose is not null").select("uid", F.col("pose").alias("predicted"), F.col("covariance").alias("expected")).join(found, "uid"))
    mean = [F.col("mean").getItem(k) for k in range(3)]
    centre = F.array(*[sum((F.col("predicted").getItem(4 * r + k) * mean[k] for k in range(3)), F.col("predicted").getItem(4 * r + 3)) for r in range(3)])
    nan, no = F.lit(float("nan")), F.lit(False)
    state = known.select("uid", (F.coalesce("conf", F.lit(0.0)) > settings.confident).alias("plane"), (F.col("n") < settings.yaw_only_below).alias("yaw_only"), F.col("predicted").alias("pose"), centre.alias("centre"), F.lit(0).alias("round"), nan.alias("first"), nan.alias("last"), F.array(*[F.lit(1.0 + settings.settled)] * 3).alias("changes"), no.alias("shifted"), F.lit(True).alias("good"), no.alias("over"), F.array().cast("array<double>").alias("covariance"))
    index = kdtree.index(scan, knn.AXES)
    sigma = F.col("sigma") if "sigma" in scan.columns else F.lit(0.0)
    target = scan.select(F.col("id").alias("near_id"), *[F.col(c).alias("b_" + c) for c in ("x", "y", "z", "nx", "ny", "nz", "conf")], sigma.alias("b_sigma"))
    # ids are the points' own within a track only
    own = stored(usable.select("uid", F.monotonically_increasing_id().alias("id"), "x", "y", "z"))
    approximated = approximation(energy, ("uid", "ends"), ("cx", "cy", "cz"))
    ends = F.struct("d", *[F.col(p + c).alias(q + c) for p, q in (("a_", "m"), ("b_", "q")) for c in "xyz"])
    w = F.col("w")
    sums = [*weighted_sums(), F.sum(w * F.col("ends.d")).alias("dist"), *[F.sum(w * F.col(f"ends.{q}{c}")).alias(q + c) for q in "mq" for c in "xyz"]]
    ended = None
    for _ in range(2 * settings.most + 1):
        moved = _applied(own.join(state.select("uid", "pose", "centre", "plane"), "uid"), ["x", "y", "z"], ["a_x", "a_y", "a_z"])
        near = kdtree.search(index, moved.select("id", *[F.col("a_" + c).alias(c) for c in "xyz"]), 1, same_table=False)
        m = moved.join(near.select("id", "near_id", F.sqrt("d2").alias("d")), "id").join(target, "near_id")
        m = m.withColumn("w", knn.correspondence_weight(F.col("d"), F.col("d"), settings.half)).withColumns({f"c{c}": F.col("centre").getItem(k) for k, c in enumerate("xyz")})
        totals = approximated(m.withColumn("ends", ends)).groupBy("uid").agg(*sums)
        state = stored(state.join(totals, "uid", "left").mapInArrow(_advance(settings), _STATE))
        over = state.where("over")
        ended = over if ended is None else ended.unionByName(over)
        state = state.where("not over")
        if state.isEmpty():
            break
    result = ended.select("uid", "plane", "yaw_only", "pose", "covariance", "last", "round", "good").join(known.select("uid", "predicted", "expected", "mean"), "uid")
    return result.mapInArrow(_judged(settings.reach), "uid long, accepted boolean, deviations double, plane boolean, yaw_only boolean, pose array<double>, covariance array<double>, error double, rounds int")
