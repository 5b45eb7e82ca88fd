"""Energies, sigma points, sampled covariances and the registration of many tracks."""

from __future__ import annotations

import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanfold import stored as tables
from scanfold.operators import energies, icp, noise, track_icp


def _matches(spark, rng, n=40):
    rows = []
    for _ in range(n):
        a, d, m = rng.normal(size=3), rng.normal(size=3) * 0.3, rng.normal(size=3)
        rows.append((*a, *(a - d), *(m / np.linalg.norm(m)), *rng.uniform(0.1, 1, 3)))
    cols = [f"a_{c}" for c in "xyz"] + [f"b_{c}" for c in "xyz"] + [f"b_n{c}" for c in "xyz"] + ["b_sigma", "b_conf", "w"]
    return np.array(rows), spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(c + " double" for c in cols))


@pytest.mark.parametrize("name", ["point", "plane", "noisy", "blend"])
def test_energy_derivatives_match_differences(spark, name):
    made = {"point": energies.PointToPoint(), "plane": energies.PointToPlane(), "noisy": energies.PointToNoisyPlane(0.7), "blend": energies.Blend(energies.PointToPlane(), energies.PointToNoisyPlane())}
    rows, m = _matches(spark, np.random.default_rng(3))
    got = energies.approximated(m, made[name]).agg(*energies.weighted_sums()).first()

    def total(x):
        a, b, n, sigma, conf, w = rows[:, :3], rows[:, 3:6], rows[:, 6:9], rows[:, 9], rows[:, 10], rows[:, 11]
        d = a + np.cross(x[:3], a) + x[3:] - b
        off, r = (d * n).sum(1) ** 2, (d * d).sum(1)
        noisy = {"noisy": off / r**0.7 / sigma, "blend": off / r / sigma}.get(name)
        return (w * {"point": r, "plane": off, "noisy": noisy, "blend": None if noisy is None else conf * off + (1 - conf) * noisy}[name]).sum()

    h, e = 1e-4, np.eye(6) * 1e-4
    assert got.e == pytest.approx(total(np.zeros(6)))
    for i in range(6):
        assert got[f"g{i}"] == pytest.approx((total(e[i]) - total(-e[i])) / (2 * h), rel=1e-4, abs=1e-4)
        for j in range(i, 6):
            want = (total(e[i] + e[j]) - total(e[i] - e[j]) - total(e[j] - e[i]) + total(-e[i] - e[j])) / (4 * h * h)
            assert got[f"h{i}{j}"] == pytest.approx(want, rel=1e-3, abs=1e-3 * abs(total(np.zeros(6))))


def test_sigma_points_give_the_covariance_of_linear_maps(spark):
    rng = np.random.default_rng(4)
    a, root = rng.normal(size=(2, 3)), np.tril(rng.normal(size=(3, 3)))

    def linear(v):
        return [sum(float(a[i, k]) * v[k] for k in range(3)) for i in range(2)]

    c = noise.propagated(linear, [F.lit(x) for x in (1.0, -2.0, 0.5)], [[F.lit(float(x)) for x in root[:, k]] for k in range(3)], math.sqrt(3))
    got = spark.range(1).select(*[c[i][j].alias(f"c{i}{j}") for i in range(2) for j in range(2)]).first()
    assert np.allclose(np.array(got).reshape(2, 2), a @ root @ root.T @ a.T)


def test_sampled_covariance_matches_loops(spark):
    rows, m = _matches(spark, np.random.default_rng(5))
    got = np.zeros((6, 6))
    for r in noise.sampled_covariance(m, energies.PointToPoint()).collect():
        got[r.i, r.j] = r.value
    a, b, w = rows[:, :3], rows[:, 3:6], rows[:, 11]

    def mean(x):
        return (w * ((a @ icp.rotation_from(np.array(x[:3])).T + x[3:] - b) ** 2).sum(1)).sum() / w.sum()

    base = mean((0.0,) * 6)
    want = sum(5 * base / max(base / 500, mean(x) - base) * np.outer(x, x) for x in noise.lattice()) / 62
    assert np.allclose(got, want)
    assert noise.sampled_covariance(m.limit(0), energies.PointToPoint()).count() == 0


def test_tracks_are_registered_at_once(spark):
    rng = np.random.default_rng(6)
    xyz, n = rng.uniform(-20, 20, (400, 3)), rng.normal(size=(400, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    scan = spark.createDataFrame([(i, *map(float, (*x, *m)), 0.9) for i, (x, m) in enumerate(zip(xyz, n, strict=True))], "id long, x double, y double, z double, nx double, ny double, nz double, conf double")
    poses = {k: icp.Pose(icp.rotation_from(np.array([0.004, 0.003, -0.005]) * k if k < 3 else np.array([0, 0, 0.01])), np.array([0.05, 0.02 * k, -0.03])) for k in range(4)}
    points = []
    for i, x in enumerate(xyz):
        k = i % 4 if i % 4 < 3 or i < 100 else 0  # track 3 is small
        points.append((k, i, *map(float, poses[k].rotation.T @ (x - poses[k].translation)), 0.9 if k != 1 else 0.2))
    points += [(9, 1, None, 0.0, 0.0, 1.0), (None, 2, 0.0, 0.0, 0.0, 1.0)]
    tracks = [(k, np.eye(3, 4).ravel().tolist(), (np.eye(6) * (0.04 if k != 2 else 1e-6)).ravel().tolist()) for k in (0, 1, 2, 3, 9)] + [(8, None, None)]
    out = track_icp.register_tracks(spark.createDataFrame(points, "uid long, id long, x double, y double, z double, conf double"), spark.createDataFrame(tracks, "uid long, pose array<double>, covariance array<double>"), scan)
    got = {r.uid: r for r in out.collect()}
    assert set(got) == {0, 1, 2, 3}
    for k, p in poses.items():
        found = np.array(got[k].pose).reshape(3, 4)
        assert np.allclose(found[:, :3], p.rotation, atol=1e-3) and np.allclose(found[:, 3], p.translation, atol=1e-2)
    assert [got[k].plane for k in range(4)] == [True, False, True, True] and [got[k].yaw_only for k in range(4)] == [False, False, False, True]
    assert [got[k].accepted for k in range(4)] == [True, True, False, True]  # 2 is far beyond what was predicted


def test_temporary_tables_are_those_of_their_thread(spark):
    ready, done = threading.Event(), threading.Event()
    kept = []

    def other():
        with tables.temporary():
            kept.append(tables.stored(spark.range(3).toDF("a")))
            ready.set()
            done.wait(60)

    t = threading.Thread(target=other)
    t.start()
    ready.wait(60)
    with tables.temporary():
        own = tables.stored(spark.range(2).toDF("a"))
        assert own.count() == 2
    assert kept[0].count() == 3
    done.set()
    t.join()
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        spark.read.parquet(own.written_path).count()


def test_components_by_contraction(spark):
    from scanfold.operators.components import components

    edges = [(i, i + 1) for i in range(0, 80)] + [(200, x) for x in range(201, 260)] + [(5, 5), (None, 3), (301, 300), (300, 301), (404, 402), (402, 403), (403, 401)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(81)}, **{i: 200 for i in range(200, 260)}, 300: 300, 301: 300, **{i: 401 for i in range(401, 405)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_segments_of_edges_equal_those_of_frames(spark):
    from scanfold.operators import segments

    rng = np.random.default_rng(2)
    rows = [(f, r, c, None if rng.random() < 0.2 else float(rng.integers(1, 5))) for f in (1, 2) for r in range(9) for c in range(14)]
    df = spark.createDataFrame(rows, "frame long, row int, col int, dist double")
    want = {(r.frame, r.row, r.col): r.segment for r in segments.segment_frames(df, 1.5).collect()}
    lab = segments.segment_by_edges(df, segments.pixel_edges(df, 1.5))
    assert {(r.frame, r.row, r.col): r.segment for r in lab.collect()} == want
    pairs = spark.createDataFrame([(1, min(s for (f, _, _), s in want.items() if f == 1), max(s for (f, _, _), s in want.items() if f == 1))], "frame long, a long, b long")
    first, last = pairs.first().a, pairs.first().b
    merged = {(r.frame, r.row, r.col): r.segment for r in segments.merge_segments(lab, pairs).collect()}
    assert merged == {k: first if (k[0], s) == (1, last) else s for k, s in want.items()}
    near = segments.merge_neighbours(segments.segment_neighbour_scores(lab, lambda d: -d), pairs)
    assert near.where(F.col("a") >= F.col("b")).count() == 0 and near.where((F.col("frame") == 1) & ((F.col("a") == last) | (F.col("b") == last))).count() == 0


def test_borders_of_dealt_frames_need_no_shuffle(spark):
    import re

    from scanfold.operators import segments

    rows = [(f, r, c, float((f + 3 * r * r + c) % 7), (f + r + c) % 4) for f in range(4) for r in range(5) for c in range(6)]
    lab = spark.createDataFrame(rows, "frame long, row int, col int, dist double, segment long").repartition(3, "frame")
    near = segments.segment_neighbours(lab)
    assert re.findall(r"hashpartitioning\((.*?)#\d+L, 3\)", near._jdf.queryExecution().executedPlan().toString()) == ["frame"]
    assert near._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    want = {}
    at = {(f, r, c): (d, s) for f, r, c, d, s in rows}
    for (f, r, c), (d, s) in at.items():
        for k in ((f, r + 1, c), (f, r, c + 1)):
            if k in at and at[k][1] != s:
                key = (f, min(s, at[k][1]), max(s, at[k][1]))
                want[key] = min(want.get(key, 99.0), abs(d - at[k][0]))
    assert {(r.frame, r.a, r.b): r.nearest for r in near.collect()} == want


def test_segments_of_dealt_frames_are_merged_without_a_shuffle(spark):
    import re

    from scanfold.operators import segments

    rng = np.random.default_rng(5)
    rows = [(f, r, c, float(rng.integers(1, 9)), 7 - f) for f in range(6) for r in range(5) for c in range(8)]
    lab = segments.segment_frames(spark.createDataFrame(rows, "frame long, row int, col int, dist double, x long"), 1.5)
    lab = spark.createDataFrame(lab.collect(), lab.schema).repartition(3, "frame")
    pairs = segments.segment_neighbours(lab).where("nearest < 3")
    merged = segments.merge_segments(lab, pairs, whole=True)
    assert set(re.findall(r"hashpartitioning\((.*?)#", merged._jdf.queryExecution().executedPlan().toString())) == {"frame"}
    assert len(re.findall(r"hashpartitioning\([^)]*,[^)]*, \d+\)", merged._jdf.queryExecution().executedPlan().toString())) == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in merged.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(tuple(r) for r in segments.merge_segments(lab, pairs).collect())
    assert len({r[-1] for r in got}) < len({(r.segment) for r in lab.collect()}) and merged.columns == lab.columns
