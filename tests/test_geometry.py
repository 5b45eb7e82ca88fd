"""Matrices, poses, fits, audits and model archives against numpy and by hand."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from scanfold.functions import geo, mat
from scanfold.operators import audit, icp, segments


def test_matrices_against_numpy(spark):
    rng = np.random.default_rng(3)
    many = [rng.normal(size=(3, 3)) for _ in range(20)] + [np.zeros((3, 3)), np.diag([2.0, 2.0, 2.0])]
    df = spark.createDataFrame([(i, [float(x) for x in m.ravel()]) for i, m in enumerate(many)], "id int, m array<double>")
    gram = F.array(*[sum(F.col("m").getItem(3 * r + k) * F.col("m").getItem(3 * c + k) for k in range(3)) for r in range(3) for c in range(3)])
    rows = df.withColumn("g", gram).select("id", mat.determinant(F.col("m")).alias("d"), mat.inverse(F.col("m")).alias("i"), mat.orthonormalised(F.col("m"), 30).alias("o"), F.array(*mat.eigenvalues(F.col("g"))).alias("e")).collect()
    for r in rows:
        m = many[r.id]
        assert np.isclose(r.d, np.linalg.det(m), atol=1e-12)
        assert np.allclose(r.e, np.sort(np.linalg.eigvalsh(m @ m.T))[::-1], atol=1e-6)
        if r.d == 0:
            assert r.i is None and r.o is None
            continue
        assert np.allclose(np.reshape(r.i, (3, 3)) @ m, np.eye(3), atol=1e-8)
        u, _, vt = np.linalg.svd(m)
        assert np.allclose(np.reshape(r.o, (3, 3)), u @ vt, atol=1e-6)


def test_poses_compose_and_unskew(spark):
    p = geo.pose_matrix(*[F.lit(v) for v in (0.3, -0.2, 0.1, 1.0, 2.0, 3.0)])
    one = spark.range(1).select(geo.compose_pose(geo.invert_pose(p), p).alias("m"), geo.recentred(p, F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("c"), p.alias("p")).first()
    assert np.allclose(np.reshape(one.m, (4, 4)), np.eye(4)) and np.allclose(one.c, one.p)
    zero = F.lit(0.0)
    move = (zero, zero, zero, F.lit(4.0), zero, zero)
    got = spark.range(8).select(geo.unskewed((zero, zero, zero), move, F.col("id"), 8, 4)[0].alias("x")).collect()
    assert [r.x for r in got] == [4.0, 4.0, 3.0, 3.0, 2.0, 2.0, 1.0, 1.0]


def test_points_are_registered_without_normals(spark):
    rng = np.random.default_rng(9)
    pts = rng.uniform(-20, 20, (300, 3))
    cols = "id long, x double, y double, z double, nx double, ny double, nz double"
    b = spark.createDataFrame([(i, *map(float, p), 0.0, 0.0, 1.0) for i, p in enumerate(pts)], cols)
    known = icp.Pose(icp.rotation_from(np.array([0.002, -0.003, 0.004])), np.array([0.05, -0.03, 0.02]))
    pose = icp.register_points(icp.moved(b, known), b)
    assert np.allclose(pose.rotation @ known.rotation, np.eye(3), atol=1e-6) and pose.error < 1e-4
    assert icp.rigid_fit(spark.createDataFrame([], "a_x double, a_y double, a_z double, b_x double, b_y double, b_z double, w double")).rounds == 0


def test_ids_are_filled_by_two_agreeing_neighbours(spark):
    # the middle of a cross; None is no neighbour's value
    cases = {(1, 1, 1, 1): 1, (1, 1, 2, 3): 1, (1, 1, 2, 2): None, (1, 2, 3, 4): None, (2, 1, 3, 3): 3, (1, 1, None, None): None, (1, 1, 1, None): 1, (1, 2, None, None): None, (5, None, None, None): None}
    rows = []
    for f, (left, right, up, down) in enumerate(cases):
        rows += [(f, 1, 0, 1.0, left), (f, 1, 2, 1.0, right), (f, 0, 1, 1.0, up), (f, 2, 1, 1.0, down), (f, 1, 1, 1.0, None)]
    got = audit.fill_from_neighbours(spark.createDataFrame(rows, "frame int, row int, col int, dist double, v int"), "v")
    assert {r.frame: r.filled for r in got.where("row = 1 and col = 1").collect()} == dict(enumerate(cases.values()))


def test_correspondences_drop_the_farthest_tenth(spark):
    m = spark.createDataFrame([("a", float(i), 2.0 * i, 1.0) for i in range(10)] + [("a", 99.0, 0.0, 0.0), ("b", 1.0, 1.0, 0.0)], "g string, dist double, err double, weight double")
    first = audit.correspondence_stats(m, ["g"], reject=False).collect()
    assert [(r.g, r.n, r.cut, r.mean_dist, r.mean_err, r.kept_dist) for r in first] == [("a", 11, 9.0, 4.5, 9.0, 4.5)]
    later = audit.correspondence_stats(m, ["g"]).first()
    assert later.cut == 9.0 and np.isclose(later.std_dist, np.std(np.arange(10))) and np.isclose(later.outliers, 1 / 11)


def test_audit_names_orphans_and_uneven_frames(spark):
    p = spark.createDataFrame([(1, 2.0, 7), (1, None, 7), (1, None, None), (2, 1.0, 3)], "frame int, dist double, segment int")
    s = spark.createDataFrame([(1, 7, 1), (2, 3, 1), (3, 9, 4)], "frame int, segment int, n long")
    got = {r.frame: (r.pixels, r.returns, r.assigned, r.referenced, r.orphans, r.uneven) for r in audit.frame_audit(p, s).collect()}
    assert got == {1: (3, 1, 2, 1, 1, True), 2: (1, 1, 1, 1, 0, False), 3: (0, 0, 0, 4, 0, True)}


def test_multiscale_holds_an_edge_to_the_better_cover(spark):
    df = spark.createDataFrame([(1, 0, c, s, t) for c, s, t in ((0, 0.9, 0.1), (1, 0.8, 0.3), (2, 0.7, None))], "frame int, row int, col int, s double, t double")
    got = {r.col: r.multi for r in segments.multiscale(df, "s", "t").collect()}
    assert got == {0: 0.9, 1: 0.3, 2: 0.7}


def test_azimuth_is_that_of_the_c_library(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x), float(y)) for x, y in zip(rng.integers(0, 40000, 2000) / 100 / 100, rng.integers(0, 1000, 2000) / 250, strict=True)]
    got = spark.createDataFrame(rows, "x double, y double").select("x", "y", geo.azimuth(F.col("y"), F.col("x")).alias("a"), F.atan2("y", "x").alias("b")).collect()
    assert all(r.a == math.atan2(r.y, r.x) for r in got) and any(r.a != r.b for r in got)


def test_angles_are_followed_beyond_half_a_turn_and_the_poles(spark):
    rows = [(a, b, c) for a in (-8.0, -0.5, 0.0, 3.5, 7.0) for b in (-4.0, -1.0, 0.0, 1.4, 1.7, 5.0) for c in (0.0, 0.3, 3.4)]
    df = spark.createDataFrame(rows, "yaw double, pitch double, roll double")
    at = [F.col(c) for c in df.columns]
    zero = F.lit(0.0)
    near = geo.pose_angles_near(geo.pose_matrix(*at, zero, zero, zero), *[c + 0.01 for c in at])
    for r in df.select(*at, F.array(*near).alias("got")).collect():
        assert np.allclose(r.got, r[:3], atol=1e-9)
