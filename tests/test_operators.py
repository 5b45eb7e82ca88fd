"""Scan operators on small literal scenes."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanfold.functions import geo, text
from scanfold.functions.cells import cell_index
from scanfold.functions.soft import soft_threshold
from scanfold.operators import grid, icp, image, kdtree, knn, learn, links, segments, tracks


def points(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, x double, y double, z double")


# The points of a known case of grid cells.
GRID = [(0.01, 0, 0), (0, 0.02, 0), (0, 2, 0), (0, 2, 0), (0.05, 0, 2), (2.01, 0, 0), (2.03, 0, 0), (2.02, 0, 0), (0, 2.01, 0), (0, 2.02, 0), (1, 0, 0)]


def test_cells_of_the_grid_fixture(spark):
    p = grid.with_cells(points(spark, GRID), 0.1)
    got = {(r.ix, r.iy, r.iz): r["count"] for r in p.groupBy("ix", "iy", "iz").count().collect()}
    assert got == {(0, 20, 0): 4, (20, 0, 0): 3, (0, 0, 0): 2, (0, 0, 20): 1, (10, 0, 0): 1}


@pytest.mark.parametrize(("x", "cell"), [(-0.05, -1), (-0.1, -2), (0.0, 0), (0.1, 1), (-0.25, -3), (None, None)])
def test_negative_multiples_fall_one_cell_lower(spark, x, cell):
    assert spark.createDataFrame([(x,)], "x double").select(cell_index(F.col("x"), 0.1).alias("c")).first().c == cell


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    xyz = np.concatenate((rng.normal(size=(60, 3)), rng.normal(size=(3, 3)) + 40))
    p = points(spark, xyz)
    got = {(r.id, r.nth): r.near_id for r in knn.knn(p, p, 3).collect()}
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, k + 1): j for i in range(len(xyz)) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    assert got == want
    counts = {r.id: r.n for r in knn.radius_count(p, 1.0).collect()}
    assert counts == {i: int((d[i] <= 1).sum()) for i in range(len(xyz))}


def _nearest_brute(rows, k):
    out = {}
    for i, *a in rows:
        d = sorted((sum((p - q) ** 2 for p, q in zip(a, b, strict=True)), j) for j, *b in rows if j != i)
        out |= {(i, n + 1): j for n, (_, j) in enumerate(d[:k])}
    return out


def test_knn_reaches_outliers_and_splits_dense_cells(spark):
    rng = np.random.default_rng(4)
    rows = [(0, 0.0, 0.0, 0.0), (1, 0.1, 0.0, 0.0), (2, 1000.0, 0.0, 0.0), (3, -5e5, 7.0, 0.0)]
    rows += [(10 + i, *map(float, rng.normal(3, 0.01, 3))) for i in range(300)]
    p = spark.createDataFrame([*rows, (900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0), (902, float("inf"), 0.0, 0.0)], "id long, x double, y double, z double")
    assert {(r.id, r.nth): r.near_id for r in knn.knn(p, p, 3).collect()} == _nearest_brute(rows, 3)
    few = p.where("id in (0, 1, 2)")
    assert {(r.id, r.nth): r.near_id for r in knn.knn(few, few, 5).collect()} == _nearest_brute(rows[:3], 5)
    assert knn.knn(p.limit(0), p, 2).count() == 0 and knn.knn(p, p.limit(0), 2, same_table=False).count() == 0


@pytest.mark.parametrize("extra", [None, {"nx": 2.0}])
def test_knn_over_many_leaves(spark, monkeypatch, extra):
    monkeypatch.setattr(kdtree, "SMALL", 10)
    monkeypatch.setattr(kdtree, "LEAF", 40)
    monkeypatch.setattr(kdtree, "DEALT", 50)
    rng = np.random.default_rng(9)
    xyz = np.concatenate((rng.normal(size=(150, 3)), rng.normal(3, 0.001, size=(150, 3)), np.ones((120, 3)), [[1e5, 0, 0], [-1e9, 3, 3]]))
    rows = [(i, *map(float, x), float(n)) for i, (x, n) in enumerate(zip(xyz, rng.normal(size=len(xyz)).round(1), strict=True))]
    p = spark.createDataFrame([*rows, (900, 0.0, 0.0, None, 1.0), (901, 0.0, 0.0, 0.0, None)], "id long, x double, y double, z double, nx double")
    got = {}
    for r in knn.knn(p, p, 4, extra=extra).collect():
        got.setdefault(r.id, []).append((r.nth, r.near_id))
    cols = np.array([r[1:] for r in rows]) * [1, 1, 1, 2.0 if extra else 0.0]
    d = ((cols[:, None] - cols[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {i: [(n + 1, int(j)) for n, j in enumerate(np.argsort(d[i], kind="stable")[:4])] for i in range(len(rows))}
    if not extra:  # only the extra column is null
        got.pop(901)
        got = {i: v for i, v in got.items() if not any(j == 901 for _, j in v)}
        want = {i: want[i] for i in got}
        assert len(want) > 400
    assert {i: sorted(v) for i, v in got.items()} == want


def test_knn_leaves_out_nulls_of_extra_columns(spark):
    p = spark.createDataFrame([(1, 0.0, None), (2, 1.0, 0.0), (3, 1.1, 0.0), (4, 2.0, 0.0)], "id long, x double, nx double").selectExpr("*", "0D as y", "0D as z")
    assert {r.id: r.near_id for r in knn.knn(p, p, 1, extra={"nx": 2.0}).collect()} == {2: 3, 3: 2, 4: 3}


def test_knn_of_equal_points_and_a_far_one(spark):
    rows = [(i, 1.0, 1.0, 1.0) for i in range(60)] + [(60, 1e5, 0.0, 0.0)]
    got = {r.id: r.near_id for r in knn.knn(*[spark.createDataFrame(rows, "id long, x double, y double, z double")] * 2, 1).collect()}
    assert got == {i: int(i == 0) for i in range(61)} | {60: 0}


def test_gap_filling_rules(spark):
    row = [1.0, None, None, 1.3, None, 0.2, None, None, None, None, None, 0.2, None, 9.0, None]
    rows = spark.createDataFrame([(1, i + 1, d) for i, d in enumerate(row)], "frame long, col int, dist double")
    got = [r.dist for r in image.fill_gaps(rows, 5, 0.5).orderBy("col").collect()]
    # a steep rise stays open, a fall does not (the slope is signed), five pixels are too wide, an end has no far side
    assert got[1:3] == pytest.approx([1.15, 1.3]) and got[4] == pytest.approx(0.2)
    assert got[6:11] == [None] * 5 and got[12] is None and got[14] is None


def test_stencils(spark):
    rows = spark.createDataFrame([(1, r, c, float(10 * r + c) if (r, c) != (1, 1) else None) for r in range(3) for c in range(3)], "frame long, row int, col int, dist double")
    med = {(r.row, r.col): r.median for r in image.median4(rows).collect()}
    assert med[0, 0] == 1.0 and med[1, 1] is None and med[2, 2] in (21.0, 22.0)
    der = {(r.row, r.col): r.d for r in image.derivative(rows).collect()}
    assert der[0, 0] == -1.0 and der[1, 0] is None and der[0, 2] is None
    assert image.match_features(rows).where("row = 0 and col = 0").first().col_after == 2.0
    assert image.match_features(rows).where("row = 0 and col = 0").first().col_before == 5.0


def test_segments_of_two_boxes(spark):
    rows = [(7, r, c, 5.0 if c < 4 else (9.0 if r < 2 else None)) for r in range(4) for c in range(8)]
    got = segments.segment_frames(spark.createDataFrame(rows, "frame long, row int, col int, dist double"), 1.0)
    stats = {r.segment: (r.n, r.mdist) for r in segments.segment_stats(got).collect()}
    assert stats == {0: (16, 5.0), 4: (8, 9.0)}
    assert [(r.a, r.b, r.nearest) for r in segments.segment_neighbours(got).collect()] == [(0, 4, 4.0)]


def test_soft_threshold_is_half_at_the_step(spark):
    row = spark.range(1).select(soft_threshold(F.lit(2.0), 2.0, 3.0).alias("a"), soft_threshold(F.lit(-1e9), 2.0, 3.0).alias("b")).first()
    assert row.a == 0.5 and row.b == pytest.approx(1.0)


def test_pose_round_trip(spark):
    m = geo.pose_matrix(*[F.lit(v) for v in (0.3, -0.2, 0.1, 1.0, 2.0, 3.0)])
    inv = geo.invert_pose(m)
    back = geo.transform_point(inv, *geo.transform_point(m, F.lit(4.0), F.lit(5.0), F.lit(6.0)))
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate((*back, *geo.pose_angles(m)))]).first()
    assert list(row) == pytest.approx([4, 5, 6, 0.3, -0.2, 0.1])


def test_angles(spark):
    a = F.col("a")
    df = spark.createDataFrame([(3.1,), (-3.1,), (0.0,)], "a double")
    assert [r.b for r in df.select(geo.regular_bin(a, math.pi, -math.pi, 4).alias("b")).collect()] == [0, 3, 2]
    assert [r.b for r in df.select(geo.nearest_angle(a, [-0.2, 0.1, 0.4]).alias("b")).collect()] == [None, None, 1]


def test_icp_finds_the_move(spark):
    rng = np.random.default_rng(1)
    xyz, n = rng.uniform(-10, 10, (250, 3)), rng.normal(size=(250, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    p = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(xyz, n, strict=True))], "id long, x double, y double, z double, nx double, ny double, nz double")
    start = icp.Pose(icp.rotation_from(np.array([0.01, -0.01, 0.02])), np.array([0.1, -0.05, 0.05]))
    pose = icp.register(icp.moved(p, start), p, most_rounds=5)
    assert np.allclose(pose.rotation @ start.rotation, np.eye(3), atol=1e-3)
    assert np.allclose(pose.rotation @ start.translation + pose.translation, 0, atol=1e-2)


def test_kalman_finds_the_velocity(spark):
    rows = [(1, k, 0.1 * k, -0.2 * k) for k in range(60)] + [(2, k, None if k == 3 else 1.0, 1.0) for k in range(6)]
    got = tracks.kalman_tracks(spark.createDataFrame(rows, "uid long, step int, x double, y double")).toPandas()
    last = got[(got.uid == 1) & (got.step == 59)].x.iloc[0]
    assert last[2] == pytest.approx(1.0, abs=0.05) and last[3] == pytest.approx(-2.0, abs=0.05)
    assert list(got[got.uid == 2].sort_values("step").measured) == [True, True, True, False, True, True]


def test_decimation_keeps_the_last_kept_pose(spark):
    xs = [0.0, 0.3, 0.6, 0.9, 1.2, 5.0, 5.1]
    got = tracks.keep_moved(spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate(xs)], "uid long, step int, x double, y double"), 0.5)
    assert [r.step for r in got.orderBy("step").collect()] == [0, 2, 4, 5]


def test_links(spark):
    a = spark.createDataFrame([(1, "a", 3), (1, "b", 3), (2, "a", 1)], "src long, dst string, strength long")
    assert {(r.src, r.dst) for r in links.best_link(a).collect()} == {(1, "b"), (2, "a")}
    assert {(r.src, r.dst) for r in links.best_link(a, last=False).collect()} == {(1, "a"), (2, "a")}
    alive = spark.createDataFrame([("a",)], "dst string")
    assert {tuple(r) for r in links.merge_links([a, a], alive).select("src", "dst", "strength").collect()} == {(1, "a", 6), (2, "a", 2)}
    assert links.to_graphml(a).where("part = 3").count() == 3


def test_pca_of_the_fixture(spark):
    df = spark.createDataFrame([(x, y) for x, y in zip((1.0, 2.0, 0.0, 1.0, 2.0, 0.0), (3.0, 2.0, 2.0, -1.0, 0.0, 0.0), strict=True)], "a double, b double")
    _, values, axes = learn.pca(df, ["a", "b"])
    assert values == pytest.approx([2.4, 0.8]) and abs(axes[0]) == pytest.approx([0, 1])


def test_normaliser_and_labels(spark):
    v = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(11)], "id long, f array<double>")
    fit = learn.minmax_fit(v, 0.1)
    assert {r.dim: (r.lo, r.hi) for r in fit.collect()} == {0: (1.0, 9.0), 1: (0.0, 1.0)}
    assert {r.id: r.value for r in learn.minmax_apply(v, fit).where("dim = 0").collect()}[10] == 1.0
    top = learn.label_top2(spark.createDataFrame([(1, x) for x in (0, 0, 0, 2, 2, 3, None)], "g int, label int"), ["g"]).first()
    assert (top.total, top["mode"], top.lead) == (7, 2, 1)


def test_election_depends_on_centre_range_and_confidence(spark):
    rows = [(0, 0.1, 0.1, 0.1, 0.5), (1, 0.5, 0.5, 0.5, 0.5), (2, 0.52, 0.5, 0.5, 0.6)]
    got = grid.elect(spark.createDataFrame(rows, "id long, x double, y double, z double, conf double"), 1.0).first()
    # the second gains (1.2 - 0) / 1.5 by its place and loses (0.866 - 0.173) / 0.173 by its range; so does the third
    assert got.hits == 3 and got.id == 0
    near = [(0, 0.9, 0.9, 0.9, 0.5), (1, 0.5, 0.5, 0.5, 0.5), (2, 0.52, 0.5, 0.5, 0.6)]
    assert grid.elect(spark.createDataFrame(near, "id long, x double, y double, z double, conf double"), 1.0).first().id == 1


def test_texts(spark):
    df = spark.createDataFrame([("/a/b.c/d.tar.gz", "2010-02-03 04:05:06.123456789"), ("plain", "123456"), ("x/", "bad")], "p string, t string")
    got = df.select(text.file_name(F.col("p")), text.file_folder(F.col("p")), text.file_extension(F.col("p")), text.parse_ns(F.col("t")), F.size(text.tokens(F.col("p"), "/."))).collect()
    assert [tuple(r) for r in got] == [("d.tar.gz", "/a/b.c/", ".gz", 1265169906123456789, 6), ("plain", "", "", 123456, 1), ("", "x/", "", 0, 2)]
    rgb = spark.range(1).select(*text.hsv_to_rgb(text.hue_of(F.lit(1.0), 0.0, 2.0))).first()
    assert tuple(rgb) == pytest.approx((0.0, 1.0, 0.0))


def test_normals_of_a_plane(spark):
    from scanfold.operators import surface

    rows = [(1, r, c, math.sqrt(25 + (c - 3) ** 2 + (r - 2) ** 2), 5.0, 3.0 - c, 2.0 - r, 1.0, 1.0) for r in range(5) for c in range(7)]
    p = spark.createDataFrame(rows, "frame long, row int, col int, dist double, x double, y double, z double, wh double, wv double")
    got = surface.normal_confidence(surface.normals(p)).where("row between 1 and 3 and col between 1 and 5").collect()
    assert len(got) == 15
    assert all((r.nx, r.ny, r.nz) == pytest.approx((-1, 0, 0)) and r.conf == pytest.approx(1) for r in got)


def test_lives_of_tracks(spark):
    from scanfold.operators import lifecycle

    t = spark.createDataFrame([(1, 5, 99), (2, 5, 60), (3, 5, 98)], "uid long, age int, last_update int")
    n = spark.createDataFrame([(1, 10), (2, 10), (3, 1)], "uid long, points int")
    assert [(r.uid, r.age) for r in lifecycle.age_tracks(t, n, 100).collect()] == [(1, 6)]
    a = spark.createDataFrame([(1, 0.1, 0.1, 0.1)], "id long, x double, y double, z double")
    b = spark.createDataFrame([(7, 0.2, 0.2, 0.2), (8, 3.1, 0.1, 0.1), (9, 3.2, 0.1, 0.1)], a.schema)
    assert {r.id for r in lifecycle.merge_points(a, b, 1.0).collect()} == {1, 8}
    s = lifecycle.new_states(spark.createDataFrame([(4, 1.0, 2.0, 3.0), (4, 3.0, 2.0, 3.0)], "segment long, x double, y double, z double")).first()
    assert s.x[3:6] == [2.0, 2.0, 3.0] and len(s.p) == 144
    draws = np.array([r.v for r in lifecycle.normal_sample(spark.range(4000), [1.0, -1.0], [[2.0, 1.0], [1.0, 1.0]], 3).collect()])
    assert np.allclose(draws.mean(0), [1, -1], atol=0.15) and np.allclose(np.cov(draws.T), [[2, 1], [1, 1]], atol=0.2)


def test_noise_and_kernels(spark, tmp_path):
    from scanfold import params
    from scanfold.operators import kernels, noise

    table = noise.sigma_table(spark, draws=200, bins=8)
    got = {(r.i, r.j): r.sigma for r in table.collect()}
    assert len(got) == 64 and got[0, 0] > got[7, 7] > 0
    assert got == {(r.i, r.j): r.sigma for r in noise.sigma_table(spark, draws=200, bins=8).repartition(3).collect()}
    rows = spark.createDataFrame([(10.0, 0.1, 0.1), (10.0, 99.0, 0.1), (None, 0.1, 0.1)], "dist double, side_a double, side_b double")
    assert [r.sigma for r in noise.with_sigma(rows, table, bins=8).orderBy(F.desc("dist"), "side_a").collect()] == [got[0, 0], math.pi / 2, math.pi / 2]
    cov = spark.range(1).select(noise.point_covariance(F.lit(10.0), F.lit(0.0), F.lit(0.0), 0.1, 0.01).alias("c")).first().c
    assert cov == pytest.approx([0.01, 0, 0, 0, 0.01, 0, 0, 0, 0.01])
    f = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],)], "f array<double>")
    plane = kernels.KernelPlane([[1.0, 0.0], [0.0, 1.0]], [1.0, -1.0], 0.0, gamma=0.5)
    got = kernels.vote(f, {(1, 2): plane}).collect()
    assert [r.label for r in got] == [1, 2] and got[0].decision_1_2 == pytest.approx(1 - math.exp(-1))
    params.save(spark, params.TRACKER, str(tmp_path / "p"))
    assert params.load(spark, str(tmp_path / "p")) == params.TRACKER


def test_ranked_selects_exact_values(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=30_000), np.full(9_000, 0.25), rng.exponential(1e6, 1_001)])
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * len(values) + ["b"] * 4, "v": np.concatenate([values, [3.0, 1.0, 1.0, 2.0]])}))
    df = df.unionAll(spark.createDataFrame([("a", None), ("c", None)], "g string, v double"))
    shares = {"low": 0.05, "mid": 0.5, "high": 0.9, "last": 1.0}
    got = {(r.g, r.name): r.v for r in learn.ranked(df, ["g"], "v", {k: F.lit(s) for k, s in shares.items()}).collect()}
    for g, all_of in (("a", np.sort(values)), ("b", np.array([1.0, 1.0, 2.0, 3.0]))):
        assert {k: got.pop((g, k)) for k in shares} == {k: all_of[min(int(np.floor(len(all_of) * s)), len(all_of) - 1)] for k, s in shares.items()}
    assert not got


def test_segments_span_batches_and_null_frames(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(f, r, c, 1.0 + 5 * (c > 2)) for f in (7, None, 9) for r in range(2) for c in range(5)] + [(11, 0, 0, None)]
        df = spark.createDataFrame(rows, "frame long, row int, col int, dist double")
        got = segments.segment_frames(df, 2.0).groupBy("frame", "segment").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r.frame or 0, r.segment, r["count"]) for r in got)) == [(f, s, n) for f in (0, 7, 9) for s, n in ((0, 6), (3, 4))]
    assert segments.segment_frames(df.limit(0), 2.0).count() == 0


def test_nearest_with_leaves_that_nothing_asks(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SMALL", 10)
    monkeypatch.setattr(kdtree, "LEAF", 20)
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 100, (400, 3))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double")
    asked = [(1000, 1.0, 2.0, 3.0), (1001, 50.0, 50.0, 50.0)]
    got = kdtree.search(kdtree.index(points, ("x", "y", "z")), spark.createDataFrame(asked, "id long, x double, y double, z double"), 1, same_table=False).collect()
    want = {(q[0], int(((x - np.array(q[1:])) ** 2).sum(axis=1).argmin())) for q in asked}
    assert {(r.id, r.near_id) for r in got} == want


def test_merge_features_do_not_depend_on_how_the_table_is_split(spark, tmp_path):
    import duckdb
    import pyarrow.parquet as pq

    from scanfold.plans import catalogue

    pq.write_table(pq.read_table("/root/testdata/sf0.01/lineitem.parquet"), tmp_path / "lineitem.parquet", row_group_size=2000)
    con = duckdb.connect()
    con.execute(f"set threads = 1; create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = {(r.src, r.i): r.value for r in catalogue.queries()["merge_stage1_features"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(a, i): v for a, i, v in con.execute(catalogue.oracle_sql()["merge_stage1_features"]).fetchall()}


def test_nearest_in_a_crowded_cell_makes_no_pairs(spark, monkeypatch):
    def no_pairs(*args):
        raise AssertionError("all pairs of a cell")

    monkeypatch.setattr(grid, "neighbours", no_pairs)
    monkeypatch.setattr(kdtree, "SMALL", 10)
    monkeypatch.setattr(kdtree, "LEAF", 40)
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.uniform(0.5, 4.5, (300, 3)), rng.uniform(-20, 20, (60, 3)), np.ones((5, 3)), [[4.99, 1, 1], [5.01, 1, 1], [99, 9, 9]]))
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double, z double")
    cell = np.trunc(x / 5).astype(int) - (x < 0)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    d2[(cell[:, None] != cell[None]).any(2) | np.eye(len(x), dtype=bool)] = np.inf
    want = {i: int(d2[i].argmin()) for i in range(len(x)) if np.isfinite(d2[i]).any()}
    assert {r.id: r.near_id for r in grid.nearest_in_cell(p, p, 5.0).collect()} == want


def test_normals_shuffle_once(spark, sf_dir):
    from scanfold.plans import catalogue

    plan = catalogue.queries()["normals"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tracks_are_projected_without_a_shuffle_of_points(spark, sf_dir):
    from scanfold.plans import catalogue

    plan = catalogue.queries()["tracks_projected_extended"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert {k.split("#")[0] if "," not in k else k for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)} == {"l_partkey"}
