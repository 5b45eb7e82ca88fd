"""Folders of drives and files of points, written as fixtures."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanfold.functions.text import parse_ns
from scanfold.sources import datasets, files, pointfiles, rangeimg


def _image(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(rangeimg.encode_png(np.full((2, 3), value)))


def _slam(base, n_images, n_records):
    for i in range(n_images):
        _image(base / f"scan{i:03d}.png", 500 * (i + 1))
    _image(base / "intens001.png", 1)
    _image(base / "mask.png", 1)
    head = ["scans", "===", "", "", "", "", "", ""]
    full = [f"2011-07-14 13:52:3{i}.5; 9; 49.0; 8.4; 110.5; 0.{i}; 0.01; 0.02; 1; 1; 1; 1; 1; 1; {i}.0; 2.0; 3.0" for i in range(n_records)]
    (base / "imu.cfg").write_text("\n".join([*head, *full[:-1], full[-1].split(";")[0]]) + "\n")
    (base / "img.cfg").write_text("# image\n\n3; 2; 180; -180; -10; 10\n")


def test_projection_files_by_their_number_of_fields():
    a = datasets.projection("870 64 180 -180 -10 20".split())
    assert (a.width, a.height, a.multiplier, a.rows) == (870, 64, None, None) and a.v_stop == pytest.approx(math.radians(20))
    assert datasets.projection("500 870 64 180 -180 -10 20".split()).multiplier == 500
    b = datasets.projection("870 3 180 90 -2 1 5".split())
    assert b.rows is None and b.multiplier == 870  # seven fields are always regular, whatever the image's rows
    c = datasets.projection("870 4 180 -180 -2 1 5 9".split())
    assert c.multiplier is None and c.rows == pytest.approx([math.radians(v) for v in (-2, 1, 5, 9)])
    d = datasets.projection("500 870 4 180 -180 -2 1 5 9".split())
    assert (d.width, d.multiplier, len(d.rows)) == (870, 500, 4)
    for bad in ("870 64 180", "870 64 180 -180 1 2 3 4 5", "870 64 -180 180 -10 20", "870 64 180 -180 20 -10"):
        with pytest.raises(ValueError, match="fields|must run"):
            datasets.projection(bad.split())


def test_slam_frames(spark, tmp_path):
    _slam(tmp_path, 4, 3)
    frames, config = datasets.mapping_frames(spark, str(tmp_path))
    got = frames.orderBy("nr").collect()
    assert [r.nr for r in got] == [0, 1, 2] and config.endswith("img.cfg")  # as many as there are records
    assert [r.image.rsplit("/", 1)[1] for r in got] == ["scan000.png", "scan001.png", "scan002.png"]
    assert [r.intensity is not None for r in got] == [False, True, False]
    assert [r.pose_valid for r in got] == [True, True, False] and got[2].lat is None and got[1].yaw == pytest.approx(0.1)
    assert got[1].ts_ns - got[0].ts_ns == 1_000_000_000
    p = datasets.frame_points(spark, frames, str(tmp_path), config, "scan*.png").orderBy("nr", "row", "col").collect()
    assert len(p) == 18 and p[0].dist == 1.0 and math.hypot(p[0].x, p[0].y, p[0].z) == pytest.approx(1.0)
    # pruned: neither contents nor records are read for the names alone
    assert "content" not in files.names(spark, str(tmp_path), ".*")._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "small.cfg").write_text("2; 2; 180; -180; -10; 10\n")
    with pytest.raises(Exception, match="larger than its projection"):
        datasets.frame_points(spark, frames, str(tmp_path), str(tmp_path / "small.cfg"), "scan*.png").collect()


def test_tracking_frames_are_the_second_choice(spark, tmp_path):
    for i in range(3):
        _image(tmp_path / "velodyne_dist" / "data" / f"{i}.png", 500)
    _image(tmp_path / "velodyne_intens" / "data" / "1.png", 7)
    (tmp_path / "velodyne_dist" / "timestamps.txt").write_text("2011-07-14 13:52:31.4\n2011-07-14 13:52:31.5\n")
    frames, config = datasets.mapping_frames(spark, str(tmp_path))
    got = frames.orderBy("nr").collect()
    assert len(got) == 2 and config.endswith("velodyne_config.txt") and got[1].intensity.endswith("1.png") and not got[0].pose_valid
    start = tmp_path / "velodyne_dist" / "timestamps_start.txt"
    start.write_text("2011-07-14 13:52:31.4\n" * 2)
    with pytest.raises(ValueError, match="3 images but 2 times"):
        datasets.tracker_frames(spark, str(tmp_path))
    start.write_text("2011-07-14 13:52:31.4\n" * 3)
    assert datasets.tracker_frames(spark, str(tmp_path)).count() == 3
    with pytest.raises(FileNotFoundError):
        datasets.tracker_frames(spark, str(tmp_path / "none"))
    assert datasets.mapping_frames(spark, str(tmp_path / "none"))[0].count() == 0


def test_tracker_frames_with_poses(spark, tmp_path):
    _slam(tmp_path, 3, 3)
    got = datasets.tracker_frames(spark, str(tmp_path)).orderBy("nr").collect()
    assert [r.image.rsplit("/", 1)[1] for r in got] == ["scan000.png", "scan001.png", "scan002.png"]
    assert got[1].pose[3] == 1.0 and got[1].pose[7] == 2.0 and got[2].pose is None and got[2].ts_ns is None


def test_sphere_and_search_of_rows(spark):
    p = datasets.projection("8 4 180 -180 -20 -5 5 30".split())
    s = p.sphere(spark).collect()
    assert len(s) == 32 and all(math.hypot(r.x, r.y, r.z) == pytest.approx(1) for r in s)
    back = spark.createDataFrame([(float(v),) for v in (-0.36, -0.1, 0.06, 0.5, 1.2)], "a double").select(p.row(F.col("a")).alias("r"))
    assert [r.r for r in back.collect()] == [0, 1, 2, 3, None]


@pytest.mark.parametrize("kind", ["p3d", "p3di", "p3db", "p3dib"])
def test_points_of_each_form(spark, tmp_path, kind, monkeypatch):
    pointfiles.register(spark)
    rows = [(i * 0.1, -i / 3, 1e-7 * i, i % 256) for i in range(1000)] + [(None, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "x double, y double, z double, intensity int").repartition(3)
    to = str(tmp_path / "out")
    for _ in range(2):
        df.write.format("points").mode("append").option("path", to).option("kind", kind).save()
    got = spark.read.format("points").load(to)
    cols = ["x", "y", "z", *(["intensity"] if "i" in kind[3:] else [])]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(r[: len(cols)] for r in rows[:-1] for _ in range(2))
    one = pointfiles.read_points(spark, str(next((tmp_path / "out").iterdir())), 10, 20)
    assert sorted(r.nr for r in one.collect()) == list(range(10, 20))
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith(".")]
    df.write.format("points").mode("overwrite").option("path", to).option("kind", kind).save()
    assert spark.read.format("points").load(to).count() == 1000


def test_failed_writes_leave_no_files(spark, tmp_path):
    pointfiles.register(spark)
    to = tmp_path / "out"
    bad = spark.range(100).select(F.when(F.col("id") == 70, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("points").mode("append").option("path", str(to)).save()
    assert not to.exists() or not list(to.iterdir())
    with pytest.raises(ValueError, match="not a file of points"):
        pointfiles.form("a.txt")


def test_lines_and_names_are_numbered(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.lines(spark, str(tmp_path / "a.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.nr: r.value for r in got} == {i: f"line {i}" for i in range(5000)}
    assert files.lines(spark, str(tmp_path / "b.txt")).count() == 0
    done = files.write_files(spark.createDataFrame([("x/1", b"ab"), ("x/2", b""), (None, b"q"), ("x/3", None)], "name string, content binary"), str(tmp_path / "w"))
    assert sorted(r.length for r in done.collect()) == [0, 2] and (tmp_path / "w/x/1").read_bytes() == b"ab" and not (tmp_path / "w/x/3").exists()


def test_signed_seconds_are_from_now(spark):
    now = F.lit(1_000_000_000_000)
    df = spark.createDataFrame([("+2.5",), ("-1",), ("99999",), ("7",), ("x",)], "s string")
    assert [r.n for r in df.select(parse_ns(F.col("s"), now).alias("n")).collect()] == [1_002_500_000_000, 999_000_000_000, 99999, 0, 0]
    assert [r.n for r in df.select(parse_ns(F.col("s")).alias("n")).collect()] == [0, 0, 99999, 0, 0]
