"""Files written by one half of each format and read by the other."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanfold.sources import clouds, rangeimg, textual


def _filtered_png(values: np.ndarray, how: int) -> bytes:
    raw, prev = b"", np.zeros(values.shape[1] * 2, np.uint8)
    for line in values.astype(">u2").view(np.uint8).reshape(len(values), -1):
        left = np.concatenate((np.zeros(2, np.uint8), line[:-2]))
        corner = np.concatenate((np.zeros(2, np.uint8), prev[:-2]))
        a, b, c = (x.astype(int) for x in (left, prev, corner))
        p = a + b - c
        paeth = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        guess = [0 * a, a, b, (a + b) // 2, paeth][how]
        raw += bytes([how]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        prev = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", values.shape[1], len(values), 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("how", range(5))
def test_png_filters(how):
    v = np.random.default_rng(how).integers(0, 65536, (9, 13))
    assert (rangeimg.decode_png(_filtered_png(v, how)) == v).all()
    assert (rangeimg.decode_png(rangeimg.encode_png(v)) == v).all()


def test_range_images(spark, tmp_path):
    v = np.array([[0, 500, 1000], [65535, 250, 0]])
    (tmp_path / "scan1.png").write_bytes(rangeimg.encode_png(v))
    rows = rangeimg.read_range_images(spark, str(tmp_path))
    got = {(r.row, r.col): r.dist for r in rows.collect()}
    assert got[0, 0] is None and got[0, 1] == 1.0 and got[1, 0] == 131.07
    again = rangeimg.encode_frames(rows.withColumn("frame", F.lit(1).cast("long"))).first()
    assert (rangeimg.decode_png(bytes(again.content)) == v).all()
    assert {r.segment for r in rangeimg.read_segment_images(spark, str(tmp_path)).collect()} == {500, 1000, 65535, 250}


def test_delimited(spark, tmp_path):
    (tmp_path / "a.cfg").write_text("# head\n\n1 2;3.5  \n4;;x\n")
    lines = textual.read_delimited(spark, str(tmp_path / "a.cfg"))
    got = lines.select(textual.field(0, "int"), textual.field(1), textual.field(2), textual.field(9)).collect()
    assert [tuple(r) for r in got] == [(1, 2.0, 3.5, None), (4, None, None, None)]
    assert tuple(textual.field_counts(lines).select("lines", "least").first()) == (2, 2)


def test_point_stream_and_cloud(spark, tmp_path):
    (tmp_path / "w.p3d").write_text("1 2 3 4\n5 6 7 8 9 10")
    got = textual.read_point_stream(spark, str(tmp_path / "w.p3d")).orderBy("nr").collect()
    assert [(r.x, r.y, r.z) for r in got] == [(1, 2, 3), (4, 5, 6), (7, 8, 9)]
    (tmp_path / "c.bin").write_bytes(np.array([[1, 0, 0, 0.5], [2, 0, 0, 0.25]], "<f4").tobytes() + b"xx")
    cloud = clouds.read_clouds(spark, str(tmp_path))
    assert [(r.x, r.reflectance) for r in cloud.orderBy("nr").collect()] == [(1, 0.5), (2, 0.25)]
    assert [r.dist for r in clouds.cloud_to_image(cloud, 360, 16, -0.5, 0.5).collect()] == [2.0]
    assert clouds.list_files(spark, str(tmp_path), contains=".p3").count() == 1


def test_map_and_trajectory(spark, tmp_path):
    (tmp_path / "m.txt").write_text("3 1 2 3 0 0 0 0 0 1 0.9 7.5\n4 1 2 3 0 0 0 0 0 1 0.9 7.5 6 200\n")
    m = textual.read_map(spark, str(tmp_path / "m.txt"))
    assert [(r.pose, r.hits, r.intensity) for r in m.orderBy("pose").collect()] == [(3, 1, 0), (4, 6, 200)]
    assert textual.map_lines(m, "points").first().value == "1.0 2.0 3.0"
    t = spark.createDataFrame([(1265169906123456789, [float(i) for i in range(16)])], "ts_ns long, htm array<double>")
    textual.trajectory_lines(t).write.text(str(tmp_path / "t"))
    back = textual.read_trajectory(spark, str(tmp_path / "t")).first()
    assert (back.ts_ns, back.htm) == (1265169906123456789, [float(i) for i in range(16)])


def test_track_lines(spark):
    tracks = spark.createDataFrame([(1, 5, 3, 2, 9, 8, 7, [0.5] * 12, [0.25] * 144), (1, 6, 0, 0, 1, 1, 1, [0.0] * 12, [0.0] * 144)], "frame int, uid long, age int, last_update int, r int, g int, b int, x array<double>, p array<double>")
    # another frame's points of the same track are not its own
    pts = spark.createDataFrame([(1, 5, False, 1, *[1.0] * 7), (1, 5, True, 2, *[2.0] * 7), (2, 5, True, 2, *[9.0] * 7)], "frame int, uid long, vip boolean, nr int, px double, py double, pz double, nx double, ny double, nz double, conf double")
    lines = textual.track_lines(tracks, pts)
    got = {r.uid: r for r in textual.parse_tracks(lines).collect()}
    assert got[5].vips == 1 and [p.px for p in got[5].points] == [2.0, 1.0] and got[5].x == [0.5] * 12 and got[5].age == 3
    assert got[6].points == [] and len(got[6].p) == 144


def test_normaliser_line(spark):
    fit = spark.createDataFrame([(1, 0.5, 2.0), (0, -1.0, 1.0)], "dim int, lo double, hi double")
    line = textual.normalizer_line(fit)
    assert line.first().value == "2 -1.0 1.0 0.5 2.0 1"
    back = textual.parse_normalizer(line.select(F.split("value", " ").alias("fields")))
    assert {r.dim: (r.lo, r.hi) for r in back.collect()} == {0: (-1.0, 1.0), 1: (0.5, 2.0)}
    rows = spark.createDataFrame([([1.0, 2.0], 3)], "f array<double>, label int")
    assert textual.training_lines(rows).first().value == "1.0\t2.0\t-->\t3"


def test_images_are_written_and_read_without_a_listing(spark, tmp_path, sf_dir):
    from scanfold.plans import catalogue
    from scanfold.sources import files

    rows = [(f, r, c, (f + r + c) / 2) for f in (3, 4, 11) for r in range(2) for c in range(f)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        images = rangeimg.encode_frames(spark.createDataFrame(rows, "frame long, row int, col int, dist double"))
        names = images.select(F.concat(F.col("frame") % 2, F.lit("/"), "frame", F.lit(".png")).alias("name"), "content")
        done = spark.createDataFrame(files.write_files(names, f"file://{tmp_path}/i/").collect())
        got = rangeimg.range_images(files.read_files(done, 1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((int(r.path.split("/")[-1][:-4]), r.row, r.col, r.dist or 0.0) for r in got) == rows
    assert "binaryFile" not in catalogue.queries()["range_images_round_trip"](spark, sf_dir)._jdf.queryExecution().toString()
