"""Streams against their batch forms."""

from __future__ import annotations

import pytest

from scanfold.operators import tracks
from scanfold.plans import views
from scanfold.streaming import stateful


@pytest.fixture(scope="module")
def poses(spark, sf_dir):
    return views.poses(spark, sf_dir).where("uid < 6").selectExpr("uid", "cast(step as int) step", "x", "y")


def _run(spark, stream, name, out):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(out)).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name)


def _source(spark, poses, folder):
    n = poses.count()
    for k in range(2):
        poses.where(f"(step <= 3) = {k == 0}").coalesce(1).write.mode("append").parquet(str(folder))
    assert n
    return spark.readStream.schema(poses.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stream_kalman_equals_batch(spark, poses, tmp_path):
    got = {(r.uid, r.step): (r.x, r.y) for r in _run(spark, stateful.stream_kalman(_source(spark, poses, tmp_path / "in")), "kalman", tmp_path / "cp").collect()}
    want = {(r.uid, r.step): (r.x[0], r.x[1]) for r in tracks.kalman_tracks(poses).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_stream_decimation_equals_batch(spark, poses, tmp_path):
    got = {(r.uid, r.step) for r in _run(spark, stateful.stream_keep_moved(_source(spark, poses, tmp_path / "in"), 1.5), "moved", tmp_path / "cp").collect()}
    assert got == {(r.uid, r.step) for r in tracks.keep_moved(poses, 1.5).collect()}


def test_map_sink_accumulates(spark, tmp_path):
    a = spark.createDataFrame([(1, 0.1, 0.1, 0.1, 0.5), (2, 0.2, 0.2, 0.2, 0.9)], "id long, x double, y double, z double, conf double")
    b = spark.createDataFrame([(3, 0.3, 0.3, 0.3, 0.7), (4, 9.0, 0.0, 0.0, 0.1)], a.schema)
    sink = stateful.MapSink(str(tmp_path / "map"), 1.0)
    sink(a, 0)
    sink(b, 1)
    got = {(r.ix, r.iy, r.iz): (r.id, r.hits) for r in spark.read.parquet(sink.path(1)).collect()}
    assert got == {(0, 0, 0): (2, 3), (9, 0, 0): (4, 1)}
    kept, gone = stateful.evict_far(spark.read.parquet(sink.path(1)), (0.0, 0.0, 0.0), 5.0)
    assert (kept.count(), gone.count()) == (1, 1)
