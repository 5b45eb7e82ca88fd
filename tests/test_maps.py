"""Maps that grow scan by scan."""

from __future__ import annotations

import pytest

from scanfold.sources import pointfiles
from scanfold.streaming.maps import CubeMap


def _scan(spark, xs, first=0):
    return spark.createDataFrame([(first + i, float(x), 0.5, 0.5, 0.5) for i, x in enumerate(xs)], "id long, x double, y double, z double, conf double")


def _cells(m):
    return {(r.ix, r.hits, r.id) for r in m.table().collect()}


def test_cubes_that_a_scan_does_not_touch_stay(spark, tmp_path):
    m = CubeMap(spark, str(tmp_path / "m"), 1.0, 5.0, side=4)
    assert m.add(_scan(spark, [0.5, 3.5]), (0, 0, 0)) and not m.add(_scan(spark, [0.5]), (0.01, 0, 0))
    assert m.add(_scan(spark, [9.5, 9.6], 10), (10, 0, 0))
    assert _cells(m) == {(0, 1, 0), (3, 1, 1), (9, 2, 10)}
    assert m.manifest().cubes == {"0_0_0": 0, "2_0_0": 1}
    assert m.add(_scan(spark, [0.5], 20), (1, 0, 0)) and m.manifest().cubes == {"0_0_0": 2, "2_0_0": 1}
    assert (0, 2, 0) in _cells(m)
    # a repeated version changes nothing, and replaced versions go after a while
    assert not m.add(_scan(spark, [0.5], 30), (2, 0, 0), version=2) and (0, 2, 0) in _cells(m)
    assert (tmp_path / "m/v0/cube=0_0_0").exists()
    for k in range(3):
        m.add(_scan(spark, [3.5], 40 + k), (3 + k, 0, 0))
    assert not (tmp_path / "m/v0/cube=0_0_0").exists() and (3, 4, 1) in _cells(m)


def test_cells_out_of_sight_go_to_files(spark, tmp_path):
    m = CubeMap(spark, str(tmp_path / "m"), 1.0, 5.0, side=4, evicted=str(tmp_path / "gone"), margin=1.0)
    m.add(_scan(spark, [0.5, 0.6, 1.5]), (0, 0, 0))
    m.add(_scan(spark, [20.5], 10), (20, 0, 0))
    assert _cells(m) == {(20, 1, 10)}
    gone = pointfiles.read_points(spark, str(tmp_path / "gone")).collect()
    assert [r.x for r in gone] == [0.5]  # hit twice; the other was hit once


def test_full_scans_may_replace_the_map(spark, tmp_path):
    m = CubeMap(spark, str(tmp_path / "m"), 1.0, 50.0)
    m.add(_scan(spark, [0.5]), (0, 0, 0))
    m.add(_scan(spark, [2.5], 5), (1, 0, 0), valid=0.5, renew=True)
    assert {c[0] for c in _cells(m)} == {0, 2}
    m.add(_scan(spark, [3.5], 9), (2, 0, 0), valid=0.9, renew=True)
    assert _cells(m) == {(3, 1, 9)}


def test_a_failed_batch_changes_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    m = CubeMap(spark, str(tmp_path / "m"), 1.0, 50.0)
    m.add(_scan(spark, [0.5]), (0, 0, 0))
    bad = _scan(spark, [0.5], 5).withColumn("conf", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        m.add(bad, (1, 0, 0))
    assert _cells(m) == {(0, 1, 0)} and m.manifest().version == 0
    empty = CubeMap(spark, str(tmp_path / "n"), 1.0, 50.0)
    assert empty.table().count() == 0 and empty.add(_scan(spark, [0.5]).limit(0), (0, 0, 0)) and empty.table().count() == 0
