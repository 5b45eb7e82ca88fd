"""Lives of tracks: the fold of frames, and the stream against the table."""

from __future__ import annotations

import random

import pytest

from scanfold.operators.merging import IGNORE, KEEP, MERGE
from scanfold.streaming.lifecycle import DECISION, INPUT, SEGMENT, UPDATE, Drive, Rules, Track, life_of_drives, life_stream, live


def _seg(angle, points=9):
    return (SEGMENT, None, angle, points, None, None)


def test_the_first_track_is_the_world_and_others_are_decided_on():
    d, rules = Drive(), Rules(steps=2, idle_most=5)
    assert [(u, e, t.points) for u, e, t in live(d, 0, [_seg(1.0), _seg(-1.0)], rules)] == [(1, "new", 18)]
    assert [(u, e) for u, e, _ in live(d, 1, [_seg(0.5, 7), _seg(-0.5, 8)], rules)] == [(2, "new"), (3, "new")]
    assert d.tracks[2].points == 8 and d.tracks[1].buffer == 1
    got = list(live(d, 2, [(UPDATE, 1, None, 30, None, None), _seg(0.1)], rules))
    assert [(u, e) for u, e, _ in got] == [(1, "kept"), (4, "new")] and not d.tracks[1].moving and d.tracks[1].points == 30
    got = list(live(d, 3, [(DECISION, 2, None, None, MERGE, 1), (DECISION, 3, None, None, KEEP, None)], rules))
    assert [(u, e) for u, e, _ in got] == [(2, "merged"), (3, "kept")] and d.tracks[1].points == 38 and d.tracks[3].moving
    assert [(u, e) for u, e, _ in live(d, 4, [(DECISION, 4, None, None, MERGE, 77)], rules)] == [(4, "ignored")]
    assert list(live(d, 4, [_seg(0.0)], rules)) == []  # a repeated frame
    assert [(u, e) for u, e, _ in live(d, 7, [], rules)] == [(1, "dropped"), (3, "dropped")] and not d.tracks
    assert [u for u, _, _ in live(d, 8, [_seg(0.0), _seg(1.0)], rules)] == [5]


def test_without_tracking_each_frame_is_one_track():
    d = Drive()
    assert [len(list(live(d, k, [_seg(0.0), _seg(1.0)], Rules(tracking=False)))) for k in range(3)] == [1, 1, 1]
    d = Drive(tracks={1: Track(3, 9, 0, 2, False)}, frame=0)
    assert [e for _, e, _ in live(d, 1, [], Rules())] == ["dropped"]


def _rows():
    rng = random.Random(8)
    rows = []
    for drive in (1, 2, 3):
        for frame in range(12):
            rows += [(drive, frame, SEGMENT, None, rng.uniform(-3, 3), rng.randint(2, 30), None, None) for _ in range(rng.randint(0, 3))]
            rows += [(drive, frame, UPDATE, rng.randint(1, 8), None, rng.randint(2, 40), None, None) for _ in range(4)]
            rows += [(drive, frame, DECISION, u, None, None, rng.choice([IGNORE, KEEP, MERGE]), rng.randint(1, 4)) for u in range(1, 25)]
    return rows


def test_stream_equals_table(spark, tmp_path):
    rules = Rules(steps=2, idle_most=4)
    rows = _rows()
    df = spark.createDataFrame([*rows, (None, 1, SEGMENT, None, 0.0, 9, None, None)], INPUT)
    want = sorted(tuple(r) for r in life_of_drives(df, rules).collect())
    assert {r[3] for r in want} == {"new", "kept", "merged", "ignored", "dropped"}
    assert life_of_drives(df.limit(0), rules).count() == 0
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(4):  # three frames a batch
            spark.createDataFrame([r for r in rows if r[1] // 3 == k], INPUT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = life_stream(stream, rules).writeStream.format("memory").queryName("lives").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(240)
            assert q.exception() is None
        finally:
            q.stop()
        assert sorted(tuple(r) for r in spark.table("lives").collect()) == want
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("steps", [1, 3])
def test_every_track_ends_once(spark, steps):
    got = life_of_drives(spark.createDataFrame(_rows(), INPUT), Rules(steps=steps)).collect()
    for drive in (1, 2, 3):
        own = [r for r in got if r.drive == drive]
        new = [r.uid for r in own if r.event == "new"]
        assert new == sorted(set(new)) and new[0] == 1
        ended = [r.uid for r in own if r.event in ("merged", "ignored", "dropped")]
        assert len(ended) == len(set(ended)) and set(ended) <= set(new)


def test_a_frame_does_not_touch_tracks_to_which_nothing_happens():
    d, rules = Drive(), Rules(steps=1, idle_most=1 << 30, policy=lambda uid, track: (KEEP, None))
    for k in range(50):
        list(live(d, k, [_seg(0.0)], rules))
    old = d.tracks[7]
    assert d.own(old).age == 43
    got = list(live(d, 60, [(UPDATE, 9, None, 2, None, None)], rules))
    assert d.tracks[7] is old and d.own(old).age == 44
    assert [(u, e, t.age) for u, e, t in got] == [(50, "kept", 1)]
    assert [(u, e, t.age) for u, e, t in live(d, 61, [], rules)] == [(9, "dropped", 43)]
