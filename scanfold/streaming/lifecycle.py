"""Lives of tracks over a stream of frames, by drive.

A drive's state is its last frame, the next uid, and its tracks in a ring of buffers: new tracks start in buffer 0 and move
on by one with each frame; after ``steps`` frames they are decided on, and those that are kept live on as long-term tracks.
The fold of one frame is a plain function on that state; ``life_stream`` keeps the state in Spark's store (a value, a map by
uid and a timer for drives that end), ``life_of_drives`` folds whole drives of a table. Both give the same events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scanfold.operators.merging import IGNORE, KEEP, MERGE
from scanfold.runs import in_runs, starts, whole_runs

SEGMENT, UPDATE, DECISION = "segment", "update", "decision"
#: Rows: a new segment with its angle and points; a track that was measured, with its points now; a decision on a track.
INPUT = "drive long, frame long, kind string, uid long, angle double, points long, decision int, dst long"
EVENTS = "drive long, frame long, uid long, event string, buffer int, age int, points long"
_TRACK = "buffer int, age int, last long, points long, moving boolean"


@dataclass(frozen=True)
class Rules:
    """Frames a young track waits for its decision, frames without a measurement and points at which a track is dropped,
    whether objects are tracked at all (else each frame is one track), and what decides on tracks that no row decides on."""

    steps: int = 3
    idle_most: int = 30
    points_least: int = 3
    tracking: bool = True
    policy: Callable[[int, "Track"], tuple[int, int | None]] | None = None


@dataclass(frozen=True)
class Track:
    buffer: int
    age: int
    last: int
    points: int
    moving: bool


@dataclass
class Drive:
    """``clock`` counts the frames folded since the drive was made or restored; until then a track's age in ``tracks`` is
    its own, later it is less by the clock, so that a frame does not touch tracks to which nothing happens."""

    frame: int = -1
    next_uid: int = 1
    tracks: dict[int, Track] = field(default_factory=dict)
    clock: int = 0
    #: tracks that wait for their decision
    young: set[int] | None = None
    #: (last, uid) of measurements, a heap, and tracks whose points have changed: what may have to be dropped
    idle: list[tuple[int, int]] = field(default_factory=list)
    changed: set[int] = field(default_factory=set)

    def own(self, t: Track) -> Track:
        """A track with its own age."""
        return replace(t, age=t.age + self.clock)

    def measured(self, uid: int, t: Track) -> None:
        self.tracks[uid] = t
        heappush(self.idle, (t.last, uid))
        self.changed.add(uid)


def live(drive: Drive, frame: int, rows: Iterable[tuple], rules: Rules) -> Iterator[tuple[int, str, Track]]:
    """(uid, event, track) of a frame's ``rows`` (kind, uid, angle, points, decision, dst); a frame that is not after the
    drive's last is passed over.

    Tracks age and those idle or of too few points are dropped; measured ones are updated; the oldest young ones are
    ignored, merged (into a track that lives, else ignored) or kept; young ones move on; and the frame's segments become
    tracks in order of their angle. While nothing else lives a frame makes one track, the world.
    """
    if frame <= drive.frame:
        return
    rows = list(rows)
    drive.frame = frame
    drive.clock += 1
    tracks = drive.tracks
    if drive.young is None:
        drive.young = {uid for uid, t in tracks.items() if t.buffer < rules.steps}
        for uid, t in tracks.items():
            drive.measured(uid, t)
    young = drive.young
    suspects, drive.changed = drive.changed, set()
    while drive.idle and frame - drive.idle[0][0] >= rules.idle_most:
        suspects.add(heappop(drive.idle)[1])
    for uid in sorted(suspects & tracks.keys()):
        t = tracks[uid]
        if frame - t.last >= rules.idle_most or t.points <= rules.points_least:
            del tracks[uid]
            young.discard(uid)
            yield uid, "dropped", drive.own(t)
    for kind, uid, _, points, _, _ in rows:
        if kind == UPDATE and uid in tracks:
            drive.measured(uid, replace(tracks[uid], last=frame, points=points))
    decided = {uid: (decision, dst) for kind, uid, _, _, decision, dst in rows if kind == DECISION}
    for uid in sorted(u for u in young if tracks[u].buffer == rules.steps - 1):
        t = tracks[uid]
        decision, dst = decided.get(uid) or (rules.policy(uid, drive.own(t)) if rules.policy else (IGNORE, None))
        settled = len(tracks) > len(young)
        if not settled:  # the first is the world
            decision = KEEP
        if decision == MERGE and (dst not in tracks or dst == uid):
            decision = IGNORE
        young.discard(uid)
        if decision == KEEP:
            tracks[uid] = replace(t, buffer=rules.steps, moving=settled)
            yield uid, "kept", drive.own(tracks[uid])
            continue
        del tracks[uid]
        if decision == MERGE:
            tracks[dst] = replace(tracks[dst], points=tracks[dst].points + t.points)
            drive.changed.add(dst)
        yield uid, "merged" if decision == MERGE else "ignored", drive.own(t)
    for uid in young:
        tracks[uid] = replace(tracks[uid], buffer=tracks[uid].buffer + 1)
    segments = sorted((angle, points) for kind, _, angle, points, _, _ in rows if kind == SEGMENT)
    if segments and (not tracks or not rules.tracking):
        segments = [(0.0, sum(p for _, p in segments))]
    for _, points in segments:
        t = Track(0, 0, frame, points, False)
        drive.measured(drive.next_uid, replace(t, age=-drive.clock))
        young.add(drive.next_uid)
        yield drive.next_uid, "new", t
        drive.next_uid += 1


_NAMES = [c.split()[0] for c in EVENTS.split(", ")]


def _rows(pdf: pd.DataFrame) -> tuple[np.ndarray, list[tuple]]:
    """Frames and rows as ``live`` takes them; a column is converted once, not by frame or row."""
    whole = lambda c: [None if gone else int(v) for v, gone in zip(pdf[c].tolist(), pdf[c].isna().tolist(), strict=True)]
    points = [p or 0 for p in whole("points")]
    angle = pdf["angle"].astype(float).fillna(0.0).tolist()
    return pdf["frame"].to_numpy(np.int64), list(zip(pdf["kind"].tolist(), whole("uid"), angle, points, whole("decision"), whole("dst"), strict=True))


def _folded(drive: Drive, key: int, frame: np.ndarray, rows: list[tuple], rules: Rules) -> list[tuple]:
    """Events of a drive's rows in order of their frames."""
    out = []
    cut = [0, *(np.flatnonzero(np.diff(frame)) + 1).tolist(), len(rows)]
    for a, b in pairwise(cut):
        f = int(frame[a])
        out += [(key, f, uid, event, t.buffer, t.age, t.points) for uid, event, t in live(drive, f, rows[a:b], rules)]
    return out


def life_of_drives(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The events of whole drives, each folded in one task. Rows with a null drive or frame are left out."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_runs(batches):
            (frame, own), drives, out = _rows(pdf), pdf["drive"].tolist(), []
            for a, b in pairwise([*starts(pdf).tolist(), len(pdf)]):
                out += _folded(Drive(), drives[a], frame[a:b], own[a:b], rules)
            yield pd.DataFrame(out, columns=_NAMES)

    return in_runs(rows.where("drive is not null and frame is not null"), "drive", "frame").mapInPandas(fold, EVENTS)


class LifeProcessor(StatefulProcessor):
    def __init__(self, rules: Rules, idle_ms: int):
        self.rules, self.idle_ms = rules, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "frame long, next_uid long")
        self.tracks = handle.getMapState("tracks", "uid long", _TRACK)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame, next_uid = self.at.get() if self.at.exists() else (-1, 1)
        drive = Drive(frame, next_uid, {k[0]: Track(*v) for k, v in self.tracks.iterator()})
        before = dict(drive.tracks)
        pdf = pd.concat(list(rows)).sort_values("frame", kind="stable")
        out = pd.DataFrame(_folded(drive, int(key[0]), *_rows(pdf), self.rules), columns=_NAMES)
        self.at.update((drive.frame, drive.next_uid))
        for uid in before.keys() - drive.tracks.keys():
            self.tracks.removeKey((uid,))
        for uid, t in drive.tracks.items():
            t = drive.own(t)
            if before.get(uid) != t:
                self.tracks.updateValue((uid,), (t.buffer, t.age, t.last, t.points, t.moving))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = [(int(key[0]), self.at.get()[0], k[0], "ended", v[0], v[1], v[3]) for k, v in self.tracks.iterator()]
        self.at.clear()
        self.tracks.clear()
        yield pd.DataFrame(gone, columns=[c.split()[0] for c in EVENTS.split(", ")])

    def close(self) -> None:
        pass


def life_stream(rows: DataFrame, rules: Rules = Rules(), idle_ms: int = 0) -> DataFrame:
    """The events of a stream of rows; a frame's rows arrive in one batch. A drive without rows for ``idle_ms`` ends.

    The session's state store must be the one with column families (RocksDB).
    """
    return rows.where("drive is not null and frame is not null").groupBy("drive").transformWithStateInPandas(LifeProcessor(rules, idle_ms), EVENTS, "append", "processingTime" if idle_ms else "none")
