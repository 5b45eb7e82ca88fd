"""Segments of a range image: connected components over accepted edges, their statistics and neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from scanfold.functions.soft import soft_threshold
from scanfold.runs import in_runs, whole_runs

from .components import components

STRIDE = 100_000  # of rows in the names of pixels; a line has fewer pixels


def pixel_edges(rows: DataFrame, most: float) -> DataFrame:
    """Edges (frame, r1, c1, r2, c2) between neighbouring returns that differ by less than ``most``."""
    return _accepted(rows, lambda axis: F.abs(F.col("nd") - F.col("dist")) < most)


def scored_edges(rows: DataFrame, least: float, across: str = "sh", down: str = "sv") -> DataFrame:
    """Edges between neighbouring returns whose score, to the next column or row, is above ``least``."""
    return _accepted(rows, lambda axis: F.col(across if axis == "col" else down) > least)


def _accepted(rows: DataFrame, rule: Callable[[str], Column]) -> DataFrame:
    out = None
    for axis in ("col", "row"):
        other = "row" if axis == "col" else "col"
        w = Window.partitionBy("frame", other).orderBy(axis)
        e = rows.withColumns({"nd": F.lead("dist").over(w), "nx": F.lead(axis).over(w)}).where((F.col("nx") == F.col(axis) + 1) & F.col("dist").isNotNull() & F.col("nd").isNotNull() & rule(axis))
        e = e.select("frame", F.col("row").alias("r1"), F.col("col").alias("c1"), (F.col("nx") if axis == "row" else F.col("row")).alias("r2"), (F.col("nx") if axis == "col" else F.col("col")).alias("c2"))
        out = e if out is None else out.unionAll(e)
    return out


def segment_by_edges(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(frame, row, col, dist, segment) of each return, as ``segment_frames`` gives it, from accepted edges between pixels.
    Frames may be larger than a task: components are found over the edges of all frames at once."""
    node = lambda r, c: F.struct(F.col("frame").alias("frame"), (F.col(r).cast("long") * STRIDE + F.col(c)).alias("pixel"))
    of = components(edges.select(node("r1", "c1").alias("a"), node("r2", "c2").alias("b")))
    own = rows.where("dist is not null").select("frame", "row", "col", "dist", node("row", "col").alias("node"))
    return own.join(of, "node", "left").select("frame", "row", "col", "dist", F.coalesce("component.pixel", "node.pixel").alias("segment"))


def merge_segments(labelled: DataFrame, pairs: DataFrame, whole: bool = False) -> DataFrame:
    """``labelled`` with the segments that ``pairs`` (frame, a, b) join under the least of their names.

    With ``whole`` a frame and its pairs lie in one task, as in ``segment_frames``, and are not shuffled if both are dealt
    by frame; else frames may be larger than a task."""
    if whole:
        return _merge_whole(labelled, pairs)
    node = lambda c: F.struct(F.col("frame").alias("frame"), F.col(c).alias("segment"))
    of = components(pairs.select(node("a").alias("a"), node("b").alias("b")))
    into = of.select("node.frame", "node.segment", F.col("component.segment").alias("into"))
    return labelled.join(into, ["frame", "segment"], "left").withColumn("segment", F.coalesce("into", "segment")).drop("into").select(*labelled.columns)


def _merge_whole(labelled: DataFrame, pairs: DataFrame) -> DataFrame:
    names = labelled.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_runs(batches):
            one, two = (pdf[c].to_numpy(np.int64) for c in ("segment", "other"))
            nodes, at = np.unique(np.concatenate((one, two)), return_inverse=True)
            # names may be any numbers: frames are told apart by the place of a name
            frame, size, pair = _numbers(pdf), len(nodes), pdf["pair"].to_numpy(bool)
            own, at = np.unique(np.concatenate((frame, frame)) * size + at, return_inverse=True)
            a, b = at[: len(pdf)], at[len(pdf) :]
            into = nodes[own[_least(len(own), a[pair], b[pair])] % size]
            yield pdf.assign(segment=into[a])[~pair][names]

    fill = {f.name: F.lit(0).cast(f.dataType) if isinstance(f.dataType, NumericType) else F.lit(None).cast(f.dataType) for f in labelled.schema}
    ends = pairs.where("a is not null and b is not null").select("frame", *[v.alias(c) for c, v in fill.items() if c not in ("frame", "segment")], F.col("a").alias("segment"), F.col("b").alias("other"), F.lit(True).alias("pair"))
    both = labelled.withColumns({"other": F.col("segment"), "pair": F.lit(False)}).unionByName(ends)
    return in_runs(both, "frame", "pair").mapInPandas(run, labelled.schema)


def merge_neighbours(neighbours: DataFrame, pairs: DataFrame) -> DataFrame:
    """(frame, a, b, score) of merged segments from those before: the greatest score of each pair that is left."""
    node = lambda c: F.struct(F.col("frame").alias("frame"), F.col(c).alias("segment"))
    of = components(pairs.select(node("a").alias("a"), node("b").alias("b"))).select("node.frame", "node.segment", F.col("component.segment").alias("into"))
    n = neighbours
    for c in "ab":
        n = n.join(of.select("frame", F.col("segment").alias(c), "into"), ["frame", c], "left").withColumn(c, F.coalesce("into", c)).drop("into")
    return n.where("a <> b").groupBy("frame", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))


def segment_frames(rows: DataFrame, most: float) -> DataFrame:
    """(frame, row, col, dist, segment) of each return; a segment is named by its first pixel, row * 100000 + col.

    Frames lie together and in order within a partition; rows dealt by frame are not shuffled again. Each Arrow batch
    labels all frames that end in it at once; only the rows of the last, open frame are carried on. Null frames are one frame.
    """

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        place = (pdf["row"].astype("int64") * STRIDE + pdf["col"]).to_numpy(np.int64)
        # places of different frames lie too far apart to touch; a frame's pixels are below the span
        span = int(place.max(initial=0) - place.min(initial=0)) + 2 * STRIDE
        own, dist = _numbers(pdf) * span + place, pdf["dist"].to_numpy()
        a, b = [], []
        for step in (1, STRIDE):
            at = np.minimum(np.searchsorted(own, own + step), max(len(own) - 1, 0))
            ok = (own[at] == own + step) & (np.abs(dist[at] - dist) < most) if len(own) else np.zeros(0, bool)
            a.append(np.flatnonzero(ok)), b.append(at[ok])
        return pdf.assign(segment=place[_least(len(own), np.concatenate(a), np.concatenate(b))])[["frame", "row", "col", "dist", "segment"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_runs(batches):
            yield label(pdf)

    one = rows.select("frame", F.col("row").cast("int"), F.col("col").cast("int"), "dist").where("dist is not null")
    return in_runs(one, "frame", "row", "col").mapInPandas(run, "frame long, row int, col int, dist double, segment long")


def _numbers(pdf: pd.DataFrame) -> np.ndarray:
    """The number of each row's frame among these, the null frame being one too."""
    return np.cumsum(pdf["nth"].to_numpy() == 1)


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches by edges, in sweeps until none changes."""
    of = np.arange(n)
    while True:
        low = np.minimum(of[a], of[b])
        new = of.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == of).all():
            return of
        of = new


def segment_stats(labelled: DataFrame, least: int = 1, near_factor: float = 0.0) -> DataFrame:
    """Pixels, mean place and distance of each segment, of those with at least ``least`` pixels and
    ``near_factor`` / mean distance squared."""
    s = labelled.groupBy("frame", "segment").agg(F.count("*").alias("n"), F.avg("row").alias("mrow"), F.avg("col").alias("mcol"), F.avg("dist").alias("mdist"))
    return s.where((F.col("n") >= least) & (F.col("n") * F.col("mdist") * F.col("mdist") >= near_factor))


def _borders(labelled: DataFrame) -> DataFrame:
    """(frame, a, b, diff) of each pair of neighbouring returns of different segments, a the lesser name. Both neighbours are
    looked up in one pass; a table dealt by frame is not shuffled."""
    near = []
    for axis, other in (("col", "row"), ("row", "col")):
        n = F.lead(F.struct(F.col(axis).alias("at"), "dist", "segment")).over(Window.partitionBy("frame", other).orderBy(axis))
        near.append(F.when(n["at"] == F.col(axis) + 1, n))
    e = labelled.select("frame", "dist", "segment", F.array(*near).alias("near")).withColumn("n", F.explode("near")).where("n.segment <> segment")
    return e.select("frame", F.least("segment", "n.segment").alias("a"), F.greatest("segment", "n.segment").alias("b"), F.abs(F.col("n.dist") - F.col("dist")).alias("diff"))


def segment_neighbours(labelled: DataFrame) -> DataFrame:
    """(frame, a, b, nearest) for each pair of touching segments: the least difference across their border."""
    return _borders(labelled).groupBy("frame", "a", "b").agg(F.min("diff").alias("nearest"))


def segment_neighbour_scores(labelled: DataFrame, score: Callable[[Column], Column]) -> DataFrame:
    """(frame, a, b, score) for each pair of touching segments: the greatest ``score`` of a difference across their border.
    A pair that does not touch has no row; where a score is looked up it counts as -1."""
    return _borders(labelled).groupBy("frame", "a", "b").agg(F.max(score(F.col("diff"))).alias("score"))


def edge_score(n1: tuple[Column, ...], n2: tuple[Column, ...], along: tuple[Column, ...], normal_slope: float = 10.0, normal_at: float = 0.049, convex_at: float = 0.104, convex_slope: float = 1.0) -> Column:
    """Score of an edge between surfaces with unit normals, ``along`` the unit direction from the first to the second:
    the best of both being upright, similar normals and convexity."""
    dot = sum(a * b for a, b in zip(n1, n2, strict=True))
    upright = F.least(1 - F.abs(n1[2]), 1 - F.abs(n2[2]))
    alike = soft_threshold(1 - dot, normal_at, normal_slope)
    c1 = sum(a * b for a, b in zip(n1, along, strict=True))
    c2 = -sum(a * b for a, b in zip(n2, along, strict=True))
    convex = soft_threshold(F.greatest(c1, c2), convex_at, convex_slope)
    return F.greatest(upright, alike, convex)


def hard_edge(n1: tuple[Column, ...], n2: tuple[Column, ...], along: tuple[Column, ...], length: Column, normal_at: float = 0.049, convex_at: float = 0.104, upright_at: float = 0.5) -> Column:
    """Whether an edge holds by fixed thresholds: convex from both ends, normals alike by an angle that grows with the
    edge's length, or both surfaces upright."""
    dot = sum(a * b for a, b in zip(n1, n2, strict=True))
    c1 = sum(a * b for a, b in zip(n1, along, strict=True))
    c2 = -sum(a * b for a, b in zip(n2, along, strict=True))
    alike = dot >= 1 - length * F.sin(F.acos(F.lit(1 - normal_at)))
    return ((c1 <= convex_at) & (c2 <= convex_at)) | alike | ((F.abs(n1[2]) < upright_at) & (F.abs(n2[2]) < upright_at))


def blended(score: Column, conf1: Column, conf2: Column, square: bool = False) -> Column:
    """A score trusted as far as both normals are: 1 where both are uncertain, towards 0 as their confidences differ."""
    mean, gap = (conf1 + conf2) / 2, F.abs(conf1 - conf2)
    return (1 - (gap * gap if square else gap)) * (mean * score + 1 - mean)


def multiscale(rows: DataFrame, score: str, score2: str, axis: str = "col") -> DataFrame:
    """Rows with ``multi``: the score of the edge to the next pixel of a line, held to the better of the two edges of
    length 2 that cover it (``score2``, of each pixel to the next but one). Edges that lack either keep their score."""
    other = "row" if axis == "col" else "col"
    w = Window.partitionBy("frame", other).orderBy(axis)
    before = F.when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag(score2).over(w))
    both = F.when(before.isNotNull() & F.col(score2).isNotNull(), F.greatest(before, F.col(score2)))
    return rows.withColumn("multi", F.least(F.col(score), F.coalesce(both, F.col(score))))
