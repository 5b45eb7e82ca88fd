"""A balanced k-d split of points, and exact nearest neighbours over its leaves.

The split is made from a sample: each node is cut at the median of its widest dimension, so dense places get small leaves
and far points do not widen those of others; each leaf then gets the box of its own points. A query is first answered in
the leaf that it falls into, which bounds its k-th distance; then it goes to those leaves only whose box lies within that
bound. Within a leaf a task splits the points again, into blocks, and compares blocks in order of the distance of their
boxes. Of equal points only as many are indexed as can be neighbours, those of least id. Queries of a crowded leaf are
dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanfold.stored import stored

#: Points of a leaf (about), leaves at most, and sampled points for each.
LEAF = 4096
LEAVES = 1 << 16
SAMPLED = 32
#: Points of a table that is searched without a split: all of it goes to the tasks that hold the queries.
SMALL = 8192
#: Queries of a leaf that one task answers, and points of a block within a task.
DEALT = 16_384
BLOCK = 256
#: Bounds are widened by this share against rounding.
SLACK = 1e-9


@dataclass(frozen=True)
class Tree:
    """Nodes in breadth-first order: the dimension cut (-1: a leaf), the cut, and the first child or the leaf's number;
    points below the cut go to the first child. ``low`` and ``high`` are the boxes of the points under each node."""

    dim: np.ndarray
    cut: np.ndarray
    to: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.dim < 0).sum())

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.dim[node] >= 0)
            if not len(inner):
                return self.to[node]
            at = node[inner]
            node[inner] = self.to[at] + (x[inner, self.dim[at]] >= self.cut[at])

    def boxed(self, low: np.ndarray, high: np.ndarray) -> Tree:
        """With the boxes of leaves; inner nodes get those around their children."""
        lo, hi = np.full((len(self.dim), low.shape[1]), np.inf), np.full((len(self.dim), low.shape[1]), -np.inf)
        for k in range(len(self.dim) - 1, -1, -1):
            if self.dim[k] < 0:
                lo[k], hi[k] = low[self.to[k]], high[self.to[k]]
            else:
                pair = slice(self.to[k], self.to[k] + 2)
                lo[k], hi[k] = lo[pair].min(axis=0), hi[pair].max(axis=0)
        return Tree(self.dim, self.cut, self.to, lo, hi)

    def within(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves whose box is within the squared distance ``bound`` of a query."""
        query, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            gap = np.maximum(np.maximum(self.low[node] - x[query], x[query] - self.high[node]), 0)
            near = (gap * gap).sum(axis=1) <= bound[query]
            query, node = query[near], node[near]
            leaf = self.dim[node] < 0
            found.append((query[leaf], self.to[node[leaf]]))
            query, first = np.repeat(query[~leaf], 2), self.to[node[~leaf]]
            node = np.stack((first, first + 1), axis=1).ravel()
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (query, node)


def split(sample: np.ndarray, leaves: int) -> Tree:
    """Cuts of ``sample`` at medians of the widest dimension, to ``leaves`` leaves at most."""
    dims, cuts, to = [], [], []
    depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
    level = [np.arange(len(sample))]
    done = 0
    for d in range(depth + 1):
        below: list[np.ndarray] = []
        first = len(dims) + len(level)  # of the next level's nodes
        for rows in level:
            own = sample[rows]
            width = np.ptp(own, axis=0) if len(own) > 1 else np.zeros(sample.shape[1])
            axis = int(width.argmax())
            if d == depth or not width[axis] > 0:
                dims.append(-1), cuts.append(0.0), to.append(done)
                done += 1
                continue
            x = own[:, axis]
            cut = np.partition(x, len(x) // 2)[len(x) // 2]
            cut = cut if cut > x.min() else x[x > cut].min()  # equal values stay together
            dims.append(axis), cuts.append(cut), to.append(first + len(below))
            below += [rows[x < cut], rows[x >= cut]]
        level = below
    none = np.zeros((len(dims), sample.shape[1]))
    return Tree(np.array(dims), np.array(cuts, float), np.array(to), none, none)


def _blocks(x: np.ndarray) -> list[np.ndarray]:
    """Rows of ``x`` in blocks of at most BLOCK, cut at medians of the widest dimension."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        own = x[rows]
        axis = int(np.ptp(own, axis=0).argmax())
        order = np.argpartition(own[:, axis], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def _first(d2: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least of each row of ``d2``, ties by lesser id, padded with infinity and -1; ``ids`` has its shape."""
    if d2.shape[1] > 4 * k:
        cut = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
        width = int((d2 <= cut).sum(axis=1).max())
        if width < d2.shape[1]:
            near = np.argpartition(d2, width - 1, axis=1)[:, :width]
            d2, ids = np.take_along_axis(d2, near, axis=1), np.take_along_axis(ids, near, axis=1)
    order = np.lexsort((ids, d2), axis=1)[:, :k]
    return np.take_along_axis(d2, order, axis=1), np.take_along_axis(ids, order, axis=1)


def nearest(x: np.ndarray, ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, weights: np.ndarray, k: int, same: bool, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the k nearest points of each query, no farther than ``bound``; -1 and infinity where
    there are fewer. Distances are sums of squared, weighted differences in the order of the columns."""
    best_id, best = np.full((len(x), k), -1, np.int64), np.full((len(x), k), np.inf)
    if not len(points) or not len(x):
        return best_id, best
    parts = [(r, (points[r] * weights).min(axis=0), (points[r] * weights).max(axis=0)) for r in _blocks(points * weights)]
    low, high = np.array([p[1] for p in parts]), np.array([p[2] for p in parts])
    for rows in _blocks(x * weights):
        q = x[rows] * weights
        gap = np.maximum(np.maximum(low - q.max(axis=0), q.min(axis=0) - high), 0)
        apart = (gap * gap).sum(axis=1)
        limit = np.full(len(rows), np.inf) if bound is None else bound[rows]
        d_best, i_best = best[rows], best_id[rows]
        for b in np.argsort(apart, kind="stable").tolist():
            if apart[b] > np.minimum(limit, d_best[:, -1]).max() * (1 + SLACK):
                break
            p = parts[b][0]
            d2 = np.zeros((len(rows), len(p)))
            for j, w in enumerate(weights.tolist()):
                d2 += ((x[rows, j : j + 1] - points[p, j]) * w) ** 2
            wide = np.broadcast_to(point_ids[p], d2.shape)
            if same:
                d2[wide == ids[rows, None]] = np.inf
            d2, near = _first(d2, wide, min(k, len(p)))
            d_best, i_best = _first(np.concatenate((d_best, d2), axis=1), np.concatenate((i_best, np.where(np.isinf(d2), -1, near)), axis=1), k)
        best[rows], best_id[rows] = d_best, i_best
    return best_id, best


def _coordinates(batch: pa.RecordBatch | pa.Table, cols: tuple[str, ...]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c), dtype=float) for c in cols], axis=1) if len(batch) else np.zeros((0, len(cols)))


@dataclass(frozen=True)
class Index:
    """Points by leaf, for up to ``most`` neighbours; a small table is held as arrays."""

    cols: tuple[str, ...]
    weights: np.ndarray
    most: int
    ids: np.ndarray | None
    points: np.ndarray | None
    tree: Tree | None
    table: DataFrame | None


def _finite(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    d = df.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in cols])
    return d.where(sum((F.abs(F.col(c)) for c in cols), F.lit(0.0)) < F.lit(float("inf")))


def _with_leaf(tree: Tree, cols: tuple[str, ...], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of(_coordinates(batch, cols) * weights)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return run


def index(points: DataFrame, cols: tuple[str, ...], weights: dict[str, float] | None = None, most: int = 1) -> Index:
    """An index of ``points`` (id and ``cols``) for up to ``most`` neighbours; each column's differences are weighted.

    Points with a null or non-finite coordinate, whichever it is, are left out.
    """
    w = np.array([float((weights or {}).get(c, 1.0)) for c in cols])
    named = _finite(points, cols)
    n = named.count()
    if n <= SMALL:
        t = named.toArrow()
        return Index(cols, w, most, np.asarray(t.column("id"), dtype=np.int64) if len(t) else np.zeros(0, np.int64), _coordinates(t, cols), None, None)
    nth = F.row_number().over(Window.partitionBy(*cols).orderBy("id"))
    # a point is not its own neighbour, hence one more
    distinct = stored(named.withColumn("nth", nth).where(F.col("nth") <= most + 1).drop("nth"))
    leaves = min(LEAVES, 1 << max(0, int(np.ceil(np.log2(n / LEAF)))))
    share = min(1.0, SAMPLED * leaves / n)
    sample = distinct.where(F.pmod(F.xxhash64("id", *cols), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(*cols).toArrow()
    tree = split(_coordinates(sample, cols) * w, leaves)
    table = stored(distinct.mapInArrow(_with_leaf(tree, cols, w), "id long, " + ", ".join(f"`{c}` double" for c in cols) + ", leaf long"))
    boxes = table.groupBy("leaf").agg(*[f(c).alias(f"{p}{i}") for p, f in (("l", F.min), ("h", F.max)) for i, c in enumerate(cols)]).collect()
    low, high = np.full((tree.leaves, len(cols)), np.inf), np.full((tree.leaves, len(cols)), -np.inf)
    for r in boxes:
        low[r["leaf"]], high[r["leaf"]] = ([r[f"{p}{i}"] * w[i] for i in range(len(cols))] for p in "lh")
    return Index(cols, w, most, None, None, tree.boxed(low, high), table)


_FOUND = "id long, near_id long, d2 double"


def _pairs(ids: np.ndarray, near: np.ndarray, d2: np.ndarray) -> dict[str, np.ndarray]:
    ok = near >= 0
    ok &= np.isfinite(d2)
    return {"id": np.broadcast_to(ids[:, None], near.shape)[ok], "near_id": near[ok], "d2": d2[ok]}


def search(index: Index, queries: DataFrame, k: int, same_table: bool) -> DataFrame:
    """(id, near_id, d2, nth) of the k nearest points of each query, ties by lesser id; with ``same_table`` a point of
    the query's id is not its neighbour. Queries with a null or non-finite coordinate are left out."""
    if k > index.most:
        raise ValueError(f"the index holds {index.most} neighbours of a point at most, not {k}")
    cols, w = index.cols, index.weights
    named = _finite(queries, cols)

    def in_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"), dtype=np.int64)
            near, d2 = nearest(_coordinates(batch, cols), ids, index.points, index.ids, w, k, same_table)
            ok = np.isfinite(d2)
            nth = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), near.shape)
            yield pa.RecordBatch.from_pydict(_pairs(ids, near, d2) | {"nth": nth[ok]})

    if index.tree is None:
        return named.mapInArrow(in_small, _FOUND + ", nth int")
    tree, coords = index.tree, ", ".join(f"`{c}` double" for c in cols)
    placed = stored(named.mapInArrow(_with_leaf(tree, cols, w), f"id long, {coords}, leaf long"))

    def in_leaf(key: tuple, q: pa.Table, p: pa.Table, further: bool) -> pa.Table:
        """The nearest of a leaf, for each query one row with its lists so far; with ``further`` pairs within its bound. A
        leaf may have points and no queries."""
        ids = np.asarray(q.column("id"), dtype=np.int64) if len(q) else np.zeros(0, np.int64)
        bound = (np.asarray(q.column("bound"), dtype=float) if len(q) else np.zeros(0)) if further else None
        near, d2 = nearest(_coordinates(q, cols), ids, _coordinates(p, cols), np.asarray(p.column("id"), dtype=np.int64) if len(p) else np.zeros(0, np.int64), w, k, same_table, bound)
        if further:
            return pa.table(_pairs(ids, near, d2), schema=pa.schema([("id", pa.int64()), ("near_id", pa.int64()), ("d2", pa.float64())]))
        out = {"id": pa.array(ids), **{c: pa.array(np.asarray(q.column(c), dtype=float) if len(q) else np.zeros(0)) for c in cols}, "leaf": pa.array(np.full(len(ids), key[0].as_py() if hasattr(key[0], "as_py") else key[0], np.int64))}
        out |= {"near": pa.array(list(near), pa.list_(pa.int64())), "d2s": pa.array(list(d2), pa.list_(pa.float64()))}
        return pa.table(out)

    def answered(asked: DataFrame, schema: str, further: bool) -> DataFrame:
        crowd = [(r.leaf, -(-r["count"] // DEALT)) for r in asked.groupBy("leaf").count().where(F.col("count") > DEALT).collect()]  # LEAVES at most
        parts = F.lit(1)
        points = index.table.withColumn("part", F.lit(0).cast("long"))
        if crowd:
            of = asked.sparkSession.createDataFrame(crowd, "leaf long, parts long")
            asked = asked.join(F.broadcast(of), "leaf", "left")
            parts = F.coalesce("parts", F.lit(1))
            points = index.table.join(F.broadcast(of), "leaf", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")

        def in_pass(key: tuple, q: pa.Table, p: pa.Table) -> pa.Table:
            return in_leaf(key, q, p, further)

        asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), parts)).drop("parts")
        return asked.groupBy("leaf", "part").cogroup(points.groupBy("leaf", "part")).applyInArrow(in_pass, schema)

    first = stored(answered(placed, f"id long, {coords}, leaf long, near array<long>, d2s array<double>", False))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _coordinates(batch, cols)
            d2s = np.stack(batch.column("d2s").to_numpy(zero_copy_only=False))
            bound = d2s[:, -1] * (1 + SLACK)
            query, leaf = tree.within(x * w, bound)
            other = leaf != np.asarray(batch.column("leaf"))[query]
            query, leaf = query[other], leaf[other]
            for lo in range(0, len(query), 65_536):
                q = query[lo : lo + 65_536]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(q)), *(pa.array(x[q, i]) for i in range(len(cols))), pa.array(leaf[lo : lo + 65_536]), pa.array(bound[q])], names=["id", *cols, "leaf", "bound"])

    more = stored(first.mapInArrow(further, f"id long, {coords}, leaf long, bound double"))
    zipped = first.select("id", F.explode(F.arrays_zip("near", "d2s")).alias("n")).select("id", F.col("n.near").alias("near_id"), F.col("n.d2s").alias("d2")).where("near_id >= 0")
    found = zipped.unionByName(answered(more, _FOUND, True))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("d2", "near_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)
