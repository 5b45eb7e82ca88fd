"""Near-duplicate vectors by NN-descent, run as Spark jobs over tables of neighbours.

1. Vectors are normalised in double precision; equal unit vectors become one class.
2. A start graph comes from a few random hyperplane trees, whatever the table's size: the vectors of a leaf are compared
   by matrix products and each keeps its nearest. Leaves too large for one product are cut by further hyperplanes, and
   what those do not cut into parts by a hash that differs from tree to tree. Each product also gives its bridges: links
   that join all that its links connect, so vectors whose nearest are all of their own group keep their way to others.
3. Rounds of NN-descent join neighbours (and reverse neighbours) of neighbours until few lists change; a list keeps its
   k nearest. A list that is saturated, its last neighbour above the threshold, is enlarged; bridges are never cut.
4. Edges above the threshold are kept. Groups that they connect are closed: all members of a component are compared by
   blocks, which counts links within a group of any size without a list as long as the group.
5. A sample of vectors, fixed by hash and enlarged until it has AUDIT_LINKS links, is compared with all others in blocks.
   While less than RECALL of its links lie within components, more trees are grown and descent goes on from all edges
   known. If the last forest still fails, all vectors of a table of at most WHOLE_MOST are compared by blocks, and a
   larger one is an error. The figures are logged.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import durable
from .components import connected_components
from .grouping import by_group

#: Vectors of a leaf, and of the largest one that is compared by one product.
LEAF = 256
LEAF_MOST = 1024
#: Nearest that a leaf gives to each vector, and length of a list at first.
LEAF_NEAREST = 4
NEAREST = 8
#: Trees of the start graph; each further forest has twice as many as the one before.
TREES = 4
FORESTS = 4
#: Rounds of descent at most, and times that saturated lists are doubled: the closure finds the links of longer ones.
ROUNDS = 12
DOUBLED = 4
#: Share of lists that must have changed for another round.
CHANGED = 0.01
#: Reverse neighbours joined at a time, and edges that a join of vectors gives for its saturated lists.
REVERSE = 256
GIVEN = 8192
#: Least share of the audit's links within components; links that the audit has, vectors it takes at first and at most.
RECALL = 0.999
AUDIT_LINKS = 1000
AUDIT = 1024
AUDIT_MOST = 16_384
#: Vectors of a block where a component, or the whole table, is compared, and of a table that is compared whole.
BLOCK = 2048
WHOLE_MOST = 1_000_000
#: Single-precision products are this close to double ones.
MARGIN = 1e-4
_CODE_BITS = 40
LOG = logging.getLogger(__name__)
_EDGE = "a long, b long, sim double, bridge boolean"


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, unit = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.array([], float)
            if i is not None and v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    top = np.abs(x).max(initial=0)
                    x = x / top if np.isfinite(top) and top > 0 else x[:0]
                    x = x / np.sqrt((x * x).sum()) if len(x) else x
            ids.append(i)
            unit.append((x + 0.0).tobytes() if len(x) else None)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(unit, pa.binary())], names=["id", "unit"])


def _matrix(column, dtype=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.float64).reshape(n, -1).astype(dtype, copy=False)


def _codes(trees: int, dim: int, seed: int):
    planes = np.random.default_rng(seed).standard_normal((dim, trees * _CODE_BITS)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(_CODE_BITS, dtype=np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                bits = (_matrix(part.column(1), np.float32) @ planes > 0).reshape(len(part), trees, _CODE_BITS)
                code = (bits * weights).sum(axis=2)
                at = np.arange(0, len(part) * trees + 1, trees, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(code.ravel()))], names=["rep", "unit", "codes"])

    return run


def _spanning(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of edges of a symmetric matrix that join all that its edges connect, one less than a component's nodes."""
    left = ok.any(axis=1)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root in np.flatnonzero(left).tolist():
        reached = [root] if left[root] else []
        left[root] = False
        while reached and left.any():
            i = reached.pop()
            new = np.flatnonzero(ok[i] & left)
            left[new] = False
            a.append(np.full(len(new), i)), b.append(new)
            reached += new.tolist()
    return np.concatenate(a), np.concatenate(b)


def _nearest(k: int, threshold: float, longest: int = 0):
    """The k nearest others of each vector of a group, more of them, up to ``longest`` and GIVEN of the whole group,
    while they are links, and the group's bridges."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = len(table)
        if n < 2:
            return
        ids, v = table.column("rep").to_numpy(), _matrix(table.column("unit"), np.float32)
        s = v @ v.T
        s[ids[:, None] == ids[None, :]] = -2
        m = min(n - 1, max(k, min(longest, GIVEN // n)))
        top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < n - 1 else np.argsort(-s, axis=1)[:, :m]
        near = np.take_along_axis(s, top, axis=1)
        if m > k:
            order = np.argsort(-near, axis=1, kind="stable")
            top, near = np.take_along_axis(top, order, axis=1), np.take_along_axis(near, order, axis=1)
        a, b, sim = np.repeat(ids, m), ids[top].ravel(), near.ravel()
        ok = (sim > -2) & ((np.tile(np.arange(m), n) < k) | (sim >= threshold - MARGIN))
        x, y = _spanning(s >= threshold - MARGIN)
        a, b, sim = np.concatenate((a[ok], ids[x])), np.concatenate((b[ok], ids[y])), np.concatenate((sim[ok], s[x, y]))
        bridge = np.arange(len(a)) >= len(a) - len(x)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim.astype(np.float64)), pa.array(bridge)], names=["a", "b", "sim", "bridge"])

    return run


def _longest(stage: int) -> int:
    return NEAREST << min(stage, DOUBLED)


def _lists(edges: DataFrame, threshold: float, stage: int) -> DataFrame:
    """The nearest of each vector: NEAREST of them, or 2 ** stage times as many (DOUBLED at most) while they are links.

    Bridges stay, ``near`` or not; ``full`` marks the last place of a list that is saturated.
    """
    e = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("bridge").alias("bridge"))
    e = e.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")))
    link = F.col("sim") >= threshold - MARGIN
    longest = _longest(stage)
    near = (F.col("nth") <= NEAREST) | ((F.col("nth") <= longest) & link)
    full = (F.col("nth") == longest) & link
    return e.withColumns({"near": near, "full": full}).where("near or bridge").select("a", "b", "sim", "bridge", "near", "full")


def _forest(vectors: DataFrame, n: int, dim: int, threshold: float, seed: int, trees: int) -> DataFrame:
    """Edges (a, b, sim, bridge) within the leaves of random hyperplane trees."""
    bits = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    rows = durable.write(vectors.select("rep", "unit").mapInArrow(_codes(trees, dim, seed), "rep long, unit binary, codes array<long>"), "codes")
    mask = (1 << bits) - 1

    def cut(df: DataFrame, *more: str) -> DataFrame:
        return df.select("rep", *more, F.posexplode("codes").alias("tree", "code")).withColumn("leaf", F.col("code").bitwiseAND(F.lit(mask)))

    # leaves too large for one product take further bits, then parts
    full = cut(rows).groupBy("tree", "leaf").count().where(F.col("count") > LEAF_MOST)
    full = full.select("tree", "leaf", F.least(F.ceil(F.log2(F.col("count") / LEAF)), F.lit(_CODE_BITS - bits)).cast("int").alias("further"))

    def deeper(df: DataFrame) -> DataFrame:
        d = df.join(full, ["tree", "leaf"], "left")
        more_mask = F.expr("(shiftleft(1L, coalesce(further, 0)) - 1L)")
        return d.withColumn("sub", F.shiftright("code", bits).bitwiseAND(more_mask)).drop("code", "further")

    large = deeper(cut(rows)).groupBy("tree", "leaf", "sub").count().where(F.col("count") > LEAF_MOST).withColumn("parts", F.ceil(F.col("count") / LEAF_MOST)).drop("count")
    placed = deeper(cut(rows, "unit")).join(large, ["tree", "leaf", "sub"], "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rep", "tree"), F.coalesce("parts", F.lit(1)))).drop("parts")
    return by_group(placed.withColumn("tree", F.col("tree").cast("long")), ["tree", "leaf", "sub", "part"], [], _nearest(LEAF_NEAREST, threshold), _EDGE)


def _descend(lists: DataFrame, vectors: DataFrame, threshold: float, stage: int) -> DataFrame:
    """Edges between neighbours, and reverse neighbours, of the same vector, itself included."""
    lists = lists.where("near")
    ends = lists.select(F.col("b").alias("via"), F.col("a").alias("rep")).unionAll(lists.select(F.col("a").alias("via"), F.col("b").alias("rep")))
    ends = ends.distinct()
    degree = ends.groupBy("via").agg(F.ceil(F.count("*") / REVERSE).alias("parts"))
    ends = ends.join(degree, "via").withColumn("part", F.pmod(F.xxhash64("rep", "via"), F.col("parts"))).select("via", "part", "rep")
    own = ends.select("via", "part", F.col("via").alias("rep")).distinct()
    return by_group(ends.unionAll(own).join(vectors.select("rep", "unit"), "rep"), ["via", "part"], [], _nearest(NEAREST // 2, threshold, _longest(stage)), _EDGE)


def _in_blocks(members: DataFrame, block: int) -> DataFrame:
    size = members.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    m = members.join(size, "hub").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    left = m.withColumn("j", F.explode(F.sequence("own", F.col("parts") - 1))).select("hub", F.col("own").alias("i"), "j", F.lit(0).alias("side"), "rep", "unit", "copies")
    right = m.where("own > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own") - 1))).select("hub", "i", F.col("own").alias("j"), F.lit(1).alias("side"), "rep", "unit", "copies")
    return left.unionAll(right)


def _closed(threshold: float):
    """For each vector of a pair of blocks the copies that it links with, and links that join the pair's components."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sides = [table.filter(pa.array(table.column("side").to_numpy() == k)) for k in (0, 1)]
        same = table.column("i")[0] == table.column("j")[0]
        left, right = (sides[0], sides[0]) if same else sides
        if not len(left) or not len(right):
            return
        a, b = left.column("rep").to_numpy(), right.column("rep").to_numpy()
        u, v = _matrix(left.column("unit")), _matrix(right.column("unit"))
        ok = np.empty((len(a), len(b)), bool)
        links = [np.zeros(len(a)), np.zeros(len(b))]
        weights = [x.column("copies").to_numpy().astype(np.float64) for x in (left, right)]
        for lo in range(0, len(a), 512):
            near = u[lo : lo + 512] @ v.T >= threshold
            if same:
                near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
            ok[lo : lo + 512] = near
            near = near.astype(np.float64)
            links[0][lo : lo + 512] = near @ weights[1]
            links[1] += weights[0][lo : lo + 512] @ near
        rows = {"rep": [a], "links": [links[0]], "to": [np.full(len(a), -1)]}
        if not same:
            rows["rep"].append(b), rows["links"].append(links[1]), rows["to"].append(np.full(len(b), -1))
        x = np.arange(len(a))
        y = x.copy() if same else np.arange(len(a), len(a) + len(b))
        joined = []
        for r in range(len(a)):
            cols = np.flatnonzero(ok[r] & (y != x[r]))
            while len(cols):
                c, into, gone = cols[0], x[r], y[cols[0]]
                joined.append((a[r], b[c]))
                x[x == gone] = into
                y[y == gone] = into
                if same:
                    y = x
                cols = cols[y[cols] != x[r]]
        if joined:
            j = np.array(joined)
            rows["rep"].append(j[:, 0]), rows["links"].append(np.zeros(len(j), np.int64)), rows["to"].append(j[:, 1])
        rep, links, to = (np.concatenate(rows[k]) for k in ("rep", "links", "to"))
        own = np.concatenate([np.full(sum(len(z) for z in rows["to"]) - len(joined), False), np.full(len(joined), True)])
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links.astype(np.int64)), pa.array(to, mask=~own)], names=["rep", "links", "to"])

    return run


@dataclass(frozen=True)
class Audit:
    """Links of a sample of vectors: all of them, those in the vectors' lists, and those within components."""

    vectors: int
    links: int
    listed: int
    found: int

    @property
    def recall(self) -> float:
        return self.found / self.links if self.links else 1.0


def _compared(sample: list[tuple[int, bytes, int]], threshold: float):
    """Links of the sample's vectors with all, how many of them lie within a component, and those that do as edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([s[0] for s in sample])
        v = np.frombuffer(b"".join(s[1] for s in sample), np.float64).reshape(len(sample), -1)
        comp = np.array([s[2] for s in sample])
        true = found = 0
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                ok = (_matrix(part.column(1)) @ v.T >= threshold) & (part.column(0).to_numpy()[:, None] != ids[None, :])
                true += int(ok.sum())
                found += int((ok & (part.column(2).to_numpy()[:, None] == comp[None, :])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([true], pa.int64()), pa.array([found], pa.int64())], names=["true", "found"])

    return run


def audit(lists: DataFrame, labelled: DataFrame, n: int, threshold: float, seed: int) -> Audit:
    """Recall of the links of some of the ``n`` vectors of ``labelled`` (rep, unit, component) against brute force.

    The sample, AUDIT_MOST vectors at most, is doubled until it has AUDIT_LINKS links or is the whole table.
    """
    take = AUDIT
    labelled = labelled.select("rep", "unit", "component")
    while True:
        sample = [(r.rep, bytes(r.unit), r.component) for r in labelled.orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(take).collect()]
        true, found = labelled.mapInArrow(_compared(sample, threshold), "true long, found long").agg(F.sum("true"), F.sum("found")).first()
        if true >= AUDIT_LINKS or take >= min(n, AUDIT_MOST):
            break
        take = min(take * 4, AUDIT_MOST)
    ids = lists.sparkSession.createDataFrame([(s[0],) for s in sample], "a long")
    listed = lists.where(F.col("sim") >= threshold).join(F.broadcast(ids), "a").count()
    return Audit(len(sample), true, listed, found)


def neighbour_lists(classes: DataFrame, n: int, dim: int, threshold: float, seed: int, trees: int, known: DataFrame | None) -> DataFrame:
    """Neighbour lists (a, b, sim, bridge, near, full) of ``n`` unit vectors: a start graph of ``trees`` trees and the
    ``known`` lists, refined by descent until few lists change and none can be enlarged."""
    edges = _forest(classes, n, dim, threshold, seed, trees)
    edges = edges if known is None else edges.unionAll(known.select(*edges.columns))
    lists = durable.write(_lists(edges, threshold, 0), "lists")
    for stage in range(1, ROUNDS + 1):
        wider = _descend(lists, classes, threshold, stage)
        wider = durable.write(_lists(wider.unionAll(lists.select(*wider.columns)), threshold, stage), "lists")
        changed = wider.where("near").join(lists.where("near"), ["a", "b"], "left_anti").select("a").distinct().count()
        durable.delete(lists)
        lists = wider
        if changed <= CHANGED * n and (stage >= DOUBLED or wider.where("full").isEmpty()):
            break
    return lists


def _one_group(classes: DataFrame, n: int, checked: Audit) -> DataFrame:
    if n > WHOLE_MOST:
        raise RuntimeError(f"descent does not reach a recall of {RECALL}: {checked}")
    return classes.withColumn("hub", F.lit(0).cast("long"))


def _linked(classes: DataFrame, n: int, dim: int, threshold: float, seed: int) -> DataFrame:
    """(rep, links, component) of the ``n`` classes of one length."""
    lists = None
    for grown in range(FORESTS):
        lists = neighbour_lists(classes, n, dim, threshold, seed + grown, TREES << grown, lists)
        comp = durable.write(connected_components(lists.where(F.col("sim") >= threshold - MARGIN)), "labels")
        labelled = durable.write(classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "unit", F.coalesce("component", "rep").alias("component")), "labelled")
        checked = audit(lists, labelled, n, threshold, seed)
        LOG.info("op2 audit after forest %d: %s, recall %.5f", grown + 1, checked, checked.recall)
        if checked.recall >= RECALL:
            members = comp.select(F.col("component").alias("hub"), F.col("node").alias("rep")).join(classes, "rep")
            break
    else:
        members = _one_group(classes, n, checked)
    closed = durable.write(by_group(_in_blocks(members, BLOCK), ["hub", "i", "j"], ["side"], _closed(threshold), "rep long, links long, to long"), "closed")
    counts = closed.where("to is null").groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(closed.where("to is not null"), "rep", "to")
    return counts.join(roots.withColumnRenamed("node", "rep"), "rep", "left")


@durable.leaves_only("linked-vectors")
def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, seed: int = 5) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row, for links at a cosine of at least ``threshold``.

    Cosines are products of unit vectors in double precision. A vector that is null, zero or holds null or non-finite
    components links with nothing, and vectors link with those of their own length only: each length is searched by itself,
    one after the other. Equal vectors link. Rows with a null
    id link with nothing and have a null component_id and kept = true; rows that repeat an id all get the result of
    one of them, that of the least unit vector. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    # any valid vector of a repeated id stands for it
    units = rows.mapInArrow(_unit_rows, "id long, unit binary")
    one = durable.write(units.where("id is not null").groupBy("id").agg(F.min("unit").alias("unit")), "units")
    classes = durable.write(one.where("unit is not null").groupBy("unit").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    lengths = classes.groupBy(F.octet_length("unit").alias("size")).count().where("count > 1").collect()
    linked = None
    for size, n in lengths:
        own = _linked(classes.where(F.octet_length("unit") == size), n, size // 8, threshold, seed)
        linked = own if linked is None else linked.unionByName(own)
    whole = classes.select("unit", "rep", "copies")
    if linked is not None:
        whole = whole.join(linked, "rep", "left")
    else:
        whole = whole.withColumns({"links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    out = one.join(whole, "unit", "left")
    result = out.select(F.col("id"), F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("component", "rep", "id").alias("component_id"))
    named = rows.select("id").join(result, "id", "left")
    return named.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
