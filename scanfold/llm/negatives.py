"""Hard negatives by exact search of largest inner products over one-dimensional distance keys.

A coordinate sqrt(M - |x|^2) added to each vector, M the largest squared length, and 0 added to each query make larger
inner products nearer points: d^2 = |q|^2 + M - 2 q.x. Vectors are stored by (pivot, ring), the nearest of a few pivots and
a ring of the distance to it, in blocks that are sorted by that distance. Rings that hold few vectors are stored together.

A vector at distance t from a pivot that is d away from the query lies between |d - t| and d + t from the query. A round
scans the rings around each pivot that its radius newly reaches, and leaves out those that lie whole within the hole of
vectors known to score too high. The radius of an anchor grows with the share of vectors it reaches, until each of its
targets has its full list or band; then the last list's distance bounds what is left, and a round over that certifies it.
Anchors meet blocks in tiles: chunks of anchors, keyed by (cell, part, slot), against blocks of BLOCK vectors or so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import durable
from .grouping import by_group
from .hashing import release_memory

#: Pivots (a sample of so many vectors, fixed by hash), and rings of equal width around each.
PIVOTS = 64
RINGS = 64
#: Vectors of a block, anchors of a chunk, and chunks of a slot.
BLOCK = 1024
CHUNK = 128
SLOT = 64
#: Share of all vectors within reach in the first round, and times as much in each further one.
REACH = 1 / 32
FURTHER = 4
#: Bounds are widened by this part of the largest distance: distances are rounded.
SLACK = 1e-6
#: Scores up to this are exact sums of doubles; larger ones are summed as integers, up to LARGEST.
EXACT = float(1 << 53)
LARGEST = float(1 << 62)


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v) of the rows that take part: label and vector not null, all components finite, ids not null.

    Components become floor(256 * x). Where the id is divisible by 7 the label becomes (label + 1) % 10.
    """
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("v"))
    whole = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(whole)
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("id", label.alias("label"), F.transform("v", lambda c: F.floor(c * 256).cast("double")).alias("v"))


@dataclass(frozen=True)
class Index:
    """The space of an index: pivots with their added coordinate, M and the ring width; and its cells, each a pivot's
    distances from ``low`` to ``high`` with so many vectors."""

    pivots: np.ndarray
    squared: float
    width: float
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    counts: np.ndarray

    @property
    def scale(self) -> float:
        return SLACK * (1 + 2 * self.squared**0.5)

    def distances(self, v: np.ndarray, added: np.ndarray) -> np.ndarray:
        """Of each vector with its added coordinate to each pivot."""
        p = self.pivots
        d = ((v * v).sum(axis=1) + added * added)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (v @ p[:, :-1].T + added[:, None] * p[None, :, -1])
        return np.sqrt(np.maximum(d, 0))

    def parts(self) -> np.ndarray:
        return -(-self.counts // BLOCK)


def _packed(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column("v"):
                x = np.zeros(dim)
                own = v.values.to_numpy(zero_copy_only=False)
                x[: len(own)] = own
                rows.append(x.tobytes())
            m = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), dim)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "id", "label")), pa.array(rows, pa.binary()), pa.array((m * m).sum(axis=1))], names=["row", "id", "label", "v", "squared"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.float64).reshape(len(column), dim)


def _keyed(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = index.pivots.shape[1] - 1
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            d = index.distances(v, np.sqrt(np.maximum(index.squared - batch.column("squared").to_numpy(), 0)))
            pivot = d.argmin(axis=1)
            key = d[np.arange(len(d)), pivot]
            ring = pivot * RINGS + np.minimum(key / index.width, RINGS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "id", "label", "v")), pa.array(ring), pa.array(key)], names=["row", "id", "label", "v", "ring", "key"])

    return run


def _cells(space: Index, rings: list[tuple[int, int]]) -> tuple[Index, list[tuple[int, int]]]:
    """Adjacent rings of a pivot joined to cells of BLOCK vectors at most, and the cell of each (pivot, ring)."""
    first: list[int] = []
    last: list[int] = []
    counts: list[int] = []
    of = []
    for ring, n in sorted(rings):
        if first and first[-1] // RINGS == ring // RINGS and counts[-1] + n <= BLOCK:
            last[-1], counts[-1] = ring, counts[-1] + n
        else:
            first.append(ring), last.append(ring), counts.append(n)
        of.append((ring, len(first) - 1))
    a, b = np.array(first, np.int64), np.array(last, np.int64)
    high = np.where(b % RINGS == RINGS - 1, 4 * space.squared**0.5 + 1, (b % RINGS + 1) * space.width)
    return Index(space.pivots, space.squared, space.width, a // RINGS, a % RINGS * space.width, high, np.array(counts, np.int64)), of


_BLOCKS = "cell long, part long, b_rows array<long>, b_ids array<long>, b_labels array<long>, b_v binary"


def _block(table: pa.Table) -> Iterator[pa.RecordBatch]:
    cols = [table.column(k).combine_chunks() for k in ("row", "id", "label")]
    whole = b"".join(x.as_buffer() for x in table.column("v").combine_chunks())
    yield pa.RecordBatch.from_arrays([pa.array([table.column(k)[0].as_py()], pa.int64()) for k in ("cell", "part")] + [pa.array([c.to_numpy()], pa.list_(pa.int64())) for c in cols] + [pa.array([whole], pa.binary())], names=["cell", "part", "b_rows", "b_ids", "b_labels", "b_v"])


_PLAN = "row long, done double, cell long, part long, chunk long, a_rows array<long>, a_labels array<long>, a_v binary, a_of array<long>, a_no array<long>, a_low array<long>, a_high array<long>"


def _plan(index: Index, reach: float):
    """For each anchor the radius that this round reaches, and chunks of anchors for each part of the cells it scans."""
    dim = index.pivots.shape[1] - 1
    low, high, parts = index.low, index.high, index.parts()
    total = index.counts.sum()
    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.int64())] * 4]
    names = [x.split()[0] for x in _PLAN.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), CHUNK):
                batch = whole.slice(lo, CHUNK)
                v = _matrix(batch.column("v"), dim)
                done, cap, hole = (batch.column(k).to_numpy() for k in ("done", "cap", "hole"))
                d = index.distances(v, np.zeros(len(v)))[:, index.pivot]
                near = np.maximum(np.maximum(low[None, :] - d, d - high[None, :]), 0)
                order = np.argsort(near, axis=1)
                within = np.cumsum(index.counts[order], axis=1) >= min(1.0, reach) * total
                some = np.take_along_axis(near, np.take_along_axis(order, within.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
                # a bounded anchor is finished in this round
                to = np.where(np.isfinite(cap), cap, np.maximum(some, done))
                hit = (near > done[:, None]) & (near <= to[:, None]) & (d + high[None, :] >= hole[:, None] - index.scale)
                rows, labels = batch.column("row").to_numpy(), batch.column("label").to_numpy()
                targets = batch.column("targets").to_pylist()
                yield packed([(int(r), float(t), *([None] * 10)) for r, t in zip(rows, to, strict=True)])
                for c in np.flatnonzero(hit.any(axis=0)).tolist():
                    own = np.flatnonzero(hit[:, c]).tolist()
                    flat = [(k, t["no"], t["low"], t["high"]) for k, i in enumerate(own) for t in targets[i]]
                    chunk = (int(rows[0]), rows[own].tolist(), labels[own].tolist(), v[own].tobytes(), *([list(x) for x in zip(*flat, strict=True)] or [[], [], [], []]))
                    for p in range(int(parts[c])):
                        yield packed([(None, None, c, p, *chunk)])
        release_memory()

    return run


def _tile(dim: int, k: int, same: bool, exact: bool):
    """(row, no, score, id, found) of the first ``k`` of a block for each target of a chunk of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                q, b = (np.frombuffer(t[x], np.float64).reshape(-1, dim) for x in ("a_v", "b_v"))
                scores = (q @ b.T if exact else q.astype(np.int64) @ b.astype(np.int64).T).astype(np.int64)
                rows, ids, labels = (np.array(t[x]) for x in ("b_rows", "b_ids", "b_labels"))
                for of, no, low, high in zip(t["a_of"], t["a_no"], t["a_low"], t["a_high"], strict=True):
                    s = scores[of]
                    ok = np.flatnonzero((s >= low) & (s <= high) & ((labels == t["a_labels"][of]) == same) & (rows != t["a_rows"][of]))
                    if len(ok) > k:
                        ok = ok[s[ok] >= np.partition(s[ok], len(ok) - k)[len(ok) - k]]
                    ok = ok[np.lexsort((rows[ok], ids[ok], -s[ok]))[:k]]
                    out += [(t["a_rows"][of], no, int(x), int(y), int(z)) for x, y, z in zip(s[ok], ids[ok], rows[ok], strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "no", "score", "id", "found"])
        release_memory()

    return run


def build(rows: DataFrame, seed: int = 7) -> tuple[Index, DataFrame, DataFrame] | None:
    """(index, vectors, blocks) of rows (id, label, v); None without rows. Shorter vectors are padded with zeros."""
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return None
    packed = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v").mapInArrow(_packed(dim), "row long, id long, label long, v binary, squared double")
    vectors = durable.write(packed, "vectors")
    squared = float(vectors.agg(F.max("squared")).first()[0])
    if not squared < LARGEST:
        raise ValueError("scores of these vectors don't fit in a long")
    chosen = vectors.orderBy(F.xxhash64("row", F.lit(seed)), "row").limit(PIVOTS).select("v", "squared").collect()
    pivots = np.array([[*np.frombuffer(bytes(r.v), np.float64), max(squared - r.squared, 0.0) ** 0.5] for r in chosen])
    width = 2 * squared**0.5 / RINGS or 1.0
    none = np.zeros(0)
    space = Index(pivots, squared, width, none, none, none, none)
    keyed = durable.write(vectors.mapInArrow(_keyed(space), "row long, id long, label long, v binary, ring long, key double"), "keyed")
    index, cells = _cells(space, [tuple(r) for r in keyed.groupBy("ring").count().collect()])  # PIVOTS * RINGS at most
    parts = index.parts()
    of = keyed.sparkSession.createDataFrame([(ring, c, int(parts[c])) for ring, c in cells], "ring long, cell long, parts long")
    parted = keyed.join(F.broadcast(of), "ring").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    return index, vectors, durable.write(by_group(parted.drop("parts", "ring"), ["cell", "part"], ["key"], _block, _BLOCKS), "blocks")


def search(index: Index, blocks: DataFrame, anchors: DataFrame, n_anchors: int, k: int, same: bool) -> DataFrame:
    """(row, no, score, id, found) of the first ``k`` vectors, by falling score and then id, for each target of anchors
    (row, label, v, squared, targets array<struct<no, low, high>>): those of the same, or another, label than the anchor
    with scores between low and high."""
    dim = index.pivots.shape[1] - 1
    slots = -(-n_anchors // (CHUNK * SLOT))
    exact = index.squared < EXACT

    def distance(score):
        return F.sqrt(F.greatest(F.col("squared") + F.lit(index.squared) - 2 * score.cast("double"), F.lit(0.0))) * (1 + SLACK) + F.lit(index.scale)

    targets = anchors.select("row", "squared", F.explode("targets").alias("t")).select("row", "squared", "t.*")
    # lists end at the least score of a target's band at the latest
    band = F.when(F.col("low") > -(1 << 61), distance(F.col("low"))).otherwise(F.lit(float("inf")))
    holes = targets.groupBy("row").agg(F.min(distance(F.col("high"))).alias("hole"))
    hole = F.when(F.col("hole") > 2 * index.scale, F.col("hole") - 2 * index.scale).otherwise(0.0) / (1 + SLACK) ** 2
    base = durable.write(anchors.join(holes, "row").withColumn("hole", hole), "anchors")
    found, done, reach = None, None, REACH
    while True:
        if found is None:
            state = base.withColumns({"done": F.lit(-1.0), "cap": F.lit(float("inf"))})
        else:
            full = found.groupBy("row", "no").agg(F.count("*").alias("n"), F.min("score").alias("last"))
            last = F.when(F.col("n") >= k, F.least(band, distance(F.col("last")))).otherwise(band)
            caps = targets.join(full, ["row", "no"], "left").groupBy("row").agg(F.max(last).alias("cap"))
            state = base.join(caps, "row").join(done, "row")
            # only anchors whose cap is beyond what was scanned go on
            state = state.where("done < cap")
        plan = durable.write(state.select("row", "label", "v", "done", "cap", "hole", "targets").mapInArrow(_plan(index, reach), _PLAN), "plan")
        tiles = plan.where("cell is not null").drop("row", "done").withColumn("slot", F.pmod(F.xxhash64("chunk"), F.lit(slots)))
        if tiles.isEmpty() and (reach >= 1 or plan.isEmpty()):
            return found
        radii = plan.where("cell is null").select("row", "done")
        done = durable.write(radii if done is None else radii.unionAll(done.join(radii, "row", "left_anti")), "done")
        wanted = blocks.join(tiles.select("cell", "part", "slot").distinct(), ["cell", "part"])
        new = tiles.join(wanted, ["cell", "part", "slot"]).mapInArrow(_tile(dim, k, same, exact), "row long, no long, score long, id long, found long")
        new = new if found is None else new.unionAll(found)
        nth = F.row_number().over(Window.partitionBy("row", "no").orderBy(F.desc("score"), "id", "found"))
        found = durable.write(new.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth"), "found")
        reach *= FURTHER


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@durable.leaves_only("negatives")
def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (id, label, v), v of integers.

    Anchors are rows whose id is divisible by ``every``; their positives the ``positives`` other rows of the same label
    with the largest inner products, ties by lesser id; the negatives of a pair the first ``negatives`` rows of other
    labels with least * positive_score <= 100 * negative_score <= most * positive_score. Rows that repeat an id are
    vectors of their own. Vectors shorter than the longest are padded with zeros. An error if scores exceed a long.
    """
    spark = rows.sparkSession
    durable.bounded_batches(spark)
    built = build(rows)
    anchors = built and built[1].where(F.col("id") % every == 0)
    n = anchors.count() if built else 0
    if not n:
        return spark.createDataFrame([], _RESULT)
    index, _, blocks = built
    wide = F.lit(1 << 62).cast("long")
    any_score = F.array(F.struct(F.lit(0).cast("long").alias("no"), (-wide).alias("low"), wide.alias("high")))
    near = search(index, blocks, anchors.withColumn("targets", any_score), n, positives, True)
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id", "found")).cast("long")
    pairs = durable.write(near.select("row", nth.alias("no"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "pairs")
    score = F.col("positive_score").cast("decimal(20,0)")
    bands = pairs.withColumns({"low": F.ceil(score * least / 100).cast("long"), "high": F.floor(score * most / 100).cast("long")})
    targets = bands.where("low <= high").groupBy("row").agg(F.collect_list(F.struct("no", "low", "high")).alias("targets"))
    banded = anchors.join(targets, "row")
    if banded.isEmpty():
        return spark.createDataFrame([], _RESULT)
    far = search(index, blocks, banded, n, negatives, False)
    rank = F.row_number().over(Window.partitionBy("row", "no").orderBy(F.desc("score"), "id", "found"))
    ranked = far.select("row", "no", rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pairs.join(anchors.select("row", F.col("id").alias("anchor_id")), "row").join(ranked, ["row", "no"])
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.id AS anchor_id, a.label, b.id, b.label AS other, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE label = other QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
neg AS (SELECT pos.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM pos JOIN p USING (anchor_id) WHERE label <> other AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""
