"""Near-duplicate documents by b-bit MinHash.

Sets are sets of 64-bit hashes of shingles; two shingles of one pair of documents would have to collide to change a link.

1. Each document gets the minima of 128 hash functions over its distinct word shingles. Bands of four minima give
   bucket keys; the low two bits of all minima are packed into four longs.
2. Documents with equal shingle sets become one class, so that exact copies cost one row from then on.
3. Each bucket is named by its least class, its hub, and all classes of a hub's buckets form a cluster, so two classes
   that share a bucket share a cluster. Each class is compared with its hub only, by collision-corrected similarity
   from bit counts of the packed signatures, then on full shingle sets: that is linear and settles most clusters.
4. In clusters that still hold several components, the classes outside the cluster's largest component are compared
   with all others, block by block, again by signatures first; full sets are read only for classes whose signatures
   are near some class of another component. A block returns no more links than join its classes into components. So
   no link between classes that share a bucket is lost, and no group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import durable
from .components import connected_components
from .grouping import by_group, join_by_size
from .hashing import distinct_sets, hash_words, mix64, release_memory, shingle_hashes, slices, text_buffers

PERMUTATIONS = 128
BAND_ROWS = 4
BITS = 2
LANES_PER_LONG = 64 // BITS
SIGNATURE_LONGS = PERMUTATIONS // LANES_PER_LONG
#: Standard errors below the threshold at which an estimate still goes to the exact check.
SLACK = 5.0
#: Classes of a cluster's block.
BLOCK = 512
#: Ids that are broadcast to pick their texts; with more the texts are shuffled.
BROADCAST_IDS = 2_000_000
#: Shingles compared in one matrix product.
COLUMNS = 4096

_RNG = np.random.default_rng(77_001)
_A = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_C = _RNG.integers(0, 1 << 63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Hashes permuted at a time, so that the scratch arrays stay in cache.
_STEP = 1 << 15


def minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima of the hash functions over each non-empty document's hashes, as an n x PERMUTATIONS array."""
    out = np.full((len(bounds) - 1, PERMUTATIONS), np.iinfo(np.uint64).max, np.uint64)
    for lo, hi in slices(bounds, _STEP):
        x = hashes[bounds[lo] : bounds[hi]]
        rows = np.arange(lo, hi)[np.diff(bounds[lo : hi + 1]) > 0]
        if not len(rows):
            continue
        starts = bounds[rows] - bounds[lo]
        scratch = np.empty_like(x)
        for k in range(PERMUTATIONS):
            np.multiply(x, _A[k], out=scratch)
            np.add(scratch, _B[k], out=scratch)
            out[rows, k] = np.minimum.reduceat(scratch, starts)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of minima; equal bands of different numbers have different keys."""
    bands = m.reshape(len(m), -1, BAND_ROWS)
    return mix64((bands * _C).sum(axis=2, dtype=np.uint64) + mix64(np.arange(bands.shape[1], dtype=np.uint64) + np.uint64(1)))


def pack(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each (mixed) minimum, LANES_PER_LONG to a long."""
    low = (mix64(m) & np.uint64((1 << BITS) - 1)).reshape(len(m), SIGNATURE_LONGS, LANES_PER_LONG)
    return (low << (np.arange(LANES_PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def similarity_from_matches(share: float) -> float:
    """Similarity at which a ``share`` of packed lanes agrees, corrected for chance agreement."""
    c = 2.0**-BITS
    return (share - c) / (1 - c)


def least_matches(threshold: float) -> int:
    """Agreeing lanes below which a pair is SLACK standard errors under the threshold."""
    c = 2.0**-BITS
    p = threshold + (1 - threshold) * c
    return max(0, int(np.floor(PERMUTATIONS * p - SLACK * np.sqrt(PERMUTATIONS * p * (1 - p)))))


_SKETCH = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("h1", T.LongType()),
        T.StructField("h2", T.LongType()),
        *[T.StructField(f"s{i}", T.LongType()) for i in range(SIGNATURE_LONGS)],
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                sh, bounds = shingle_hashes(hash_words(data, offsets[lo : hi + 1]), width)
                sets = distinct_sets(sh, bounds)
                n = np.array([len(s) for s in sets], np.int64)
                m = minima(sh, bounds)
                some = n > 0
                h = np.zeros((hi - lo, 2), np.uint64)
                for i in np.flatnonzero(some):
                    h[i] = sets[i].sum(dtype=np.uint64), mix64(sets[i] + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
                packed = pack(m).view(np.int64)
                keys = band_keys(m[some]).view(np.int64)
                per = PERMUTATIONS // BAND_ROWS
                at = np.concatenate(([0], np.cumsum(np.where(some, per, 0)))).astype(np.int32)
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64))]
                cols += [pa.array(packed[:, i]) for i in range(SIGNATURE_LONGS)]
                cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel())))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in _SKETCH])
        release_memory()

    return run


_SIG = [f"s{i}" for i in range(SIGNATURE_LONGS)]
_MASK = np.uint64(0x5555555555555555)


def _side(table: pa.Table, side: int) -> pa.Table:
    return table.filter(pa.compute.equal(table.column("side"), side))


def _signatures(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().view(np.uint64) for c in _SIG], axis=1)


def _near(left: pa.Table, right: pa.Table, floor: int, threshold: float) -> np.ndarray:
    """Which pairs of both sides sizes and bit counts leave possible."""
    u, v = _signatures(left), _signatures(right)
    miss = np.zeros((len(u), len(v)), np.int16)
    for i in range(SIGNATURE_LONGS):
        d = u[:, i : i + 1] ^ v[None, :, i]
        miss += np.bitwise_count((d | (d >> np.uint64(1))) & _MASK)
    n, m = left.column("n").to_numpy()[:, None], right.column("n").to_numpy()[None, :]
    ok = (PERMUTATIONS - miss >= floor) & (np.minimum(n, m) >= np.maximum(n, m) * (threshold - 1e-9))
    return ok & (left.column("rep").to_numpy()[:, None] != right.column("rep").to_numpy()[None, :])


def _marked(threshold: float):
    """Classes of a pair of blocks that are near some class of another component in it."""
    floor = least_matches(threshold)

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right = _side(table, 0), _side(table, 1)
        if not len(left) or not len(right) or (len(left) == 1 and len(right) == 1 and left.column("rep")[0] == right.column("rep")[0]):
            return
        ok = _near(left, right, floor, threshold) & (left.column("comp").to_numpy()[:, None] != right.column("comp").to_numpy()[None, :])
        reps = np.union1d(left.column("rep").to_numpy()[ok.any(axis=1)], right.column("rep").to_numpy()[ok.any(axis=0)])
        if len(reps):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), table.column("hub")[0].as_py())), pa.array(reps)], names=["hub", "rep"])

    return run


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of both lists, by products of 0/1 matrices over their common hashes."""
    na, nb = [len(x) for x in a], [len(x) for x in b]
    ha, hb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(np.unique(ha), np.unique(hb), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(common):
        return out

    def places(h: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        ok = common[at] == h
        return np.repeat(np.arange(len(sizes)), sizes)[ok], at[ok]

    (ra, ca), (rb, cb) = places(ha, na), places(hb, nb)
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
    for lo in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - lo)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            s, e = np.searchsorted(c, [lo, lo + width])
            m[r[s:e], c[s:e] - lo] = 1
        out += x @ y.T
    return out


def _linked(threshold: float, num: int, den: int):
    """Links, confirmed on full sets, that join the components of a pair of blocks."""
    floor = least_matches(threshold)

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right = _side(table, 0), _side(table, 1)
        if not len(left) or not len(right):
            return
        ok = _near(left, right, floor, threshold)
        ok &= left.column("comp").to_numpy()[:, None] != right.column("comp").to_numpy()[None, :]
        i, j = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
        if not len(i):
            return
        left, right, ok = left.take(pa.array(i)), right.take(pa.array(j)), ok[np.ix_(i, j)]
        sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")] for t in (left, right)]
        both = np.rint(_intersections(*sets)).astype(np.int64)
        n, m = left.column("n").to_numpy()[:, None], right.column("n").to_numpy()[None, :]
        ok &= den * both >= num * (n + m - both)
        mine, others = left.column("comp").to_numpy().copy(), right.column("comp").to_numpy().copy()
        a, b = left.column("rep").to_numpy(), right.column("rep").to_numpy()
        out = []
        for r in np.flatnonzero(ok.any(axis=1)).tolist():
            cols = np.flatnonzero(ok[r] & (others != mine[r]))
            while len(cols):
                c, into, gone = int(cols[0]), mine[r], others[cols[0]]
                out.append((int(a[r]), int(b[c])))
                mine[mine == gone] = into
                others[others == gone] = into
                cols = cols[others[cols] != mine[r]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return run


def _in_blocks(members: DataFrame, rows: int) -> DataFrame:
    """Members (hub, rep, few, ...) dealt to pairs of a block i of their cluster's ``few`` and a block j of all, as side
    0 and side 1. The copies of a cluster of n members with m ``few`` are about 2 * n * m / BLOCK, and n if m is 1."""
    size = members.groupBy("hub").agg(F.count("*").alias("size"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.ceil(F.sum(F.col("few").cast("int")) / BLOCK).cast("int").alias("few_parts"))
    m = join_by_size(members, size, "hub", "size", rows)
    h = F.xxhash64("rep")
    i, j = F.pmod(h, F.col("few_parts")).cast("int"), F.pmod(h, F.col("parts")).cast("int")
    left = F.when(F.col("few"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(0).alias("side"))))
    right = F.transform(F.sequence(F.lit(0), F.col("few_parts") - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(1).alias("side")))
    both = F.concat(F.coalesce(left, F.array().cast("array<struct<i:int,j:int,side:int>>")), right)
    return m.where("few_parts > 0").withColumn("at", F.explode(both)).select("hub", "at.i", "at.j", "at.side", *[c for c in members.columns if c not in ("hub", "few")])


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                sets = distinct_sets(*shingle_hashes(hash_words(data, offsets[lo : hi + 1]), width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "hashes"])
        release_memory()

    return run


@durable.leaves_only("minhash")
def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Classes of documents linked by ``den * |A & B| >= num * |A | B|`` over distinct ``shingle``-word shingles.

    Returns id_col, n_shingles, component_id (least id reachable, itself included) and kept (id = component_id), one
    row per input row. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text with fewer words than a
    shingle is one shingle; null and empty texts have none and link with nothing. Rows with a null id keep a null
    component_id and kept = true, as they can't be told apart. Rows that repeat an id all get the result of the least of
    its texts. Other columns are not read.
    """
    threshold = num / den
    durable.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base, repeated = rows, _repeats(rows)
    if repeated:
        base = rows.where("id is not null").groupBy("id").agg(F.min("text").alias("text")).unionAll(rows.where("id is null"))
    sketch = durable.write(base.mapInArrow(_sketch(shingle), _SKETCH), "sketch")
    usable = sketch.where("n > 0 and id is not null")
    classes = durable.write(
        usable.groupBy("h1", "h2").agg(F.min(F.struct("id", "n", *_SIG, "bands")).alias("r"), F.count("*").alias("copies")).select("h1", "h2", F.col("r.id").alias("rep"), "copies", *[f"r.{c}" for c in ("n", *_SIG, "bands")]), "classes"
    )
    n = classes.count()
    light = classes.select("rep", "n", *_SIG)
    band = classes.select("rep", F.explode("bands").alias("k"))
    per = PERMUTATIONS // BAND_ROWS
    hubs = band.groupBy("k").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count("*").alias("size")).where("hub < top").select("k", "hub", "size")
    cluster = durable.write(join_by_size(band, hubs, "k", "size", n * per).select("hub", "rep").distinct(), "clusters")
    in_clusters = cluster.count()
    texts = base.where("id is not null").select(F.col("id").alias("rep"), "text")

    def links(members: DataFrame) -> DataFrame:
        """Confirmed links of (hub, rep, comp, few), between different components."""
        # written, as the blocks read it several times over: each plan below would else hold all that leads to it as often
        members = durable.write(members.join(light, "rep"), "members")
        near = by_group(_in_blocks(members, in_clusters), ["hub", "i", "j"], ["side"], _marked(threshold), "hub long, rep long")
        near = durable.write(near.distinct(), "near")
        ids = near.select("rep").distinct()
        if near.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        sets = texts.join(ids, "rep").mapInArrow(_set_rows(shingle), "rep long, hashes binary")
        picked = durable.write(members.join(near, ["hub", "rep"], "left_semi"), "picked")
        found = by_group(_in_blocks(picked.join(sets, "rep"), in_clusters), ["hub", "i", "j"], ["side"], _linked(threshold, num, den), "a long, b long")
        return durable.write(found.distinct(), "links")

    # each class with the hub of its least cluster
    first = cluster.groupBy("rep").agg(F.min("hub").alias("hub"))
    own = F.col("rep") == F.col("hub")
    star = first.where(~own).select("hub", "rep").unionAll(first.where(~own).select("hub", F.col("hub").alias("rep")).distinct())
    edges = links(star.select("hub", "rep", F.col("rep").alias("comp"), own.alias("few")))
    comp = durable.write(connected_components(edges), "labels")
    member = durable.write(cluster.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("hub", "rep", F.coalesce("component", "rep").alias("comp")), "members")
    share = member.groupBy("hub", "comp").agg(F.count("*").alias("size"))
    mixed = share.groupBy("hub").agg(F.max(F.struct("size", "comp")).alias("most"), F.count("*").alias("comps"), F.sum("size").alias("size")).where("comps > 1")
    mixed = mixed.select("hub", F.col("most.comp").alias("largest"), "size")
    inside = member.join(mixed.select("hub"), "hub", "left_semi")  # what is split by size below is then mixed only
    more = links(join_by_size(inside, mixed, "hub", "size", in_clusters).select("hub", "rep", "comp", (F.col("comp") != F.col("largest")).alias("few")))
    if not more.isEmpty():
        comp = durable.write(connected_components(edges.unionAll(more)), "labels")

    of_class = classes.select("h1", "h2", "rep").join(comp.select(F.col("node").alias("rep"), F.col("component")), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    # the empty set is not a class; its rows stand alone
    out = sketch.select("id", "n", F.when(F.col("n") > 0, F.col("h1")).alias("h1"), F.when(F.col("n") > 0, F.col("h2")).alias("h2")).join(of_class, ["h1", "h2"], "left")
    root = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))
    if repeated:
        out = out.where(F.col(id_col).isNotNull()).join(rows.where("id is not null").select(F.col("id").alias(id_col)), id_col).unionAll(out.where(F.col(id_col).isNull()))
    return out


def _repeats(rows: DataFrame) -> bool:
    """Whether some id stands on several rows."""
    return not rows.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose document is the least of its near-duplicate group.

    Texts without words and rows with a null id all stay. Of rows that repeat an id one stays, that of the least text.
    """
    found = minhash_components(docs, id_col, text_col, shingle, num, den)
    gone = durable.write(found.where(~F.col("kept")).select(F.col(id_col).alias("id")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    # the table's own columns are in a struct, whatever their names
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"))
    out = rows.join(F.broadcast(gone) if few else gone, "id", "left_anti")
    if _repeats(rows.select("id")):
        text = F.col("row").getField(text_col)
        out = out.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(text))).where("nth = 1 or id is null")
    return out.select("row.*")
