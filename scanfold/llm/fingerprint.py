"""Bottom-k sketches of word-shingle hashes as document fingerprints.

A sketch holds the k least of the set's 48-bit hashes. Sketches of parts merge into that of the whole; two of them
estimate resemblance, containment and distinct shingle counts, exactly where a set has at most k shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import durable
from .hashing import SLICE_BYTES, hash_words, mix64, shingle_hashes, slices, text_buffers

K = 128
WIDTH = 5
_BYTES = 6
_RANGE = float(1 << (8 * _BYTES))
_NULL_ID = -(1 << 63)


def sketches(texts: list[str], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """Ascending distinct hashes, k at most, of each text's shingles."""
    data, offsets = text_buffers(pa.array(texts, pa.large_string()))
    out = []
    for lo, hi in slices(offsets):
        h, bounds = shingle_hashes(hash_words(data, offsets[lo : hi + 1]), width)
        h = mix64(h) >> np.uint64(64 - 8 * _BYTES)
        for i in range(hi - lo):
            own = h[bounds[i] : bounds[i + 1]]
            if len(own) > 8 * k:
                # the k least distinct values are among the 4k least unless many repeat
                least = np.unique(np.partition(own, 4 * k)[: 4 * k])
                own = least if len(least) >= k else np.unique(own)
            else:
                own = np.unique(own)
            out.append(own[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of both sets."""
    return np.union1d(a, b)[:k]


def encode(sketch: np.ndarray) -> str:
    """A sketch as base64 of its big-endian 48-bit values."""
    raw = sketch.astype(">u8").tobytes()
    return base64.b64encode(np.frombuffer(raw, np.uint8).reshape(-1, 8)[:, 8 - _BYTES :].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, _BYTES)
    return np.pad(raw, ((0, 0), (8 - _BYTES, 0))).copy().view(">u8").ravel().astype(np.uint64)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / _RANGE)


def _shared_below(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int]:
    """Values of a, of b and of both up to the last value that both sketches are complete for."""
    top = min(a[-1] if len(a) >= k else np.uint64(1 << 63), b[-1] if len(b) >= k else np.uint64(1 << 63))
    x, y = a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]
    if not len(x) or not len(y):
        return len(x), len(y), 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return len(x), len(y), int((y[at] == x).sum())


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A & B| / |A | B| by the k least values of the union; 1 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    _, _, both = _shared_below(a[a <= union[-1]], b[b <= union[-1]], 1 << 62)
    return both / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A & B| / |A|; 1 for an empty A."""
    x, _, both = _shared_below(a, b, k)
    return both / x if x else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """(id_col, n_chars, fingerprint, n_distinct) of each row; null texts are empty and have the empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(x or "") for x in batch.column(1).to_pylist()])
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
                texts = [x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()]
                s = sketches(texts, k, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(encode, s))), pa.array([distinct_count(x, k) for x in s])], names=["i", "n", "f", "d"])
                lo = hi

    durable.bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"`{id_col}` long, n_chars long, fingerprint string, n_distinct double")


def _blocks_of(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Block of each id; blocks count up as ids go down."""
    return (len(bounds) - np.searchsorted(bounds, ids, "right")).astype(np.int32)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)


def followed_by_next(docs: DataFrame, id_col: str, text_col: str, blocks: int | None = None) -> tuple[DataFrame, int]:
    """Rows (block, role, id, text) such that, sorted by block, role, descending id and text, each row of role 0 is
    followed by its successor in the order of the whole table; rows of role 1 are only successors.

    Ids are cut into ranges at approximate quantiles. A range's first id is also sent to the range before it (the
    first one's to the last), so one shuffle of the texts suffices and no order over the whole table is made.
    """
    spark = docs.sparkSession
    durable.bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks or 4 * parts
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    key = base.select(F.coalesce("id", F.lit(_NULL_ID)).alias("id"))
    cuts = key.agg(F.percentile_approx("id", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0] if blocks > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            ids = _ids(batch.column(0))
            own = _blocks_of(ids, bounds)
            for b in np.unique(own).tolist():
                best[b] = max(best.get(b, _NULL_ID), int(ids[own == b].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], names=["block", "id"])

    # one row a block, a number that does not grow with the table
    first = sorted((r.block, r.id) for r in key.mapInArrow(tops, "block int, id long").groupBy("block").agg(F.max("id").alias("id")).collect())
    before = {top: first[i - 1][0] for i, (_, top) in enumerate(first)}
    tops_sorted = np.array(sorted(before), np.int64)
    to_block = np.array([before[t] for t in tops_sorted.tolist()], np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch.column(0))
            own = _blocks_of(ids, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(ids), np.int32)), batch.column(0), batch.column(1)], names=["block", "role", "id", "text"])
            at = np.searchsorted(tops_sorted, ids)
            head = np.flatnonzero((at < len(tops_sorted)) & (tops_sorted[np.minimum(at, len(tops_sorted) - 1)] == ids))
            if len(head):
                extra = batch.take(pa.array(head))
                yield pa.RecordBatch.from_arrays([pa.array(to_block[at[head]]), pa.array(np.ones(len(head), np.int32)), extra.column(0), extra.column(1)], names=["block", "role", "id", "text"])

    return base.mapInArrow(deal, "block int, role int, id long, text string"), parts


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprint of each text and of its edited text, and their likeness, one row per input row.

    The edited text has its last floor(n / 3) code points replaced by the first as many, or all, of the next row's
    text; rows go by descending id, then text, and the last is followed by the first. Null texts are empty; null ids
    come last; repeated ids are rows of their own. Two empty texts are alike (1).
    """
    rows, parts = followed_by_next(docs, id_col, text_col)
    ordered = rows.repartition(parts, "block").sortWithinPartitions("block", "role", F.col("id").desc_nulls_last(), F.coalesce("text", F.lit("")))

    def finish(held: list[tuple], following: str | None) -> pa.RecordBatch:
        texts = [t for _, t in held]
        after = [*texts[1:], following if following is not None else ""]
        edited = []
        for t, u in zip(texts, after, strict=True):
            cut = len(t) // 3
            edited.append(t[: len(t) - cut] + u[:cut])
        own = sketches([*texts, after[-1]], k, width)
        changed = sketches(edited, k, width)
        cols = [
            pa.array([i for i, _ in held], pa.int64()),
            pa.array(list(map(len, texts)), pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array([encode(s) for s in own[:-1]]),
            pa.array([encode(s) for s in changed]),
            pa.array([resemblance(a, b, k) for a, b in zip(own, changed, strict=False)], pa.float64()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _EDITED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        block, chars = None, 0
        for batch in batches:
            for b, role, i, t in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                t = t or ""
                if held and (role or b != block):
                    yield finish(held, t if b == block else None)
                    held, chars = [], 0
                if role:
                    continue
                if held and chars > SLICE_BYTES:
                    yield finish(held, t)
                    held, chars = [], 0
                block = b
                held.append((i, t))
                chars += len(t)
        if held:
            yield finish(held, None)

    return ordered.mapInArrow(run, _EDITED)
