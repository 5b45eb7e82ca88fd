"""Packing of tokenised documents into sequences of bounded length by best-fit decreasing.

Documents are tokenised where they lie and cut into pieces; only piece lengths need be shuffled. Pieces are dealt evenly
over shards of about SHARD_PIECES by a hash of their row and number, so a very long document, a hot source or an id on
many rows is spread too, and each shard places its pieces, longest first, into the tightest open sequence that a segment
tree over remaining capacities finds in logarithmic time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import durable
from .hashing import release_memory
from .tokens import WordEncoder, encoded

#: Pieces of a shard; a shard leaves a handful of sequences unfilled.
SHARD_PIECES = 25_000

_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, end_id: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and a final ``end_id``, cut into pieces of ``max_len``.

    ids is binary, little-endian unsigned 32-bit. A null or empty text has the one id ``end_id``. Null ids and repeated
    rows are ordinary rows. Each piece also has its row's columns ``carry``; other columns are not read.
    """
    schema = T.StructType.fromDDL("doc_id long, piece int, start long, length long, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer_path)
        for batch in batches:
            for lo, _, ids, bounds in encoded(enc, batch.column(1), end_id):
                size = np.diff(bounds)
                pieces = -(-size // max_len)
                row = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * max_len
                at = bounds[row] + start
                cut = pa.py_buffer((np.append(at, bounds[-1]) * 4).astype(np.int32))
                flat = pa.Array.from_buffers(pa.binary(), len(row), [None, cut, pa.py_buffer(ids)])
                of = pa.array(lo + row)
                fixed = [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(np.minimum(size[row] - start, max_len)), flat]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *fixed, *(batch.column(2 + k).take(of) for k in range(len(carry)))], names=[*schema.names, *carry])
        release_memory()

    durable.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    return rows.mapInArrow(run, T.StructType([*schema.fields, *rows.schema.fields[2:]]))


class CapacityTree:
    """Counts of open bins by remaining capacity, with the sums of a segment tree over capacities 0..size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of at least ``need`` with an open bin, or -1."""
        count = self.count
        i = need + self.leaves
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i *= 2
                    if not count[i]:
                        i += 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in descending order into the tightest open bin."""
    order = np.argsort(-lengths, kind="stable")
    tree, open_bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        room = tree.tightest(need)
        if room < 0:
            b, room, made = made, capacity, made + 1
        else:
            b = open_bins[room].pop()
            tree.add(room, -1)
        bins[i], offsets[i] = b, capacity - room
        left = room - need
        if left:
            open_bins[left].append(b)
            tree.add(left, 1)
    return bins, offsets


def place_pieces(pieces: DataFrame, shards: int, max_len: int = 2048, row_col: str | None = None) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length and any other columns) with sequence_id and offset.

    sequence_id is unique over all shards; offsets of a sequence are gapless from 0. Order within a shard is by
    descending length, then doc_id, piece and start, so reruns agree. A null doc_id sorts last. ``row_col`` is a
    column, left out of the result, that tells rows of equal or null doc_id apart, so that they are spread over shards.
    """
    names = [c for c in pieces.columns if c != row_col]
    schema = T.StructType([*(f for f in pieces.schema.fields if f.name != row_col), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit_decreasing(pdf["length"].to_numpy(np.int64), max_len)
        pdf["sequence_id"], pdf["offset"] = bins * shards + int(key[0]), offsets
        return pdf[[*names, "sequence_id", "offset"]]

    key = [F.col(row_col)] if row_col else []
    shard = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "piece", *key), F.lit(shards)).cast("int")
    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(pack, schema)


def shard_count(pieces: DataFrame, shard_pieces: int = SHARD_PIECES) -> int:
    return max(1, -(-pieces.count() // shard_pieces))
