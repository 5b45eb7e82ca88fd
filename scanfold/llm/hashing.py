"""Vectorised word and shingle hashing over Arrow string columns.

The text of a whole Arrow batch is hashed in a few numpy passes over its UTF-8 buffer, in slices of bounded size, so a
task needs a few dozen MB whatever the length of a document.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed in one numpy pass; a single longer document is still one pass.
SLICE_BYTES = 1 << 19

_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_P = int(_RNG.integers(1 << 61, 1 << 62)) * 4 + 3
_P_INV = pow(_P, -1, 1 << 64)
_LANE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words of more bytes are hashed by a digest: long patterned words collide in a polynomial modulo a power of two.
LONG_WORD = 64
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def release_memory() -> None:
    """Give freed memory back to the system; called at the end of a task, as idle workers stay."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand and kept per worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 1)
            for name, base in (("up", _P), ("down", _P_INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))


@dataclass
class Words:
    """Words of consecutive documents: ``hash[first[i]:first[i + 1]]`` are those of document i; ``start`` and ``end``
    are byte offsets into ``data``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    doc_byte: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets.astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, or of one longer document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def hash_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of documents ``data[offsets[i]:offsets[i + 1]]`` with A-Z lower-cased hashes."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    edge = offsets - base
    if not len(part):
        none = np.zeros(0, np.int64)
        return Words(part, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), edge)
    solid = ~_SPACE[part]
    cut = np.zeros(len(part) + 1, bool)
    cut[edge] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    _Powers.upto(len(part))
    total = np.empty(len(part) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[part] * _Powers.up[: len(part)], out=total[1:])
    h = mix64((total[end] - total[start]) * _Powers.down[start] + (end - start).astype(np.uint64) * _LANE[63])
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(part[start[i] : end[i]].tobytes().translate(_FOLD), digest_size=8).digest(), "little")
    return Words(part, start, end, h, np.searchsorted(start, edge).astype(np.int64), edge)


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles, in order, with n + 1 bounds by document. A document with fewer words has
    its whole sequence as one shingle; one without words has none."""
    h, first = words.hash, words.first
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(bounds[-1]), np.uint64)
    full = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        full += h[j : j + len(full)] * _LANE[j]
    full = mix64(full)
    # the k-th shingle of document i starts at word first[i] + k
    at = np.arange(len(out)) - np.repeat(bounds[:-1], count) + np.repeat(first[:-1], count)
    whole = np.repeat(n >= width, count)
    out[whole] = full[at[whole]]
    for i in np.flatnonzero((n > 0) & (n < width)):
        own = h[first[i] : first[i + 1]]
        out[bounds[i]] = mix64(np.atleast_1d((own * _LANE[: len(own)]).sum(dtype=np.uint64) ^ _LANE[32 + len(own)]))[0]
    return out, bounds


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each document."""
    out = []
    for i in range(len(bounds) - 1):
        own = np.sort(hashes[bounds[i] : bounds[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        out.append(own)
    return out
