"""Repeated substrings by suffix sorting with a difference cover.

A *window* is a string of ``length`` bytes within a document; its bytes go if the same window starts earlier.

1. Each window has an anchor, its rightmost minimal gram of ``length // 2`` bytes by hash, and equal windows have equal
   anchors. Anchors are shuffled with a hash of all bytes that their windows can cover, their context. An anchor whose
   context was seen earlier repeats with all its windows; one whose gram has a single context has no earlier window.
2. What is left are windows whose anchor occurs in several contexts, at the edges of repeated passages. They are cut out
   with their bytes, dealt by their anchor's hash, and each deal is suffix-sorted by ``suffix_ranks``: triples at the
   positions of the difference cover {1, 2} mod 3 are sorted and named, the string of names is sorted by recursion, and
   the suffixes left are merged with these. Adjacent suffixes are then compared by their first ``length`` bytes.
3. The spans of windows that repeat are joined with their documents and cut out.

The recursion ends once names cover a window, and ranks only what the level above asks for. Anchors with more than HOT
bytes of contexts are split into windows, which are counted by their bytes (combined before the shuffle) in place of step 2.
Texts are hashed in pieces of bounded size; a task holds one batch of texts, or one deal of at most DEAL bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import durable
from .hashing import _P, _P_INV, mix64, release_memory, text_buffers

#: Bytes of text of one numpy pass (its positions must fit POS_BITS), anchors that are compared before the shuffle.
PIECE = 1 << 19
POS_BITS = 20
FLUSH = 400_000
#: Bytes that are suffix-sorted together, and bytes of an anchor's contexts beyond which its windows are dealt one by one.
DEAL = 1 << 20
HOT = 1 << 19
_CODE = np.random.default_rng(31_337).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OPEN, _REPEATED = 1, 2


def _powers(base: int) -> np.ndarray:
    steps = np.full(PIECE + 1024, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


@dataclass
class Anchored:
    """A piece of text: the documents ``lo`` to ``hi`` with their ``edges``, or part of one from its byte ``base`` on;
    ``valid`` are the starts of its own windows and ``anchor`` their anchors' positions in the piece."""

    data: np.ndarray
    lo: int
    edges: np.ndarray
    base: int
    valid: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray
    total: np.ndarray


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int, int]]:
    """(first document, bytes, edges, base, own start, own end) of pieces; own windows start between the last two."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= PIECE:
            yield lo, data[a:b], offsets[lo : hi + 1] - a, 0, 0, b - a
        else:
            step = PIECE - 4 * length
            for at in range(a, b, step):
                left, right = max(a, at - length), min(b, at + step + 2 * length)
                yield lo, data[left:right], np.array([0, right - left]), left - a, at - left, min(at + step, b) - left
        lo = hi


def _anchored(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[Anchored]:
    if not _POWERS:
        _POWERS.extend((_powers(_P), _powers(_P_INV)))
    up, down = _POWERS
    gram = length // 2
    width = length - gram + 1
    for lo, part, edges, base, start, end in _pieces(data, offsets, length):
        n = len(part)
        if n < length:
            continue
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[part] * up[:n], out=total[1:])
        h = mix64((total[gram:] - total[:-gram]) * down[: n - gram + 1])
        # the rightmost of equal minima: the low bits count down along the text
        low = np.uint64((1 << POS_BITS) - 1)
        least = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        span = 1
        while span < width:
            step = min(span, width - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        where = (low - (least & low)).astype(np.int64)
        ends = np.repeat(edges[1:], np.diff(edges))
        at = np.arange(n - length + 1)
        own = (at + length <= ends[: len(at)]) & (at >= start) & (at < end)
        yield Anchored(part, lo, edges, base, at[own], where[own], h, total)


def _contexts(p: Anchored, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document in the batch, position in it, gram hash, context hash) of the distinct anchors of a piece."""
    back = length - length // 2
    at = p.anchor[np.concatenate(([True], p.anchor[1:] != p.anchor[:-1]))] if len(p.anchor) else p.anchor
    doc = np.searchsorted(p.edges, at, "right") - 1
    left, right = np.maximum(p.edges[doc], at - back), np.minimum(p.edges[doc + 1], at + length)
    ctx = (p.total[right] - p.total[left]) * _POWERS[1][left]
    ctx = mix64(ctx ^ mix64(((at - left).astype(np.uint64) << np.uint64(32)) | (right - at).astype(np.uint64)))
    return doc + p.lo, at - p.edges[doc] + p.base, p.gram[at], ctx


_ANCHOR = "h long, c long, doc long, row long, at int, seen boolean"


def _anchors(length: int):
    """Anchors with their contexts; those whose context stands earlier in the same pass are ``seen`` and spread."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, row, at, h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, row, doc, c, h))
        doc, row, at, h, c = (x[order] for x in (doc, row, at, h, c))
        seen = np.zeros(len(h), bool)
        seen[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        h = np.where(seen, mix64(row.astype(np.uint64) * np.uint64(_P) + at.astype(np.uint64)), h)
        cols = (h.view(np.int64), c.view(np.int64), doc, row, at.astype(np.int32), seen)
        whole = pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "c", "doc", "row", "at", "seen"])
        for k in range(0, len(seen), 50_000):
            yield whole.slice(k, 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            docs, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "row"))
            last: tuple[int, int] | None = None
            for p in _anchored(*text_buffers(batch.column("text")), length):
                doc, at, h, c = _contexts(p, length)
                if last is not None and last[0] == p.lo:  # a further piece of a document begins with known anchors
                    new = at > last[1]
                    doc, at, h, c = doc[new], at[new], h[new], c[new]
                if not len(at):
                    continue
                last = (int(doc[-1]), int(at[-1]))
                held.append((docs[doc], rows[doc], at, h, c))
                size += len(at)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
        release_memory()

    return run


_STATE = "row long, at int, open boolean"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by (h, c, doc, row, at): those seen earlier in their context, and the first of each context of
    a gram that has several (open). The first anchor of a gram waits until a second context shows."""
    last = None  # (h, c) so far
    waiting = None  # (row, at) of a gram with one context so far
    for batch in batches:
        if not len(batch):
            continue
        seen = batch.column("seen").to_numpy(zero_copy_only=False)
        row, at, h, c = (batch.column(k).to_numpy() for k in ("row", "at", "h", "c"))
        out = [(row[seen], at[seen], np.zeros(int(seen.sum()), bool))]
        row, at, h, c = row[~seen], at[~seen], h[~seen], c[~seen]
        if len(h):
            gram, first = np.ones(len(h), bool), np.ones(len(h), bool)
            gram[1:] = h[1:] != h[:-1]
            first[1:] = gram[1:] | (c[1:] != c[:-1])
            if last is not None and last[0] == h[0]:
                gram[0], first[0] = False, last[1] != c[0]
            elif last is not None:
                waiting = None
            group = np.cumsum(gram) - gram[0]
            contexts = np.bincount(group, weights=first).astype(np.int64)
            if not gram[0]:
                contexts[0] += 1 if waiting is not None else 2
            several = first & (contexts[group] >= 2)
            if not gram[0] and waiting is not None and contexts[0] >= 2:
                out.append((np.array([waiting[0]]), np.array([waiting[1]], np.int32), np.array([True])))
                waiting = None
            out.append((row[~first], at[~first], np.zeros(int((~first).sum()), bool)))
            out.append((row[several], at[several], np.ones(int(several.sum()), bool)))
            if contexts[-1] >= 2:
                waiting = None
            elif gram.any():
                k = int(np.flatnonzero(gram)[-1])
                waiting = (int(row[k]), int(at[k]))
            last = (h[-1], c[-1])
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2])], names=["row", "at", "open"])
    release_memory()


_WINDOWS = "h long, doc long, row long, start int, n int, bytes binary"


def _runs(mask: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, as indices, of runs of ``mask`` along which each of ``keys`` is the same or, if rising, has steps of one."""
    if not mask.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    idx = np.flatnonzero(mask)
    cut = np.ones(len(idx), bool)
    cut[1:] = np.diff(idx) != 1
    for k in keys:
        cut[1:] |= k[idx[1:]] != k[idx[:-1]]
    starts = np.flatnonzero(cut)
    return idx[starts], idx[np.append(starts[1:] - 1, len(idx) - 1)] + 1


def _open_windows(length: int):
    """Runs of windows that repeat (h null), and runs of windows of one open anchor with their bytes."""
    gram = length // 2
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "row"))
            lists = batch.column("states")
            first = lists.offsets.to_numpy()
            first = first - first[0]
            marks = lists.flatten().to_numpy(zero_copy_only=False)
            for p in _anchored(*text_buffers(batch.column("text")), length):
                state = np.zeros(len(p.data) + 1, np.int8)
                for d in range(len(p.edges) - 1):
                    m = marks[first[p.lo + d] : first[p.lo + d + 1]]
                    at = (m >> 1) - p.base + p.edges[d]
                    ok = (at >= p.edges[d]) & (at < p.edges[d + 1])
                    state[at[ok]] = np.where(m[ok] & 1, _OPEN, _REPEATED)
                if not len(p.valid):
                    continue
                repeated = np.concatenate(([0], np.cumsum(state == _REPEATED)))
                some = repeated[np.minimum(p.valid + width, len(state))] > repeated[p.valid]
                left = (state[p.anchor] == _OPEN) & ~some
                own = np.searchsorted(p.edges, p.valid, "right") - 1
                out = []
                for mask, keys in ((some, (own,)), (left, (own, p.anchor))):
                    a, b = _runs(mask, *keys)
                    # runs of valid windows may skip the end of a document, never within one
                    doc, start = own[a], p.valid[a]
                    out.append((doc, start, b - a))
                n = [len(x[0]) for x in out]
                doc, start, size = (np.concatenate(x) for x in zip(*out, strict=True))
                h = p.gram.view(np.int64)[p.anchor[_runs(left, own, p.anchor)[0]]] if n[1] else np.zeros(0, np.int64)
                cut = [None] * n[0] + [p.data[s : s + k - 1 + length].tobytes() for s, k in zip(start[n[0] :].tolist(), size[n[0] :].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((np.zeros(n[0], np.int64), h)), mask=np.arange(sum(n)) < n[0]),
                        pa.array(docs[doc + p.lo]),
                        pa.array(rows[doc + p.lo]),
                        pa.array((start - p.edges[doc] + p.base).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.array(cut, pa.binary()),
                    ],
                    names=["h", "doc", "row", "start", "n", "bytes"],
                )
        release_memory()

    return run


def _names(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Order-preserving names, from 1, of the triples of ``text`` at ``at``, and their number."""
    bits = np.uint64(max(1, int(text.max()).bit_length()))
    t = text.astype(np.uint64)
    if bits * 3 <= 64:
        key = (((t[at] << bits) | t[at + 1]) << bits) | t[at + 2]
    else:  # pairs are named first
        pair = np.unique((t[at] << bits) | t[at + 1], return_inverse=True)[1].astype(np.uint64)
        key = (pair << bits) | t[at + 2]
    values, names = np.unique(key, return_inverse=True)
    return names + 1, len(values)


def suffix_ranks(text: np.ndarray, asked: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of ``text`` that ``asked`` marks, in an order right for all that differ within ``depth``
    symbols; suffixes equal so far lie together. ``text`` holds positive integers and ends with three zeros."""
    n = len(text)
    at = np.flatnonzero(asked)
    if depth <= 3:
        ranks = np.zeros(n, np.int64)
        ranks[at] = _names(text, at)[0]
        return ranks
    # sample: positions of the cover; those past the zeros are not needed
    one, two = np.arange(1, n - 2, 3), np.arange(2, n - 2, 3)
    sample = np.concatenate((one, two))
    names, distinct = _names(text, sample)
    slot = np.zeros(n + 3, np.int64)  # where a sampled position stands in the string of names
    slot[one], slot[two] = np.arange(len(one)), len(one) + 1 + np.arange(len(two))
    rank = np.zeros(n + 3, np.int64)
    if distinct == len(sample):
        rank[sample] = names
    else:
        reduced = np.concatenate((names[: len(one)], [0], names[len(one) :], [0, 0, 0]))
        need = np.zeros(n + 3, bool)
        for k in range(3):
            need[at + k] = True
        picked = sample[need[sample]]
        below = np.zeros(len(reduced), bool)
        below[slot[picked]] = True
        rank[picked] = suffix_ranks(reduced, below, -(-depth // 3))[slot[picked]]
    padded = np.concatenate((text, [0, 0, 0])).astype(np.uint64)
    r = rank.astype(np.uint64)
    bits, sym = np.uint64(int(r.max()).bit_length()), np.uint64(max(1, int(text.max()).bit_length()))
    zero, own = at[at % 3 == 0], at[at % 3 != 0]

    def key(p: np.ndarray, further: int) -> np.ndarray:
        k = padded[p]
        if further == 2:
            k = (k << sym) | padded[p + 1]
        return (k << bits) | r[p + further]

    place = np.zeros(n, np.int64)
    own_ranks = np.sort(rank[own])
    place[own] = np.searchsorted(own_ranks, rank[own], "left")
    if len(zero):
        near = key(zero, 1)
        place[zero] = np.searchsorted(np.sort(near), near, "left")
        for cls, further in ((1, 1), (2, 2)):
            others = own[own % 3 == cls]
            mine, theirs = key(zero, further), key(others, further)
            place[zero] += np.searchsorted(np.sort(theirs), mine, "left")
            place[others] += np.searchsorted(np.sort(mine), theirs, "left")
    return place


def later_windows(pieces: list[bytes], ages: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, which of its windows also start in a piece of lesser age, or earlier in the same piece."""
    sizes = np.array([len(p) for p in pieces])
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    data = np.zeros(int(first[-1]) + 3, np.int64)
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    data[: len(raw)] = raw.astype(np.int64) + 1
    data[first[1:] - 1] = 0
    count = sizes - length + 1
    inner = np.arange(int(count.sum())) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    starts = inner + np.repeat(first[:-1], count)
    asked = np.zeros(len(data), bool)
    asked[starts] = True
    order = np.argsort(suffix_ranks(data, asked, length)[starts], kind="stable")
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    same = np.zeros(len(order), bool)
    for k in range(1, len(order), 8192):
        a, b = starts[order[k - 1 : k + 8191]], starts[order[k : k + 8192]]
        same[k : k + 8192] = (view[a[: len(b)]] == view[b]).all(axis=1)
    age = (np.repeat(np.argsort(np.argsort(ages, kind="stable"), kind="stable"), count).astype(np.int64) << 32) + inner
    age = age[order]
    run = np.cumsum(~same) - 1
    least = np.minimum.reduceat(age, np.flatnonzero(~same)) if len(age) else age
    later = np.zeros(len(order), bool)
    later[order] = age > least[run]
    return np.split(later, np.cumsum(count)[:-1])


def _sorted_deals(length: int):
    """Runs (row, start, n) of windows that also start earlier, from rows sorted by ``h``, by deals of whole values."""

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        doc, row, start = (t.column(k).to_numpy() for k in ("doc", "row", "start"))
        ages = np.empty(len(t), np.int64)
        ages[np.lexsort((start, row, doc))] = np.arange(len(t))
        out = []
        for k, later in enumerate(later_windows(t.column("bytes").to_pylist(), ages, length)):
            a, b = _runs(later)
            out += [(int(row[k]), int(start[k]) + x, y - x) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        if out:
            r, s, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int32())], names=["row", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not len(batch):
                continue
            h = batch.column("h").to_numpy()
            bounds = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False))))
            begin = np.concatenate(([last is None or h[0] != last], h[1:] != h[:-1]))
            lo = 0
            for cut in np.flatnonzero(begin).tolist():
                if size + int(bounds[cut] - bounds[lo]) >= DEAL:
                    if cut > lo:
                        held.append(batch.slice(lo, cut - lo))
                    yield from solve(held)
                    held, size, lo = [], 0, cut
            held.append(batch.slice(lo))
            size += int(bounds[-1] - bounds[lo])
            last = h[-1]
        if held:
            yield from solve(held)
        release_memory()

    return run


_CUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(length: int):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("doc_id"), batch.column("runs").to_pylist()
            data, offsets = text_buffers(batch.column("text"))
            spans, kept = [], []
            for i, runs in enumerate(lists):
                text = data[offsets[i] : offsets[i + 1]]
                merged: list[list[int]] = []
                for r in sorted((r["start"], r["n"]) for r in runs or ()):
                    a, b = r[0], r[0] + r[1] - 1 + length
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                spans.append([{"start": a, "end": b} for a, b in merged])
                at, parts = 0, []
                for a, b in merged:
                    parts.append(text[at:a].tobytes())
                    at = b
                kept.append(b"".join([*parts, text[at:].tobytes()]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])
        release_memory()

    return run


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """Runs (row, start, n) of windows that also start earlier, of ``docs`` with columns (doc, row, text)."""
    long = docs.where(F.octet_length("text") >= length)
    anchors = long.mapInArrow(_anchors(length), _ANCHOR).repartition("h").sortWithinPartitions("h", "c", "doc", "row", "at")
    states = durable.write(anchors.mapInArrow(_states, _STATE), "states")
    lists = states.groupBy("row").agg(F.collect_list(F.col("at").cast("long") * 2 + F.col("open").cast("long")).alias("states"))
    windows = durable.write(long.join(lists, "row").select("doc", "row", "text", "states").mapInArrow(_open_windows(length), _WINDOWS), "windows")
    pieces = windows.where("h is not null")
    hot = pieces.groupBy("h").agg(F.sum(F.octet_length("bytes")).alias("size")).where(F.col("size") > HOT).select("h")
    cold = pieces.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    runs = cold.mapInArrow(_sorted_deals(length), "row long, start int, n int")
    one = pieces.join(hot, "h", "left_semi").select("doc", "row", "start", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    one = one.select(F.struct("doc", "row", (F.col("start") + F.col("k")).alias("start")).alias("at"), F.expr(f"substring(bytes, k + 1, {length})").alias("w"))
    least = one.groupBy("w").agg(F.min("at").alias("least"), F.count("*").alias("times")).where("times > 1").drop("times")
    split = one.join(least, "w").where("at > least").select("at.row", "at.start", F.lit(1).alias("n"))
    known = windows.where("h is null").select("row", "start", "n")
    return known.unionByName(runs).unionByName(split)


@durable.leaves_only("kept-texts")
def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: byte ranges covered by a string of ``length`` bytes that also starts
    in an earlier document, or earlier in the same one, and the bytes that are left.

    Documents are ordered by id, nulls last; rows that repeat an id are documents of their own, in the order of the
    table's rows. A null text is empty; texts shorter than ``length`` have no spans. Other columns are not read.
    """
    durable.bounded_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    keyed = named.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "row", "text")
    runs = repeated_windows(keyed, length).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return named.join(runs, "row", "left").select("doc_id", "text", "runs").mapInArrow(_cut(length), _CUT)


ORACLE_SQL = """
WITH d AS (SELECT coalesce(doc_id, 9223372036854775807) AS doc, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc, 200 * j AS base, substr(x, 400 * j + 1, 598) AS y FROM d, unnest(range(0, CAST(ceil(greatest(0, length(x) // 2 - 99) / 200) AS BIGINT))) AS t(j)),
w AS (SELECT doc, base + i AS i, md5_number(substr(y, 2 * i + 1, 200)) AS m FROM b, unnest(range(0, length(y) // 2 - 99)) AS t(i)),
f AS (SELECT doc, i, row_number() OVER (PARTITION BY m ORDER BY doc, i) AS nth FROM w),
c AS (SELECT doc, i, i - lag(i) OVER (PARTITION BY doc ORDER BY i) AS gap FROM f WHERE nth > 1),
g AS (SELECT doc, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY i) AS run FROM c),
s AS (SELECT doc, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY ALL),
k AS (SELECT doc, a, b, coalesce(lag(b) OVER (PARTITION BY doc ORDER BY a), 0) AS before FROM s),
r AS (SELECT doc, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS stop, list((before, a) ORDER BY a) AS kept FROM k GROUP BY doc)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN kept IS NULL THEN x ELSE list_aggregate([substr(x, 2 * y[1] + 1, 2 * (y[2] - y[1])) FOR y IN kept], 'string_agg', '') || substr(x, 2 * stop + 1) END)) AS kept_sha256
FROM d LEFT JOIN r USING (doc)
"""
