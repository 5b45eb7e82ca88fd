"""Passages that repeat across documents, exactly or with edits, by chaining shared seeds.

1. Seeds are word k-mers picked by winnowing: the least hash of each window of consecutive k-mers, so any two texts that
   share a run of SEED + WINDOW - 1 words share a seed. For passages with edits every second SHORT-word k-mer, by its
   hash, is a seed too, so both texts take the same ones. n words with e of them edited share at least
   n - SHORT + 1 - SHORT * e k-mers, and if the edits stand SHORT + 1 words apart e of them. Matches of short seeds alone make a
   chain from LEAST_SHORT on that are SPREAD words apart: of 50 words with 10 evenly spaced edits, which share ten k-mers,
   98 % do (edits that stand closer leave longer runs); what has matches only within SPREAD words is a common phrase.
2. Each occurrence of a seed, and of a run of shared seeds, is matched with the first one, that of the least document and
   position. A passage in a third of all documents thus gives one match a seed and document, not one for each pair.
   Occurrences are shuffled once, packed by ranges of seeds as planes of bytes. A seed that many documents of one
   task's pass hold is matched with the first of these there, and only that one is shuffled.
3. Matches of a document and a reference document are chained in both orders at once; a chain pays for its gaps and its
   best predecessor comes from a Fenwick tree of prefix maxima.
4. Chains are aligned word by word: along each anchor's diagonal, with one change of diagonal at its best place between
   anchors, and beyond both ends as long as the score rises: a chain whose score still rises at the end of the words that
   were read for it is aligned again with a wider margin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import durable
from .grouping import by_group
from .hashing import hash_words, release_memory, shingle_hashes, slices, text_buffers

SEED = 8
WINDOW = 20
#: Words of a short seed, and matches of a chain that has no other.
SHORT = 4
LEAST_SHORT = 2
#: Words between the first and the last match of such a chain; what lies closer is a phrase.
SPREAD = 8
#: Occurrences of seeds that a task packs at a time, and of a bucket of seeds.
PACKED = 1 << 18
BUCKET = 1 << 18
#: Occurrences of a seed in one pass from which on they are matched there.
COMMON = 16
#: Numbers of consecutive shared seeds that are matched as one too.
RUNS = (3, 5)
#: Cost of a word skipped in either text: a gap of SEED / GAP_COST words in both together is worth a seed.
GAP_COST = 1 / 16
#: Words, and the share of them that agree, of a passage that counts.
LEAST_WORDS = 50
LEAST_SIMILARITY = 0.8
#: Alignment: a mismatch costs so much, and an end that falls so far below its best is given up.
MISMATCH = 2
DROP = 10
#: Words beyond a chain's ends that its alignment may reach at first, how much wider the next margin is, and words of a
#: stored block.
MARGIN = 96
WIDER = 16
WORDS_BLOCK = 128
BROADCAST_IDS = 2_000_000


def winnow(h: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Indices into h of the least values of each document's windows; all of a shorter document is one window."""
    n = np.diff(bounds)
    out = [np.zeros(0, np.int64)]
    if len(h) >= window:
        for lo in range(0, len(h) - window + 1, 1 << 16):
            part = np.lib.stride_tricks.sliding_window_view(h[lo : lo + (1 << 16) + window - 1], window)
            out.append(part.argmin(axis=1) + np.arange(lo, lo + len(part)))
        at = np.concatenate(out)
        start = np.arange(len(at))
        doc_end = np.repeat(bounds[1:], n)[: len(at)]
        out = [at[start + window <= doc_end]]
    for i in np.flatnonzero((n > 0) & (n < window)):
        out.append(np.array([bounds[i] + int(h[bounds[i] : bounds[i + 1]].argmin())]))
    at = np.unique(np.concatenate(out))
    # a word or a short phrase over and over would else pick every place
    again = (h[at[1:]] == h[at[:-1]]) & (np.diff(at) < window)
    return at[np.concatenate((np.ones(min(1, len(at)), bool), ~again))]


def _seeds(column: pa.Array, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(seed, document, position) arrays of slices of texts; the last bit of a seed tells the widths apart."""
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        words = hash_words(data, offsets[lo : hi + 1])
        for width in (SEED, SHORT):
            h, bounds = shingle_hashes(words, width)
            long_enough = np.repeat(np.diff(words.first) >= width, np.diff(bounds))
            if width == SEED:
                at = winnow(h, bounds)
            else:
                # a word over and over is one seed
                at = np.flatnonzero((h & np.uint64(2) != 0) & np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
            at = at[long_enough[at]]
            doc = np.searchsorted(bounds, at, "right") - 1
            yield h[at] & ~np.uint64(1) | np.uint64(width == SEED), ids[lo:hi][doc], (at - bounds[doc]).astype(np.int32)


_KEPT_BITS = 48
_KEPT_BYTES = _KEPT_BITS // 8


def _planes(values: np.ndarray, least: int = 0) -> bytes:
    """Bytes of little-endian values, all first bytes first; of ``least`` bytes only, if given. Equal high bytes of neighbours compress well."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    return np.ascontiguousarray(raw[:, : least or None].T).tobytes()


def _values(data: bytes, n: int, kind, width: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    out = np.zeros((n, size), np.uint8)
    out[:, : width or size] = np.frombuffer(data, np.uint8).reshape(width or size, n).T
    return out.view(kind).ravel()


def _packed(bits: int):
    """Rows (bucket, n, data): occurrences of the seeds that share their upper ``bits``, packed. Rows of a bucket of
    2 ** bits and above hold matches that were found within a pass."""

    def rows(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        seed, doc, pos = (np.concatenate([h[k] for h in held]) for k in range(3))
        # by document first, so that the first of equal seeds is the least
        order = np.lexsort((pos, doc))
        order = order[np.argsort(seed[order], kind="stable")]
        seed, doc, pos = seed[order], doc[order], pos[order]
        start = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
        size = np.diff(np.append(start, len(seed)))
        first = np.repeat(start, size)
        met = np.repeat(size >= COMMON, size) & (doc != doc[first])
        bucket, n, data = [], [], []
        cut = seed >> np.uint64(64 - bits)
        low = seed & np.uint64((1 << _KEPT_BITS) - 1)
        # occurrences by bucket
        at = np.flatnonzero(~met)
        for part in np.split(at, np.flatnonzero(np.diff(cut[at].astype(np.int64))) + 1):
            bucket.append(int(cut[part[0]])), n.append(len(part))
            data.append(_planes(low[part], _KEPT_BYTES) + _planes(doc[part]) + _planes(pos[part]))
        at = np.flatnonzero(met)
        for lo in range(0, len(at), 1 << 14):
            part = at[lo : lo + (1 << 14)]
            bucket.append((1 << bits) + int(low[part[0]] % np.uint64(1 << bits))), n.append(len(part))
            data.append(_planes(seed[part]) + _planes(doc[part]) + _planes(pos[part]) + _planes(doc[first[part]]) + _planes(pos[first[part]]))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for one in _seeds(batch.column(1), batch.column(0).to_numpy()):
                held.append(one)
                size += len(one[0])
                if size >= PACKED:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)
        release_memory()

    return run


_SHARED = "seed long, doc long, pos int, ref long, ref_pos int"


def _matched(bits: int):
    """(seed, doc, pos, ref, ref_pos) of each occurrence of a bucket's seeds that stand in several documents."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, sizes, data = table.column("bucket")[0].as_py(), table.column("n").to_pylist(), table.column("data")
        kinds = [(np.uint64, _KEPT_BYTES), (np.int64, 8), (np.int32, 4)]
        if bucket >= 1 << bits:
            kinds = [(np.uint64, 8), (np.int64, 8), (np.int32, 4), (np.int64, 8), (np.int32, 4)]
        parts: list[list[np.ndarray]] = [[] for _ in kinds]
        for n, cell in zip(sizes, data, strict=True):
            raw, at = cell.as_buffer(), 0
            for k, (kind, width) in enumerate(kinds):
                parts[k].append(_values(raw[at : at + n * width], n, kind, width))
                at += n * width
        found = [np.concatenate(p) for p in parts]
        if len(kinds) == 3:
            seed, doc, pos = found
            order = np.lexsort((pos, doc))
            order = order[np.argsort(seed[order], kind="stable")]
            seed, doc, pos = seed[order] | np.uint64(bucket << (64 - bits)), doc[order], pos[order]
            start = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
            size = np.diff(np.append(start, len(seed)))
            several = np.repeat(doc[start + size - 1] > doc[start], size)
            first = np.repeat(start, size)[several]
            found = [seed[several], doc[several], pos[several], doc[first], pos[first]]
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), *(pa.array(x) for x in found[1:])], names=[x.split()[0] for x in _SHARED.split(", ")])

    return run


class PrefixMaxima:
    """Fenwick tree over ranks 1..n: the best (value, index) among ranks up to a given one."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, rank: int, value: float, index: int) -> None:
        while rank < len(self.best):
            if value > self.best[rank][0]:
                self.best[rank] = (value, index)
            rank += rank & -rank

    def upto(self, rank: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        while rank:
            if self.best[rank][0] > out[0]:
                out = self.best[rank]
            rank -= rank & -rank
        return out


def chains(pos: np.ndarray, ref: np.ndarray, weight: float = SEED, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Anchors of each chain of strictly rising positions in both texts, best chains first; an anchor is in one."""
    order = np.lexsort((-ref, pos))
    ranks = np.unique(ref, return_inverse=True)[1] + 1
    tree = PrefixMaxima(int(ranks.max()))
    score, before = np.zeros(len(pos)), np.full(len(pos), -1)
    for i in order.tolist():
        far = gap_cost * float(pos[i] + ref[i])
        value, j = tree.upto(int(ranks[i]) - 1)
        gain = value - far
        score[i] = weight
        if gain > 0:
            score[i] += gain
            before[i] = j
        tree.put(int(ranks[i]), score[i] + far, i)
    used, out = np.zeros(len(pos), bool), []
    for i in np.argsort(-score, kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = int(before[i])
        if chain:
            out.append(chain[::-1])
    return out


_CHAIN = "doc long, ref long, nth int, at array<int>, ref_at array<int>"


def _pair_chains(pos: np.ndarray, ref: np.ndarray, wide: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in both texts of the chains of a pair of documents' matches."""
    order = np.lexsort((~wide, pos, ref - pos))
    pos, ref, wide = pos[order], ref[order], wide[order]
    # of consecutive positions on a diagonal every SEED-th and the last stand for the others
    step, turn = np.diff(pos), np.diff(ref - pos) != 0
    again = np.concatenate(([False], (step == 0) & ~turn))
    pos, ref, wide = pos[~again], ref[~again], wide[~again]
    first = np.concatenate(([True], (np.diff(pos) > 1) | (np.diff(ref - pos) != 0)))
    start = np.flatnonzero(first)
    nth = np.arange(len(pos)) - np.repeat(start, np.diff(np.append(start, len(pos))))
    kept = np.flatnonzero((nth % SEED == 0) | np.append(first[1:], True))
    matches, wide = np.diff(np.append(kept, len(pos))), np.logical_or.reduceat(wide, kept)
    pos, ref = pos[kept], ref[kept]
    for c in chains(pos, ref):
        if wide[c].any() or (matches[c].sum() >= LEAST_SHORT and pos[c[-1]] - pos[c[0]] >= SPREAD):
            yield pos[c], ref[c]


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of rows (doc, ref, matches), matches as (pos, ref_pos, wide)."""
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten()
        pos, ref, wide = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        pos, ref, wide = pos.astype(np.int64), ref.astype(np.int64), wide.astype(bool)
        cut = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
        row, nth, at, ref_at = [], [], [], []
        for i in range(len(batch)):
            own = slice(cut[i], cut[i + 1])
            for k, (x, y) in enumerate(_pair_chains(pos[own], ref[own], wide[own])):
                row.append(i), nth.append(k), at.append(x.astype(np.int32)), ref_at.append(y.astype(np.int32))
        of = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(nth, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(ref_at, pa.list_(pa.int32()))], names=["doc", "ref", "nth", "at", "ref_at"])
    release_memory()


def _reach(same: np.ndarray) -> int:
    """Words, from the start of ``same``, up to the best score of an alignment that goes on along it."""
    if not len(same):
        return 0
    total = np.cumsum(np.where(same, 1, -MISMATCH))
    best = np.maximum.accumulate(np.maximum(total, 0))
    low = np.flatnonzero(best - total > DROP)
    total = total[: low[0]] if len(low) else total
    k = int(np.argmax(total)) if len(total) else 0
    return k + 1 if len(total) and total[k] > 0 else 0


def segments(same: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of columns whose score of agreements less mismatches never falls DROP below its best, best ends first cut."""
    out = []
    edges = np.flatnonzero(np.diff(same.astype(np.int8))) + 1
    cuts = [0, *edges.tolist(), len(same)]
    score = best = start = end = 0
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if same[lo]:
            if not score:
                start, best = lo, 0
            score += hi - lo
            if score > best:
                best, end = score, hi
        elif score:
            score -= MISMATCH * (hi - lo)
            if score <= 0 or best - score > DROP:
                out.append((start, end))
                score = 0
    if score:
        out.append((start, end))
    return out


def align(x: np.ndarray, y: np.ndarray, at: np.ndarray, ref_at: np.ndarray, width: int = SHORT) -> list[tuple[int, int, int, int, int]]:
    """(start, end, ref start, ref end, agreeing words) of each passage on the alignment of x and y through seeds of
    ``width`` words at rising positions. Positions count from the starts of x and y; ends are exclusive."""
    px, py, same = [], [], []

    def walk(a: int, b: int, n: int) -> None:
        px.append(np.arange(a, a + n)), py.append(np.arange(b, b + n)), same.append(x[a : a + n] == y[b : b + n])

    a, b = int(at[0]), int(ref_at[0])
    n = min(a, b)
    left = _reach((x[a - n : a] == y[b - n : b])[::-1])
    a, b = a - left, b - left
    for i in range(len(at)):
        da, db = int(at[i]) - a, int(ref_at[i]) - b
        if da == db:
            walk(a, b, da)
        else:
            # another diagonal: change at the place between the two that keeps most agreements
            short, gap = min(da, db), abs(da - db)
            head = np.concatenate(([0], np.cumsum(x[a : a + short] == y[b : b + short])))
            tail = np.concatenate((np.cumsum((x[a + da - short : a + da] == y[b + db - short : b + db])[::-1])[::-1], [0]))
            k = int(np.argmax(head + tail))
            walk(a, b, k)
            skipped = min(gap, DROP)
            px.append(np.full(skipped, a + k)), py.append(np.full(skipped, b + k)), same.append(np.zeros(skipped, bool))
            walk(a + da - short + k, b + db - short + k, short - k)
        a, b = int(at[i]), int(ref_at[i])
    n = min(len(x) - a, len(y) - b)
    walk(a, b, min(width, n) + _reach(x[a + width : a + n] == y[b + width : b + n]))
    xs, ys, eq = np.concatenate(px), np.concatenate(py), np.concatenate(same)
    return [(int(xs[lo]), int(xs[hi - 1]) + 1, int(ys[lo]), int(ys[hi - 1]) + 1, int(eq[lo:hi].sum())) for lo, hi in segments(eq)]


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        ids = batch.column(0).to_pylist()
        for lo, hi in slices(offsets):
            w = hash_words(data, offsets[lo : hi + 1])
            h = (w.hash >> np.uint64(32)).astype(np.uint32)
            doc, block, out = [], [], []
            for i in range(hi - lo):
                own = h[w.first[i] : w.first[i + 1]]
                for k in range(0, len(own), WORDS_BLOCK):
                    doc.append(ids[lo + i]), block.append(k // WORDS_BLOCK), out.append(own[k : k + WORDS_BLOCK].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(block, pa.int32()), pa.array(out, pa.binary())], names=["doc", "block", "words"])


_PASSAGE = "doc long, ref long, start int, end int, ref_start int, ref_end int, agree int, nth int, cut boolean"


def _aligned(margin: int):
    """Passages of one chain's row, with both texts' blocks of words within ``margin``."""

    def run(table: pa.Table) -> Iterator[tuple]:
        table = table.combine_chunks()
        side, block = table.column("side").to_numpy(), table.column("block").to_numpy()
        words = table.column("words").chunk(0)
        cut = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] // 4
        data = np.frombuffer(words.buffers()[2], np.uint32)
        half = int(np.searchsorted(side, 1))
        texts = [data[cut[0] : cut[half]], data[cut[half] : cut[-1]]]
        first, last = [int(block[0]) * WORDS_BLOCK, int(block[half]) * WORDS_BLOCK], [int(block[half - 1]), int(block[-1])]
        at = table.column("at")[0].values.to_numpy() - first[0]
        ref_at = table.column("ref_at")[0].values.to_numpy() - first[1]
        doc, ref, nth = table.column("doc")[0].as_py(), table.column("ref")[0].as_py(), table.column("nth")[0].as_py()
        spans = align(*texts, at, ref_at)
        if not spans:  # seeds of different words with one hash
            return
        # an end at the edge of the words at hand may go on beyond it, unless the text ends there
        low = [k for k in (0, 1) if first[k]]
        asked = [(int(x[-1]) + first[k] + SEED + margin) // WORDS_BLOCK for k, x in enumerate((at, ref_at))]
        high = [k for k in (0, 1) if last[k] == asked[k] and len(texts[k]) % WORDS_BLOCK == 0]
        begins, ends = [min(s[2 * k] for s in spans) for k in (0, 1)], [max(s[2 * k + 1] for s in spans) for k in (0, 1)]
        cut_off = any(begins[k] <= DROP for k in low) or any(ends[k] >= len(texts[k]) - DROP for k in high)
        for a, b, c, d, n in spans:
            yield doc, ref, a + first[0], b + first[0], c + first[1], d + first[1], n, nth, cut_off

    return run


def _runs(shared: DataFrame) -> DataFrame:
    """Matches of RUNS consecutive shared seeds, at the same distances, with the first such run.

    A passage may be made of parts that are common by themselves and so have other first occurrences than the whole.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    whole = []
    for n in RUNS:
        ends = [F.lead(c, n - 1).over(w).alias(c) for c in ("pos",)]
        key = F.xxhash64(F.lit(n), "seed", *[x for k in range(1, n) for x in (F.lead("seed", k).over(w), F.lead("pos", k).over(w) - F.col("pos"))])
        whole.append(F.struct(key.alias("key"), ends[0].alias("last")))
    runs = shared.select("doc", "pos", F.array(*whole).alias("runs")).select("doc", "pos", F.explode("runs").alias("r")).select("doc", "pos", "r.key", "r.last").where("last is not null")
    first = runs.groupBy("key").agg(F.min(F.struct("doc", "pos", "last")).alias("hub"), F.max("doc").alias("top")).where("hub.doc < top")
    met = runs.join(first.select("key", "hub"), "key").where("doc <> hub.doc")
    ends = F.array(F.struct("pos", F.col("hub.pos").alias("ref_pos")), F.struct(F.col("last").alias("pos"), F.col("hub.last").alias("ref_pos")))
    return met.select("doc", F.col("hub.doc").alias("ref"), F.explode(ends).alias("e")).select("doc", "ref", "e.pos", "e.ref_pos")


@durable.leaves_only("passages")
def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """Passages that a document shares with a reference document of a lesser id.

    Returns id_col, start_word, end_word, ref_id, ref_start, ref_end, n_words and similarity (agreeing words by the
    longer side's words), positions in words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, ends exclusive. A passage in
    many documents links each with the first that has its seeds. Passages under ``least_words`` on either side or
    ``least_similarity`` are left out, and so are those inside a longer one with the same reference and
    repeats within one document. Null and empty texts and null ids have
    no passages. Rows that repeat an id are one document, that of the least text. Other columns are not read.
    """
    durable.bounded_batches(docs.sparkSession)
    base = docs.where(docs[id_col].isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    if not base.groupBy("doc").count().where("count > 1").isEmpty():
        base = base.groupBy("doc").agg(F.min("text").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1, size / 10 / BUCKET))))
    packed = base.mapInArrow(_packed(bits), "bucket long, n long, data binary")
    shared = durable.write(by_group(packed, ["bucket"], [], _matched(bits), _SHARED), "shared")
    is_wide = F.col("seed").bitwiseAND(F.lit(1)) == 1
    matches = shared.select("doc", "ref", "pos", "ref_pos", is_wide.alias("wide")).unionAll(_runs(shared.where(is_wide)).withColumn("wide", F.lit(True))).where("doc <> ref")
    # a pair's matches are no more than its words; phrases of a few words go before any of them is looked at
    pairs = matches.groupBy("doc", "ref").agg(F.collect_list(F.struct("pos", "ref_pos", "wide")).alias("m"), F.max("wide").alias("wide"), (F.max("pos") - F.min("pos")).alias("spread"))
    pairs = pairs.where((F.col("spread") >= SPREAD) | F.col("wide")).select("doc", "ref", "m")
    chained = durable.write(pairs.mapInArrow(_chain_rows, _CHAIN), "chains")
    def wanted(chained: DataFrame, margin: int, side: int, doc: str, at: str):
        lo = F.floor((F.greatest(F.element_at(at, 1) - margin, F.lit(0))) / WORDS_BLOCK).cast("int")
        hi = F.floor((F.element_at(at, -1) + SEED + margin) / WORDS_BLOCK).cast("int")
        carried = ("at", "ref_at") if side == 0 else (F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<int>").alias("ref_at"))
        block = F.explode(F.sequence(lo, hi))
        c = chained.select(F.col("doc").alias("own"), "ref", "nth", F.lit(side).alias("side"), F.col(doc).alias("which"), block.alias("block"), *carried, lo.alias("lo"))
        return c.withColumn("at", F.when(F.col("block") == F.col("lo"), F.col("at"))).withColumn("ref_at", F.when(F.col("block") == F.col("lo"), F.col("ref_at"))).drop("lo")

    def aligned(chained: DataFrame, margin: int) -> DataFrame:
        ids = chained.select(F.explode(F.array("doc", "ref")).alias("doc")).distinct()
        few = ids.count() <= BROADCAST_IDS
        words = base.join(F.broadcast(ids) if few else ids, "doc").mapInArrow(_word_blocks, "doc long, block int, words binary")
        asked = wanted(chained, margin, 0, "doc", "at").unionAll(wanted(chained, margin, 1, "ref", "ref_at"))
        asked = asked.join(words.select(F.col("doc").alias("which"), "block", "words"), ["which", "block"]).select(F.col("own").alias("doc"), "ref", "nth", "side", "block", "at", "ref_at", "words")
        return durable.write(by_group(asked, ["doc", "ref", "nth"], ["side", "block"], _aligned(margin), _PASSAGE, heavy=margin == MARGIN), "aligned")

    margin = MARGIN
    some = aligned(chained, margin)
    found = some.where("not cut")
    while not some.where("cut").isEmpty():
        margin *= WIDER
        chained = chained.join(some.where("cut").select("doc", "ref", "nth").distinct(), ["doc", "ref", "nth"], "left_semi")
        some = aligned(chained, margin)
        found = found.unionAll(some.where("not cut"))
    n = F.greatest(F.col("end") - F.col("start"), F.col("ref_end") - F.col("ref_start"))
    out = found.withColumn("n_words", F.least(F.col("end") - F.col("start"), F.col("ref_end") - F.col("ref_start"))).withColumn("similarity", F.col("agree") / n)
    out = out.where((F.col("n_words") >= least_words) & (F.col("similarity") >= least_similarity))
    # shifted copies within a document give passages inside longer ones
    seen = Window.partitionBy("doc", "ref").orderBy("start", F.desc("end"), F.desc("similarity"), "ref_start").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("covered", F.max("end").over(seen)).where("covered is null or covered < end")
    return out.select(F.col("doc").alias(id_col), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("ref").alias("ref_id"), "ref_start", "ref_end", "n_words", "similarity")
