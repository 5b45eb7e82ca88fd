"""A sparse rule ensemble for document quality.

Statistics of each whole text are taken in numpy passes over Arrow buffers. Boosted trees are fitted on a bounded
sample of labelled rows, the paths to their nodes become conjunctive rules, a lasso logistic regression gives most
rules weight zero, and the rest is compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import durable
from .hashing import _LANE, hash_words, mix64, release_memory, slices, text_buffers
from .sampling import hash_share
from .trees import fit_boosted, sigmoid

STATISTICS = ("words", "word_length", "upper", "digit", "pipe", "symbol", "bang", "stop", "comma", "high", "lines", "distinct", "repeated_pairs", "marked", "short", "long", "longest_line")
#: Labelled rows that the fit reads at most.
SAMPLE_ROWS = 20_000

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "pipe": b"|", "symbol": b"#$%&*@^~<>{}[]=+_\\", "bang": b"!?", "stop": b".", "comma": b",;:"}
_MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()} | {"high": np.arange(256) >= 128}
_ALNUM = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,")) | (np.arange(256) >= 128)


def _by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of documents ``data[offsets[i]:offsets[i + 1]]``, a row each; all zero for a text without words."""
    w = hash_words(data, offsets)
    size = np.diff(w.doc_byte)
    n = np.diff(w.first)
    out = np.zeros((len(size), len(STATISTICS)))
    if not len(w.start):
        return out
    per, share = np.maximum(n, 1), np.maximum(size, 1)
    length = w.end - w.start
    cols = {"words": np.log1p(n), "word_length": _by_doc(length, w.first) / per}
    for k, mask in _MASKS.items():
        cols[k] = _by_doc(mask[w.data], w.doc_byte) / share
    line = w.data == 10
    cols["lines"] = _by_doc(line, w.doc_byte) / per
    ends = w.data[w.end - 1]
    cols["marked"] = _by_doc(~_ALNUM[ends], w.first) / per
    cols["short"] = _by_doc(length <= 2, w.first) / per
    cols["long"] = _by_doc(length >= 10, w.first) / per
    doc = np.repeat(np.arange(len(n)), n)
    # distinct words and word pairs: hashes of a document differ from those of others by its number
    own = mix64(doc.astype(np.uint64) + np.uint64(1))
    for name, h in (("distinct", w.hash ^ own), ("repeated_pairs", mix64(w.hash[:-1] * _LANE[0] + w.hash[1:] * _LANE[1]) ^ own[1:])):
        whose = doc if name == "distinct" else np.where(doc[1:] == doc[:-1], doc[1:], -1)
        h, whose = h[whose >= 0], whose[whose >= 0]
        order = np.argsort(h)
        first = np.ones(len(h), bool)
        first[1:] = h[order][1:] != h[order][:-1]
        kinds = np.bincount(whose[order][first], minlength=len(n))
        cols[name] = kinds / per if name == "distinct" else 1 - kinds / np.maximum(n - 1, 1)
    # words between line breaks
    breaks = np.flatnonzero(line)
    at = np.searchsorted(w.start, breaks)
    cuts = np.unique(np.concatenate((w.first, at)))
    longest = np.zeros(len(n))
    np.maximum.at(longest, np.searchsorted(w.first, cuts[:-1], "right") - 1, np.diff(cuts))
    cols["longest_line"] = np.log1p(longest)
    for j, k in enumerate(STATISTICS):
        out[:, j] = np.where(n > 0, cols[k], 0)
    return out


def with_statistics(rows: DataFrame, text_col: str, prefix: str = "stat_") -> DataFrame:
    """``rows`` with one double column ``prefix + name`` for each statistic of ``text_col``."""
    names = rows.columns
    at = names.index(text_col)
    added = [prefix + s for s in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            for lo, hi in slices(offsets):
                s = statistics(data, offsets[lo : hi + 1])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(s[:, j]) for j in range(s.shape[1]))], names=[*names, *added])
        release_memory()

    durable.bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(a, T.DoubleType()) for a in added)]))


@dataclass
class RuleModel:
    """Weighted conjunctions over statistics: intercept and (conditions, weight) with conditions (statistic, at most, threshold)."""

    intercept: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]]

    def column(self, prefix: str = "stat_") -> Column:
        """The score, 0 to 1, as an expression over the statistics' columns."""
        z = F.lit(self.intercept)
        for conditions, weight in self.rules:
            fits = F.lit(True)
            for f, at_most, t in conditions:
                c = F.col(prefix + STATISTICS[f])
                fits = fits & ((c <= t) if at_most else (c > t))
            z = z + F.when(fits, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for conditions, weight in self.rules:
            z += weight * _fits(x, conditions)
        return sigmoid(z)


def _fits(x: np.ndarray, conditions: tuple) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, at_most, t in conditions:
        ok &= (x[:, f] <= t) if at_most else (x[:, f] > t)
    return ok


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, rounds: int = 400, trees: int = 30, depth: int = 3) -> RuleModel:
    """Rules from the tree paths of a boosted fit with lasso logistic weights by accelerated proximal gradient.

    With one class only, or no rows, the model is its prior (a half for no rows).
    """
    if not len(y):
        return RuleModel(0.0, [])
    boosted = fit_boosted(x, y, trees=trees, depth=depth)
    paths = sorted({p for t in boosted.trees for p in t.paths()})
    columns, kept = {}, []
    for p in paths:
        v = _fits(x, p)
        key = v.tobytes()
        if 0.002 < v.mean() < 0.998 and key not in columns:
            columns[key] = v
            kept.append(p)
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    b = float(np.log(prior / (1 - prior)))
    if not kept:
        return RuleModel(b, [])
    r = np.stack(list(columns.values()), axis=1).astype(np.float64)
    mean, scale = r.mean(0), r.std(0)
    r = (r - mean) / scale
    step = 4.0 * len(y) / (np.linalg.norm(r.T @ r, 2) + len(y))
    beta = prev = np.zeros(r.shape[1])
    t = 1.0
    for _ in range(rounds):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = beta + (t - 1) / t2 * (beta - prev)
        err = sigmoid(b + r @ look) - y
        prev, t = beta, t2
        moved = look - step * (r.T @ err) / len(y)
        beta = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        b -= step * err.mean()
    live = np.flatnonzero(beta)
    return RuleModel(float(b - (beta / scale * mean).sum()), [(kept[i], float(beta[i] / scale[i])) for i in live])


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """A model from at most ``sample_rows`` labelled ids that are not held out, those of the least hashes.

    An id with several labels has the greatest, one on several rows of ``docs`` the row of the least statistics, so the
    rows that reach the driver are bounded too. Null ids, labels and ids without a document are left out.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    sample = hash_share(known, F.col("id"), 2 * sample_rows).orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    # the sample is bounded by sample_rows, so its broadcast is too
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    stats = ["stat_" + s for s in STATISTICS]
    rows = with_statistics(texts, "text").groupBy("id", "label").agg(F.min(F.struct(*stats)).alias("stats"))
    got = rows.select("id", "label", "stats.*").orderBy("id").toPandas()
    x = got[stats].to_numpy(np.float64).reshape(len(got), len(STATISTICS))
    return fit_rules(x, (got["label"].to_numpy(np.float64) > 0.5).astype(np.float64))


def score_documents(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of every row; null and empty texts have statistics of zero and so one score.

    Null and repeated ids are ordinary rows; other columns are not read.
    """
    rows = with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text")
    return rows.select(F.col("id").alias(id_col), model.column().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, that the model does not reject."""
    prefix = "stat_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return with_statistics(docs, text_col, prefix).where(model.column(prefix) >= 0.5).select(*[f"`{c}`" for c in docs.columns])
