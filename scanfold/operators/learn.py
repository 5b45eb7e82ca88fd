"""Feature vectors: normalisation, linear decisions, histograms of labels and principal axes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanfold.functions.vec import dot, doubles
from scanfold.stored import stored


def long_form(vectors: DataFrame) -> DataFrame:
    """(id, dim from 0, value) of each component."""
    return vectors.select("id", F.posexplode(doubles(F.col("f"))).alias("dim", "value"))


def mean_std(vectors: DataFrame) -> DataFrame:
    """Mean and sample deviation of each dimension; null components don't count."""
    return long_form(vectors).groupBy("dim").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


SKETCH = 10_000  # rank error of the sketch that brackets a selection: one part of this
STEPS = 200  # quantiles taken from the sketch; their distance is well above its error
MOST_BRACKETS = 10_000  # brackets that may be broadcast; beyond that their join shuffles


def ranked(rows: DataFrame, by: list[str], value: str, shares: dict[str, Column]) -> DataFrame:
    """(by, name, n, value): the exact value at a rank of each group, without sorting the group.

    ``shares`` gives for each name a share of 0 to 1 of a group's n non-null values; the rank, from 0, is the floor of n
    times the share, held to n - 1. A quantile sketch brackets each rank, the values below the bracket are
    counted, and only distinct values within it, three parts in ``STEPS`` of the group, are put in order. The
    brackets, a row a group and name, are stored and counted; they are broadcast up to ``MOST_BRACKETS``. ``by`` names at
    least one column; empty groups give no row.
    """
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), s.cast("double").alias("share")) for k, s in shares.items()]))
    sketch = F.percentile_approx("v", [i / STEPS for i in range(STEPS + 1)], SKETCH)
    q = v.groupBy(*by).agg(F.count("*").alias("n"), sketch.alias("q")).select(*by, "n", "q", at.alias("at")).select(*by, "n", "q", "at.name", "at.share")
    step = F.floor(F.col("share") * STEPS).cast("int")
    edge = [F.element_at("q", F.greatest(F.least(step + i, F.lit(STEPS)), F.lit(0)) + 1) for i in (-1, 2)]
    q = q.select(*by, "name", "n", F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1).alias("k"), edge[0].alias("from"), edge[1].alias("to"))
    q = stored(q)
    j = v.join(F.broadcast(q) if q.count() <= MOST_BRACKETS else q, by)
    inside = F.col("v") >= F.col("from")
    # one row for all values below a bracket, one for each distinct value within
    c = j.where(F.col("v") <= F.col("to")).groupBy(*by, "name", "k", "n", F.when(inside, F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by, "name").orderBy(F.asc_nulls_first("v"))
    return c.withColumn("upto", F.sum("c").over(w)).where("v is not null and upto > k").groupBy(*by, "name", "n").agg(F.min("v").alias(value))


def minmax_fit(vectors: DataFrame, trim: float = 0.0) -> DataFrame:
    """(dim, lo, hi) of each dimension after leaving out the share ``trim`` at either end; (0, 1) if it is constant."""
    n = F.col("n")
    cut = F.floor(n * F.lit(trim))
    # half a rank more keeps the floor of n times the share on the rank itself
    r = ranked(long_form(vectors), ["dim"], "value", {"lo": (cut + 0.5) / n, "hi": (n - cut - 0.5) / n})
    r = r.groupBy("dim").agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in ("lo", "hi")])
    same = F.col("lo") == F.col("hi")
    return r.select("dim", F.when(same, 0.0).otherwise(F.col("lo")).alias("lo"), F.when(same, 1.0).otherwise(F.col("hi")).alias("hi"))


def minmax_apply(vectors: DataFrame, fit: DataFrame, clip: bool = True) -> DataFrame:
    """(id, dim, value) scaled to 0..1; ``fit`` has a row for each dimension and is joined by it."""
    x = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) if clip else x
    return long_form(vectors).join(fit, "dim").select("id", "dim", x.alias("value"))


def linear_scores(f: Column, planes: list[tuple[list[float], float]]) -> list[Column]:
    """Decision values w . f + b."""
    return [dot(f, F.array(*map(F.lit, w))) + F.lit(b) for w, b in planes]


def one_vs_one(vectors: DataFrame, planes: dict[tuple[int, int], tuple[list[float], float]]) -> DataFrame:
    """(id, label, votes): each plane votes for its first class if its value is positive, else for its second; ties go
    to the lesser class."""
    classes = sorted({c for pair in planes for c in pair})
    scores = dict(zip(planes, linear_scores(F.col("f"), list(planes.values())), strict=True))
    votes = {c: sum((F.when(s > 0, int(p[0] == c)).otherwise(int(p[1] == c)) for p, s in scores.items() if c in p), F.lit(0)) for c in classes}
    best = F.greatest(*votes.values()) if len(votes) > 1 else next(iter(votes.values()))
    label = F.coalesce(*[F.when(v == best, F.lit(c)) for c, v in votes.items()])
    return vectors.select("id", label.alias("label"), best.alias("votes"))


def label_top2(rows: DataFrame, by: list[str], label: str = "label", weight: str | None = None) -> DataFrame:
    """For each group: total, the most frequent real label (not 0 or null; ties to the lesser) and its lead."""
    n = F.sum(weight) if weight else F.count("*")
    h = rows.groupBy(*by, label).agg(n.alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), label)
    real = h.where((F.col(label) != 0) & F.col(label).isNotNull()).withColumn("k", F.row_number().over(w)).where("k <= 2")
    top = real.groupBy(*by).agg(F.max(F.when(F.col("k") == 1, F.col(label))).alias("mode"), F.max(F.when(F.col("k") == 1, F.col("n"))).alias("first"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("n"))), F.lit(0)).alias("second"))
    return h.groupBy(*by).agg(F.sum("n").alias("total")).join(top, by, "left").select(*by, "total", "mode", (F.col("first") - F.col("second")).alias("lead"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Weight of each class: the largest count by its own."""
    c = rows.groupBy(label).agg(F.count("*").alias("n"))
    return c.withColumn("weight", F.max("n").over(Window.partitionBy(F.lit(0))) / F.col("n"))


def error_rate(rows: DataFrame, predicted: str, true: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg((F.col(predicted) != F.col(true)).cast("double")).alias("error"))


def pca(points: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, eigenvalues descending, axes as rows) from one pass of moment sums; only those reach the driver."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = points.agg(*[F.avg(c).alias("m" + c) for c in cols], *[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    cov = np.zeros((len(cols), len(cols)))
    for a, b in pairs:
        i, j = cols.index(a), cols.index(b)
        cov[i, j] = cov[j, i] = row[f"{a}|{b}"]
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    return np.array([row["m" + c] for c in cols]), values[order], vectors[:, order].T


def move_histogram(rows: DataFrame, bins: int) -> DataFrame:
    """(bin, n, move) of |cos| between move and normal over ``bins`` - 1 equal steps, and the mean move length."""
    return rows.groupBy(F.floor(F.abs("cos") * (bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("len").alias("move"))
