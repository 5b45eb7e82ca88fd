"""Queries over feature vectors and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions.vec import l1, l2
from scanfold.operators import learn, tracks

from .registry import query, rounded
from .views import POINTS, points, table

VECTORS = "vectors AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)"
LONG = f"{VECTORS}, long_f AS (SELECT id, label, CAST(unnest(range(len(f))) AS INTEGER) AS dim, unnest(f) AS value FROM vectors)"
DIMS = 64  # of the driver's vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("f"))


@query(f"WITH {LONG} SELECT dim, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM long_f GROUP BY dim")
def feature_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.mean_std(_vectors(spark, sf_dir)), "mean", "std")


FIT = f"""{LONG}, k AS (SELECT dim, value, row_number() OVER (PARTITION BY dim ORDER BY value, id) - 1 AS k, count(*) OVER (PARTITION BY dim) AS n FROM long_f),
  fit AS (SELECT dim, min(value) AS lo, max(value) AS hi FROM k WHERE k >= floor(n * 0.05) AND k < n - floor(n * 0.05) GROUP BY dim)"""


@query(f"WITH {FIT} SELECT dim, lo, hi FROM fit")
def minmax_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.minmax_fit(_vectors(spark, sf_dir), 0.05)


@query(f"WITH {FIT} SELECT id, dim, round(least(greatest((value - lo) / (hi - lo), 0.0), 1.0), 6) AS value FROM long_f JOIN fit USING (dim)")
def minmax_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return rounded(learn.minmax_apply(v, learn.minmax_fit(v, 0.05)), "value")


@query(f"""WITH {VECTORS} SELECT a.id, round(list_sum(list_transform(list_zip(a.f, b.f), lambda p: abs(p[1] - p[2]))), 6) AS l1, round(sqrt(list_sum(list_transform(list_zip(a.f, b.f), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS l2
  FROM vectors a JOIN vectors b ON b.id = a.id + 1""")
def l1_l2_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    m = v.select((F.col("id") + 1).alias("next"), F.col("f").alias("g")).join(v.withColumnRenamed("id", "next"), "next")
    return rounded(m.select((F.col("next") - 1).alias("id"), l1(F.col("f"), F.col("g")).alias("l1"), l2(F.col("f"), F.col("g")).alias("l2")), "l1", "l2")


PLANES = {(a, b): ([((i * (a + 2) + b) % 5 - 2) / 2 for i in range(DIMS)], c) for a, b, c in ((1, 2, 0.01), (1, 3, -0.02), (2, 3, 0.0))}


def _score(w: list[float], b: float) -> str:
    return " + ".join(f"f[{i + 1}] * {x}" for i, x in enumerate(w)) + f" + {b}"


@query(f"""WITH {VECTORS}, s AS (SELECT id, {", ".join(f"({_score(*p)}) > 0 AS p{a}{b}" for (a, b), p in PLANES.items())} FROM vectors),
  v AS (SELECT id, p12::INTEGER + p13::INTEGER AS v1, (NOT p12)::INTEGER + p23::INTEGER AS v2, (NOT p13)::INTEGER + (NOT p23)::INTEGER AS v3 FROM s)
  SELECT id, CAST(CASE greatest(v1, v2, v3) WHEN v1 THEN 1 WHEN v2 THEN 2 ELSE 3 END AS INTEGER) AS label, greatest(v1, v2, v3) AS votes FROM v""")
def linear_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.one_vs_one(_vectors(spark, sf_dir), PLANES)


@query(f"WITH {VECTORS} SELECT id, round({_score(*PLANES[1, 2])}, 6) AS score, ({_score(*PLANES[1, 2])}) > 0.1 AS accepted FROM vectors")
def binary_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = learn.linear_scores(F.col("f"), [PLANES[1, 2]])[0]
    return rounded(_vectors(spark, sf_dir).select("id", s.alias("score"), (s > 0.1).alias("accepted")), "score")


@query("""WITH h AS (SELECT vec_id % 7 AS g, label, count(*) AS n FROM embeddings GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, label) AS k FROM h WHERE label <> 0)
  SELECT g, CAST(t.total AS BIGINT) AS total, max(label) FILTER (k = 1) AS mode, max(n) FILTER (k = 1) - coalesce(max(n) FILTER (k = 2), 0) AS lead FROM r JOIN (SELECT g, sum(n) AS total FROM h GROUP BY g) t USING (g) GROUP BY g, t.total""")
def label_histogram_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.label_top2(table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("g"), "label"), ["g"])


@query("SELECT label, n, max(n) OVER () / n AS weight FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.class_weights(table(spark, sf_dir, "embeddings"))


@query("SELECT label, id, CAST(k AS INTEGER) AS k, floor(k * 0.25) <> floor((k - 1) * 0.25) AS taken FROM (SELECT label, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings)")
def systematic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.systematic(table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id")), 0.25, "id", "label").select("label", "id", "k", "taken")


@query("SELECT count(*) AS n, avg(CASE WHEN label <> vec_id % 10 THEN 1.0 ELSE 0.0 END) AS error FROM embeddings")
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.error_rate(table(spark, sf_dir, "embeddings").withColumn("guess", F.col("vec_id") % 10), "guess", "label")


MOVES = f"{POINTS}, m AS (SELECT nx * x / sqrt(x * x + y * y + z * z) + ny * y / sqrt(x * x + y * y + z * z) + nz * z / sqrt(x * x + y * y + z * z) AS c, sqrt(x * x + y * y + z * z) AS len FROM points)"


@query(f"WITH {MOVES} SELECT CAST(floor(abs(c) * 9) AS INTEGER) AS bin, count(*) AS n, round(avg(len), 6) AS move FROM m GROUP BY 1")
def move_normal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    cos = sum(F.col("n" + c) * F.col(c) / size for c in "xyz")
    return rounded(learn.move_histogram(p.select(cos.alias("cos"), size.alias("len")), 10), "move")


@query("SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("label is not null").groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {VECTORS} SELECT id, f[3] AS value FROM vectors WHERE f[3] > 0")
def extract_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("id", F.element_at("f", 3).alias("value")).where("value > 0")


@query(f"WITH {POINTS} SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM points WHERE x BETWEEN -10 AND 10")
def box_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = [f(c).alias(c + n) for c in "xyz" for f, n in ((F.min, "0"), (F.max, "1"))]
    return points(spark, sf_dir).where(F.col("x").between(-10, 10)).agg(F.count("*").alias("n"), *b)
