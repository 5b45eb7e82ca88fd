"""Views that feed the scan operators from the driver's tables, for Spark and, as SQL, for the oracle.

``points``  id, x, y, z, nx, ny, nz (unit normal), conf, label      from embeddings
``scan``    frame, col, dist (null where there is no return)        from events, a row of pixels for each user
``pixels``  frame, row, col, dist                                   from lineitem, a small image for each part
``poses``   uid, step, ts_us, x, y, yaw                             from events, a walk for each user
``hits``    src, dst, day                                           from events, user and event type
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfold.runs import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding").getItem(i).cast("double") for i in range(7)]
    n = F.sqrt(e[3] * e[3] + e[4] * e[4] + e[5] * e[5])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[(e[i] * 50).alias(c) for i, c in enumerate("xyz")], *[(e[i + 3] / n).alias("n" + c) for i, c in enumerate("xyz")], F.least(F.lit(1.0), F.abs(e[6]) * 4).alias("conf"), "label")


POINTS = """points AS (SELECT vec_id AS id, e[1] * 50 AS x, e[2] * 50 AS y, e[3] * 50 AS z, e[4] / n AS nx, e[5] / n AS ny, e[6] / n AS nz,
  least(1.0, abs(e[7]) * 4) AS conf, label FROM (SELECT *, sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6]) AS n
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)))"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("frame"), F.row_number().over(w).alias("col"), F.when(F.col("value") <= 400, F.col("value") / 10).alias("dist"))


SCAN = """scan AS (SELECT user_id AS frame, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS col,
  CASE WHEN value <= 400 THEN value / 10 END AS dist FROM events)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by frame once: the grouping and all windows within a frame, by row or by column, then need no other shuffle
    li = dealt(table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey", "l_quantity"), "l_partkey")
    one = li.groupBy("l_partkey", "l_linenumber", "l_orderkey").agg(F.min("l_quantity").alias("q"))
    w = Window.partitionBy("l_partkey", "l_linenumber").orderBy("l_orderkey")
    return one.select(F.col("l_partkey").alias("frame"), F.col("l_linenumber").alias("row"), F.row_number().over(w).alias("col"), F.when(F.col("q") < 45, F.col("q") / 4).alias("dist"))


PIXELS = """pixels AS (SELECT l_partkey AS frame, l_linenumber AS row, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey) AS col,
  CASE WHEN q < 45 THEN q / 4 END AS dist FROM (SELECT l_partkey, l_linenumber, l_orderkey, min(l_quantity) AS q FROM lineitem GROUP BY ALL))"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("uid"), F.row_number().over(w).alias("step"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "value")
    return e.select("uid", "step", "ts_us", (F.col("value") / 100).alias("x"), (F.pmod("ts_us", F.lit(1000)) / 250).alias("y"), (F.col("value") / 200 - 1).alias("yaw"))


POSES = """poses AS (SELECT uid, step, ts_us, value / 100 AS x, CAST(ts_us % 1000 AS DOUBLE) / 250 AS y, value / 200 - 1 AS yaw
  FROM (SELECT user_id AS uid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, epoch_us(ts) AS ts_us, value FROM events))"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), F.dayofmonth("ts").alias("day"))


HITS = "hits AS (SELECT user_id AS src, event_type AS dst, CAST(day(ts) AS INTEGER) AS day FROM events)"
