"""Queries on tracks' beginnings, ages, points and lives, and on links, labels and files of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfold.operators import lifecycle, links, noise, segments, surface
from scanfold.operators.merging import IGNORE, KEEP, MERGE
from scanfold.runs import dealt
from scanfold.sources import clouds, rangeimg, textual
from scanfold.stored import stored
from scanfold.streaming import lifecycle as lives

from .registry import query, rounded
from .scan_queries import SEGMENTS
from .views import HITS, PIXELS, POINTS, POSES, hits, pixels, points, poses, table

STEPS = 3


def _policy(uid: int, track: lives.Track) -> tuple[int, int | None]:
    return (KEEP, None) if uid % 4 == 0 else (MERGE, 1) if uid % 4 == 1 else (IGNORE, None)


@query(f"""WITH e AS (SELECT user_id AS drive, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, count(*) OVER (PARTITION BY user_id) AS n, 5 + event_id % 7 AS points FROM events),
  d AS (SELECT *, CASE WHEN frame = 1 OR frame % 4 = 0 THEN 'kept' WHEN frame % 4 = 1 THEN 'merged' ELSE 'ignored' END AS event FROM e WHERE frame + {STEPS} <= n)
  SELECT drive, frame, frame AS uid, 'new' AS event, CAST(0 AS INTEGER) AS buffer, CAST(0 AS INTEGER) AS age, points FROM e
  UNION ALL SELECT drive, frame + {STEPS}, frame, event, CAST({STEPS - 1} + CAST(event = 'kept' AS INTEGER) AS INTEGER), CAST({STEPS} AS INTEGER), points FROM d""")
def track_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One new track a frame in each user's drive, decided on by uid three frames later."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    none = {c: F.lit(None).cast("long") for c in ("uid", "dst")}
    events = dealt(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id")
    e = events.select(F.col("user_id").cast("long").alias("drive"), F.row_number().over(w).cast("long").alias("frame"), F.lit(lives.SEGMENT).alias("kind"), none["uid"].alias("uid"), F.lit(0.0).alias("angle"), (5 + F.col("event_id") % 7).cast("long").alias("points"), F.lit(None).cast("int").alias("decision"), none["dst"].alias("dst"))
    return lives.life_of_drives(e, lives.Rules(steps=STEPS, idle_most=1 << 30, policy=_policy))


@query(f"""WITH {POINTS} SELECT CAST(label AS BIGINT) AS segment, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, -1.5 AS vx, CAST(100.0 AS DOUBLE) AS pvx FROM points GROUP BY label""")
def track_new_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of tracks that begin at the means of labels, seen from a car at 1.5 m/s."""
    s = lifecycle.new_states(points(spark, sf_dir).withColumn("segment", F.col("label").cast("long")), (1.5, 0.0, 0.0))
    x = F.col("x").getItem
    return rounded(s.select("segment", x(3).alias("x"), x(4).alias("y"), x(5).alias("z"), x(9).alias("vx"), F.col("p").getItem(9 * 12 + 9).alias("pvx")), "x", "y", "z")


@query(f"""WITH {POSES}, t AS (SELECT uid, CAST(max(step) AS INTEGER) AS age, max(step) FILTER (x < 6) AS last_update, count(*) FILTER (x < 3) AS points FROM poses GROUP BY uid)
  SELECT uid, age + 1 AS age, last_update, points FROM t WHERE 110 - last_update < 30 AND points >= 3""")
def tracks_aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = poses(spark, sf_dir)
    t = p.groupBy("uid").agg(F.max("step").cast("int").alias("age"), F.max(F.when(F.col("x") < 6, F.col("step"))).cast("long").alias("last_update"))
    counts = p.where("x < 3").groupBy("uid").agg(F.count("*").alias("points"))
    return lifecycle.age_tracks(t, counts, 110).select("uid", "age", "last_update", "points")


_IN = ", ".join(f"CAST(trunc({c} / 4.0) AS INTEGER) - CAST({c} < 0 AS INTEGER) AS i{c}" for c in "xyz")


@query(f"""WITH {POINTS}, c AS (SELECT *, {_IN} FROM points), a AS (SELECT * FROM c WHERE id % 2 = 0), b AS (SELECT * FROM c WHERE id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY ix, iy, iz ORDER BY id) = 1)
  SELECT id, ix, iy, iz FROM a UNION ALL SELECT id, ix, iy, iz FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.ix = b.ix AND a.iy = b.iy AND a.iz = b.iz)""")
def track_points_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return lifecycle.merge_points(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 4.0).select("id", "ix", "iy", "iz")


@query(f"""WITH {POINTS}, {{r}} SELECT id, {", ".join(f"round({'' if a == b else '0 + '}{a} * {b} / r2 * (0.000225 - r2 * 2.25e-6){' + r2 * 2.25e-6' if a == b else ''}, 9) + 0 AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM r""".replace("{r}", "r AS (SELECT *, x * x + y * y + z * z AS r2 FROM points)"))
def point_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of points by deviations of 15 mm along and 1.5 mrad across their rays."""
    c = noise.point_covariance(*[F.col(k) for k in "xyz"], 0.015, 0.0015)
    at = {"xx": 0, "xy": 1, "xz": 2, "yy": 4, "yz": 5, "zz": 8}
    return points(spark, sf_dir).withColumn("c", c).select("id", *[(F.round(F.col("c").getItem(i), 9) + 0).alias("c" + k) for k, i in at.items()])


@query(f"""WITH {PIXELS}, p AS (SELECT frame, row, col, dist FROM pixels WHERE dist IS NOT NULL), q AS (SELECT a.frame, a.row, a.col, a.dist, b.dist AS there, c.dist AS before FROM p a LEFT JOIN p b ON b.frame = a.frame + 1 AND b.row = a.row AND b.col = a.col LEFT JOIN p c ON c.frame = a.frame - 1 AND c.row = a.row AND c.col = a.col)
  SELECT frame, row, col, coalesce(dist <= there + 0.5, true) AS seen_next, coalesce(dist <= before + 0.5, true) AS seen_before FROM q""")
def pixels_seen_in_other_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each return is visible in the frame after and the frame before, from where it stands."""
    p = pixels(spark, sf_dir).where("dist is not null").select("frame", "row", "col", "dist")
    key = ["frame", "row", "col"]

    def seen(step: int, name: str) -> DataFrame:
        there = p.withColumnRenamed("frame", "other")
        s = surface.seen_in(p.select("frame", (F.col("frame") + step).alias("other"), F.col("row").alias("py"), F.col("col").alias("px"), "dist"), there, 0.5)
        return s.select("frame", F.col("py").alias("row"), F.col("px").alias("col"), F.col("seen").alias(name))

    return seen(1, "seen_next").join(seen(-1, "seen_before"), key)


@query(f"""WITH {PIXELS}, s AS (SELECT frame, row, col, dist, lead(dist) OVER w AS d2 FROM pixels WINDOW w AS (PARTITION BY frame, row ORDER BY col))
  SELECT frame, row, col, round(0.4 * CASE WHEN col % 3 = 0 THEN 0.8 ELSE 1.0 + 0.2 * least(greatest((abs(dist - d2) - 0.5) / 4.5, 0.0), 1.0) END, 6) AS threshold FROM s WHERE dist IS NOT NULL AND d2 IS NOT NULL""")
def edge_thresholds_of_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of edges that tracks move, within tracks and between tracks of different speeds."""
    w = Window.partitionBy("frame", "row").orderBy("col")
    p = pixels(spark, sf_dir).withColumn("d2", F.lead("dist").over(w)).where("dist is not null and d2 is not null")
    t = surface.track_threshold(F.col("col") % 3 == 0, F.lit(0.4), F.abs(F.col("dist") - F.col("d2")), 0.5, 5.0)
    return rounded(p.select("frame", "row", "col", t.alias("threshold")), "threshold")


@query(f"""{SEGMENTS}, f AS (SELECT frame, segment, min(k) AS first FROM lab GROUP BY ALL), n AS (SELECT frame, segment, row_number() OVER (PARTITION BY frame ORDER BY first) AS nr FROM f)
  SELECT frame, CAST(k // 100000 AS INTEGER) AS row, k % 100000 AS col, CAST(nr AS INTEGER) AS nr FROM lab JOIN n USING (frame, segment)""")
def segments_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments numbered by their first pixels, as label images hold them."""
    return rangeimg.dense_segments(stored(segments.segment_frames(pixels(spark, sf_dir), 2.0))).select("frame", "row", "col", "nr")


@query(f"WITH {HITS}, l AS (SELECT src, dst, count(*) AS strength FROM hits GROUP BY ALL) SELECT dst, strength FROM l WHERE src = (SELECT min(src) FROM hits)")
def links_of_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first node is linked with."""
    h = hits(spark, sf_dir)
    return links.neighbours_of(links.count_links(h), F.lit(h.agg(F.min("src")).first()[0]))


@query("SELECT o_orderkey AS nr, o_totalprice AS image, l.l_quantity AS line FROM orders LEFT JOIN (SELECT l_orderkey - 8 AS nr, l_quantity FROM lineitem WHERE l_linenumber = 1) l ON l.nr = o_orderkey")
def frames_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and the line eight places on, where there is one."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("nr"), F.col("l_quantity").alias("line"))
    return clouds.positional(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("nr"), F.col("o_totalprice").alias("image")), lines, 8)


@query(f"""WITH {POINTS} SELECT concat_ws(chr(9), CAST(label AS VARCHAR) || '.0', CAST(id AS VARCHAR) || '.0', '-->', CAST(label AS VARCHAR)) AS value FROM points""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a training file."""
    p = points(spark, sf_dir)
    return textual.training_lines(p.select(F.array(F.col("label").cast("double"), F.col("id").cast("double")).alias("f"), "label"))
