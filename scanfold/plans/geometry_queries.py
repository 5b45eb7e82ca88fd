"""Queries on matrices, poses, correspondences, edges and audits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfold.functions import geo, mat
from scanfold.functions.vec import norm3
from scanfold.operators import audit, icp, knn, segments, tracks
from scanfold.stored import stored

from .grid_queries import D2, FIRST, MOVE, PIX, _moved_to_points, _pixels
from .registry import query, rounded
from .scan_queries import SEGMENTS
from .views import PIXELS, POINTS, POSES, SCAN, pixels, points, poses, scan, table

NINE = [(a, b) for a in "xyz" for b in "xyz"]
COV = "cov AS (SELECT label, " + ", ".join(f"covar_samp({a}, {b}) AS {a}{b}" for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))) + " FROM points GROUP BY label HAVING count(*) > 3)"


def _covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.array(*[F.covar_samp(a, b) for a, b in NINE]).alias("m"))
    return c.where("n > 3").drop("n")


@query(f"""WITH {POINTS}, {COV}, r AS (SELECT label, xx + 0.001 AS a, xy AS b, xz AS c, yy + 0.001 AS d, yz AS e, zz + 0.001 AS f FROM cov),
  t AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM r)
  SELECT label, round(det, 3) AS det, round((d * f - e * e) / det, 9) AS i00, round((c * e - b * f) / det, 9) AS i01, round((b * e - c * d) / det, 9) AS i02,
    round((a * f - c * c) / det, 9) AS i11, round((b * c - a * e) / det, 9) AS i12, round((a * d - b * b) / det, 9) AS i22 FROM t""")
def matrix_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Determinant and inverse of each label's covariance with a ridge."""
    c = _covariances(spark, sf_dir).withColumn("m", mat.ridged(F.col("m"), 0.001)).withColumn("i", mat.inverse(F.col("m")))
    at = {"i00": 0, "i01": 1, "i02": 2, "i11": 4, "i12": 5, "i22": 8}
    c = c.select("label", mat.determinant(F.col("m")).alias("det"), *[F.col("i").getItem(i).alias(k) for k, i in at.items()])
    return rounded(rounded(c, *at, digits=9), "det", digits=3)


@query(f"""WITH {POINTS}, {COV}, q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cov),
  p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
  t AS (SELECT *, acos(greatest(least(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - xz * yz) + xz * (xy * yz - xz * (yy - q))) / (2 * p * p * p), 1.0), -1.0)) / 3 AS t FROM p),
  v AS (SELECT label, q + 2 * p * cos(t) AS v0, q + 2 * p * cos(t - 2 * pi() / 3) AS v1, q + 2 * p * cos(t + 2 * pi() / 3) AS v2 FROM t)
  SELECT label, {", ".join(f"round(greatest(least(2 * sqrt(greatest(v{k}, 0.0)), 50.0), 0.0001), 5) AS a{k}" for k in range(3))} FROM v""")
def ellipsoid_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half axes of each label's ellipsoid of two deviations."""
    a = mat.ellipsoid(F.col("m"), 2.0)
    return rounded(_covariances(spark, sf_dir).select("label", *[v.alias(f"a{k}") for k, v in enumerate(a)]), "a0", "a1", "a2", digits=5)


@query(f"""WITH {POSES} SELECT uid, step, round(cos(yaw) * cos(0.1), 6) AS r00, round(-sin(yaw), 6) AS r01, round(cos(yaw) * sin(0.1), 6) AS r02, round(sin(yaw) * cos(0.1), 6) AS r10, round(cos(yaw), 6) AS r11,
  round(sin(yaw) * sin(0.1), 6) AS r12, round(-sin(0.1), 6) AS r20, CAST(0 AS DOUBLE) AS r21, round(cos(0.1), 6) AS r22 FROM poses""")
def orthonormal_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations stretched along their axes, and made rotations again."""
    zero = F.lit(0.0)
    r, _ = geo.split_pose(geo.pose_matrix(F.col("yaw"), F.lit(0.1), zero, zero, zero, zero))
    p = poses(spark, sf_dir).withColumn("r", r)
    stretch = F.array(*[F.lit(s) for s in (1.2, 0.9, 1.05)] * 3)
    p = p.withColumn("m", mat.orthonormalised(F.zip_with("r", stretch, lambda x, s: x * s)))
    cells = [f"r{i}{j}" for i in range(3) for j in range(3)]
    return rounded(p.select("uid", "step", *[F.col("m").getItem(k).alias(c) for k, c in enumerate(cells)]), *cells).withColumn("r21", F.abs("r21"))


BLOCKS, WIDTH, TURN = 30, 360, 0.05
MOVES = "moves AS (SELECT uid AS frame, avg(yaw) / 10 AS dyaw, avg(x) / 10 AS dx, avg(y) / 10 AS dy FROM poses GROUP BY uid)"


@query(f"""WITH {SCAN}, {POSES}, {MOVES}, s AS (SELECT frame, col, dist * cos(col * {TURN}) AS x, dist * sin(col * {TURN}) AS y, greatest(1 - (col // {WIDTH // BLOCKS}) * {WIDTH // BLOCKS / WIDTH}::DOUBLE, 0.0) AS f FROM scan WHERE dist IS NOT NULL)
  SELECT frame, col, round(cos(f * dyaw) * x - sin(f * dyaw) * y + f * dx, 6) AS x, round(sin(f * dyaw) * x + cos(f * dyaw) * y + f * dy, 6) AS y FROM s JOIN moves USING (frame)""")
def scan_unskewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each return as seen from the end of its scan."""
    moves = poses(spark, sf_dir).groupBy(F.col("uid").alias("frame")).agg(*[(F.avg(c) / 10).alias("d" + c) for c in ("yaw", "x", "y")])
    s, zero = scan(spark, sf_dir).where("dist is not null").join(moves, "frame"), F.lit(0.0)
    angle = F.col("col") * TURN
    x, y, _ = geo.unskewed((F.col("dist") * F.cos(angle), F.col("dist") * F.sin(angle), zero), (F.col("dyaw"), zero, zero, F.col("dx"), F.col("dy"), zero), F.col("col"), WIDTH, BLOCKS)
    return rounded(s.select("frame", "col", x.alias("x"), y.alias("y")), "x", "y")


def _pose(p: str = "") -> F.Column:
    zero = F.lit(0.0)
    return geo.pose_matrix(F.col(p + "yaw"), zero, zero, F.col(p + "x"), F.col(p + "y"), zero)


@query(f"WITH {POSES} SELECT uid, step, round(x + cos(yaw) * 1.5 - sin(yaw) * 0.5, 6) AS x, round(y + sin(yaw) * 1.5 + cos(yaw) * 0.5, 6) AS y, round(atan2(sin(yaw), cos(yaw)), 6) AS yaw FROM poses")
def states_recentred(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = geo.recentred(_pose(), F.lit(1.5), F.lit(0.5), F.lit(0.0))
    p = poses(spark, sf_dir).withColumn("m", m)
    return rounded(p.select("uid", "step", F.col("m").getItem(3).alias("x"), F.col("m").getItem(7).alias("y"), geo.pose_angles(F.col("m"))[0].alias("yaw")), "x", "y", "yaw")


@query(f"""WITH {POSES}, j AS (SELECT a.uid, a.step, a.yaw AS t, b.x - a.x AS gx, b.y - a.y AS gy, b.yaw - a.yaw AS g FROM poses a JOIN poses b ON b.uid = a.uid + 1 AND b.step = a.step + 2)
  SELECT uid, step, round(cos(t) * gx + sin(t) * gy, 6) AS dx, round(-sin(t) * gx + cos(t) * gy, 6) AS dy, round(atan2(sin(g), cos(g)), 6) AS dyaw FROM j""")
def relative_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next track's pose two steps later, in the frame of each pose."""
    a = poses(spark, sf_dir)
    b = a.select((F.col("uid") - 1).alias("uid"), (F.col("step") - 2).alias("step"), *[F.col(c).alias("b_" + c) for c in ("x", "y", "yaw")])
    m = geo.compose_pose(geo.invert_pose(_pose()), _pose("b_"))
    j = a.join(b, ["uid", "step"]).withColumn("m", m)
    return rounded(j.select("uid", "step", F.col("m").getItem(3).alias("dx"), F.col("m").getItem(7).alias("dy"), geo.pose_angles(F.col("m"))[0].alias("dyaw")), "dx", "dy", "dyaw")


@query(f"WITH {POINTS}, {FIRST} SELECT m.id, near_id, round(d2, 6) AS d2 FROM m WHERE near_id NOT IN (SELECT id FROM points WHERE conf >= 0.5)")
def matches_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours whose target is not taken yet."""
    taken = points(spark, sf_dir).where("conf >= 0.5").select(F.col("id").alias("near_id"))
    return rounded(audit.unused_matches(_moved_to_points(spark, sf_dir), taken).select("id", "near_id", "d2"), "d2")


SEVEN = f"({D2} + 4 * ((a.nx - b.nx) ** 2 + (a.ny - b.ny) ** 2 + (a.nz - b.nz) ** 2) + 9 * (a.conf - b.conf) ** 2)"


@query(f"""WITH {POINTS} SELECT a.id, b.id AS near_id, round({SEVEN}, 6) AS d2 FROM points a, points b WHERE a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {SEVEN}, b.id) = 1 AND {SEVEN} <= 36""")
def knn_7d_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest in place, normal and confidence, if it is within 6."""
    p = points(spark, sf_dir)
    near = knn.knn(p, p, 1, extra={"nx": 2.0, "ny": 2.0, "nz": 2.0, "conf": 3.0})
    return rounded(near.where("d2 <= 36").select("id", "near_id", "d2"), "d2")


SIX = f"({D2} + 3 * (a.z - b.z) ** 2 + (a.nx - b.nx) ** 2 + (a.ny - b.ny) ** 2 + (a.nz - b.nz) ** 2)"


@query(f"""WITH {POINTS}, b AS (SELECT * FROM points WHERE (x - 1) ** 2 + (y + 2) ** 2 + (z - 3) ** 2 < 144), a AS (SELECT * REPLACE ({", ".join(f"{c} + {d} AS {c}" for c, d in MOVE.items())}) FROM points),
  m AS (SELECT a.id, b.id AS near_id, sqrt({D2}) AS dist, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {SIX}, b.id) AS INTEGER) AS nth FROM a, b QUALIFY nth <= 3)
  SELECT id, near_id, round(dist, 6) AS dist, round(least(1.0, first_value(dist) OVER (PARTITION BY id ORDER BY nth) / greatest(dist, 1e-8)), 6) AS w, nth FROM m""")
def map_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moved scan against the part of the map around it, by place, heights twofold, and normal."""
    b = points(spark, sf_dir)
    a = b.withColumns({c: F.col(c) + d for c, d in MOVE.items()})
    return rounded(knn.map_matches(a, b, (1.0, -2.0, 3.0), 12.0, 3), "dist", "w")


@query(f"""WITH {POINTS}, {PIX}, s AS (SELECT pix.*, conf, max(dist) OVER (PARTITION BY px, py) - dist AS plane, abs(nx * x + ny * y + nz * z) / dist AS c FROM pix JOIN points USING (id)),
  seen AS (SELECT DISTINCT px, py FROM pix JOIN points USING (id) WHERE label <> 3 AND px IS NOT NULL AND py IS NOT NULL)
  SELECT id FROM s LEFT JOIN seen g USING (px, py) WHERE NOT coalesce(plane > 3.0 * dist / 10 AND (conf < 0.4 OR c > 0.5) AND g.px IS NOT NULL, false)""")
def points_not_seen_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    q = _pixels(p).join(p, "id")
    cos = F.abs(sum(F.col("n" + c) * F.col(c) for c in "xyz")) / F.col("dist")
    s = q.withColumns({"plane": F.max("dist").over(Window.partitionBy("px", "py")) - F.col("dist"), "cos": cos})
    return audit.seen_through(s, q.where("label <> 3 and px is not null and py is not null"), 3.0, 0.5, 0.4).select("id")


@query(f"""WITH {POINTS}, {FIRST}, w AS (SELECT label, sqrt(d2) AS d, abs(o) AS e, CASE WHEN sqrt(d2) > 5.0 / ln(2.0) THEN 0.0 ELSE exp(-sqrt(d2) / (5.0 / ln(2.0))) END AS w FROM m JOIN points USING (id)),
  c AS (SELECT label, list_sort(list(d)) AS l FROM w WHERE w > 0 GROUP BY label), k AS (SELECT label, l[CAST(floor(len(l) * 0.9) AS BIGINT) + 1] AS cut FROM c),
  total AS (SELECT label, sum(w) AS tw, sum(d) FILTER (w > 0) / sum(w) AS md, sum(e) FILTER (w > 0) / sum(w) AS me FROM w GROUP BY label)
  SELECT label, count(*) AS n, round(cut, 6) AS cut, round(md, 6) AS mean_dist, round(me, 6) AS mean_err, round(sqrt(sum(w * (d - md) ** 2) / tw), 5) AS std_dist,
    round(sum(w * d) FILTER (d <= cut) / sum(w) FILTER (d <= cut), 6) AS kept_dist, round(sum(w * e) FILTER (d <= cut) / sum(w) FILTER (d <= cut), 6) AS kept_err,
    round(count(*) FILTER (d > cut OR w = 0) / count(*), 6) AS outliers FROM w JOIN k USING (label) JOIN total USING (label) GROUP BY label, cut, md, me, tw""")
def correspondence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _moved_to_points(spark, sf_dir)
    d = F.sqrt("d2")
    off = knn.plane_distance(*[tuple(F.col(p + c) for c in "xyz") for p in ("b_n", "a_", "b_")])
    s = audit.correspondence_stats(m.select(F.col("a_label").alias("label"), d.alias("dist"), F.abs(off).alias("err"), knn.correspondence_weight(d, d, 5.0).alias("weight")), ["label"])
    return rounded(rounded(s, "cut", "mean_dist", "mean_err", "kept_dist", "kept_err", "outliers"), "std_dist", digits=5)


@query(f"WITH {POINTS}, {FIRST} SELECT id, round(CASE WHEN sqrt(d2) > 1.5 THEN 1.5 / sqrt(d2) ELSE 1.0 END, 6) AS w FROM m")
def threshold_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_moved_to_points(spark, sf_dir).select("id", audit.threshold_weight(F.sqrt("d2"), 1.5).alias("w")), "w")


@query(f"""WITH {PIXELS}, p AS (SELECT *, CASE WHEN (row + col) % 3 > 0 THEN floor(dist / 4) END AS v FROM pixels),
  n AS (SELECT p.*, l.v AS l, r.v AS r, u.v AS u, d.v AS d FROM p LEFT JOIN p l ON l.frame = p.frame AND l.row = p.row AND l.col = p.col - 1 LEFT JOIN p r ON r.frame = p.frame AND r.row = p.row AND r.col = p.col + 1
    LEFT JOIN p u ON u.frame = p.frame AND u.col = p.col AND u.row = p.row - 1 LEFT JOIN p d ON d.frame = p.frame AND d.col = p.col AND d.row = p.row + 1),
  s AS (SELECT *, list_sort([l, r, u, d], 'ASC', 'NULLS LAST') AS t FROM n)
  SELECT frame, row, col, CAST(CASE WHEN v IS NOT NULL OR dist IS NULL THEN v WHEN t[2] IS NOT DISTINCT FROM t[3] THEN t[2] WHEN t[1] IS NOT DISTINCT FROM t[2] AND t[3] IS DISTINCT FROM t[4] THEN t[1]
    WHEN t[3] IS NOT DISTINCT FROM t[4] AND t[1] IS DISTINCT FROM t[2] THEN t[3] END AS BIGINT) AS filled FROM s""")
def ids_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).withColumn("v", F.when((F.col("row") + F.col("col")) % 3 > 0, F.floor(F.col("dist") / 4)))
    return audit.fill_from_neighbours(p, "v").select("frame", "row", "col", "filled")


@query(f"""{SEGMENTS}, z AS (SELECT frame, segment, count(*) AS n FROM lab GROUP BY ALL HAVING count(*) >= 3), refd AS (SELECT frame, CAST(sum(n) AS BIGINT) AS referenced FROM z GROUP BY frame),
  seen AS (SELECT frame, count(*) AS pixels, count(dist) AS returns FROM pixels GROUP BY frame)
  SELECT frame, pixels, returns, returns AS assigned, coalesce(referenced, 0) AS referenced, CAST(0 AS BIGINT) AS orphans, returns <> coalesce(referenced, 0) AS uneven FROM seen LEFT JOIN refd USING (frame)""")
def frame_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each frame against segments of at least three pixels."""
    p = pixels(spark, sf_dir)
    lab = stored(segments.segment_frames(p, 2.0))
    return audit.frame_audit(p.join(lab.drop("dist"), ["frame", "row", "col"], "left"), segments.segment_stats(lab, 3))


EDGE = f"""p AS (SELECT a.id, b.id AS near_id, a.nx AS n1, a.ny AS n2, a.nz AS n3, b.nx AS m1, b.ny AS m2, b.nz AS m3, (b.x - a.x) / sqrt({D2}) AS v1, (b.y - a.y) / sqrt({D2}) AS v2, (b.z - a.z) / sqrt({D2}) AS v3,
    sqrt({D2}) AS len, a.conf AS c1, b.conf AS c2 FROM points a JOIN points b ON a.id + 1 = b.id)"""


@query(f"""WITH {POINTS}, {EDGE}, s AS (SELECT *, n1 * m1 + n2 * m2 + n3 * m3 AS dot, n1 * v1 + n2 * v2 + n3 * v3 AS a, -(m1 * v1 + m2 * v2 + m3 * v3) AS b FROM p),
  e AS (SELECT *, greatest(1 - abs(n3), 1 - abs(m3)) AS up2, least(1 - abs(n3), 1 - abs(m3)) AS up, (1 - dot - 0.049) * 10.0 AS u, greatest(a, b) - 0.104 AS v FROM s)
  SELECT id, near_id, (a <= 0.104 AND b <= 0.104) OR dot >= 1 - 0.01 * len * sin(acos(1 - 0.049)) OR (abs(n3) < 0.5 AND abs(m3) < 0.5) AS hard,
    round((1 - abs(c1 - c2)) * ((c1 + c2) / 2 * greatest(up, 0.5 - 0.5 * u / sqrt(1 + u * u), 0.5 - 0.5 * v / sqrt(1 + v * v)) + 1 - (c1 + c2) / 2), 6) AS blended FROM e""")
def edge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between consecutive points by fixed thresholds, and by their score as far as the normals are trusted."""
    p = points(spark, sf_dir)
    a = p.select("id", (F.col("id") + 1).alias("near_id"), *[F.col(c).alias("a_" + c) for c in p.columns if c != "id"])
    m = a.join(p.select(F.col("id").alias("near_id"), *[F.col(c).alias("b_" + c) for c in p.columns if c != "id"]), "near_id")
    n1, n2 = (tuple(F.col(f"{s}_n{c}") for c in "xyz") for s in "ab")
    gap = tuple(F.col("b_" + c) - F.col("a_" + c) for c in "xyz")
    size = norm3(gap)
    along = tuple(g / size for g in gap)
    score = segments.blended(segments.edge_score(n1, n2, along), F.col("a_conf"), F.col("b_conf"))
    return rounded(m.select("id", "near_id", segments.hard_edge(n1, n2, along, size / 100).alias("hard"), score.alias("blended")), "blended")


@query(f"""WITH {PIXELS}, s AS (SELECT a.frame, a.row, a.col, 1 / (1 + abs(a.dist - b.dist)) AS s1, 1 / (1 + abs(a.dist - c.dist)) AS s2 FROM pixels a LEFT JOIN pixels b ON b.frame = a.frame AND b.row = a.row AND b.col = a.col + 1
    LEFT JOIN pixels c ON c.frame = a.frame AND c.row = a.row AND c.col = a.col + 2)
  SELECT a.frame, a.row, a.col, round(CASE WHEN a.s2 IS NOT NULL AND b.s2 IS NOT NULL THEN least(a.s1, greatest(a.s2, b.s2)) ELSE a.s1 END, 6) AS multi FROM s a LEFT JOIN s b ON b.frame = a.frame AND b.row = a.row AND b.col = a.col - 1""")
def edges_multiscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("frame", "row").orderBy("col")
    score = {f"s{k}": F.when(F.lead("col", k).over(w) == F.col("col") + k, 1 / (1 + F.abs(F.col("dist") - F.lead("dist", k).over(w)))) for k in (1, 2)}
    return rounded(segments.multiscale(pixels(spark, sf_dir).withColumns(score), "s1", "s2").select("frame", "row", "col", "multi"), "multi")


KNOWN = icp.Pose(icp.rotation_from(np.array([0.2, -0.1, 0.7])), np.array([3.0, -2.0, 1.0]))
_BACK = [(f"r{i}{j}", KNOWN.rotation[j, i]) for i in range(3) for j in range(3)] + [(f"t{i}", v) for i, v in enumerate(-KNOWN.rotation.T @ KNOWN.translation)] + [("error", 0.0)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', round({v!r}::DOUBLE, 6))" for k, v in ((k, float(v)) for k, v in _BACK)) + ") t(term, value)")
def rigid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The move that takes points back from a known pose, by the singular vectors of the matched points; to the micron
    but for the error, which is read at a tenth of a millimetre."""
    b = points(spark, sf_dir)
    m = knn.matched(icp.moved(b, KNOWN), b, b.select("id", F.col("id").alias("near_id"))).withColumn("w", F.col("a_conf") + 0.1)
    pose = icp.rigid_fit(m)
    rows = [(f"r{i}{j}", float(pose.rotation[i, j])) for i in range(3) for j in range(3)] + [(f"t{i}", float(pose.translation[i])) for i in range(3)] + [("error", round(pose.error, 4))]
    return rounded(spark.createDataFrame(rows, "term string, value double"), "value")


@query(f"""WITH {POSES}, t AS (SELECT uid, max(step) AS age, max(step) - count(*) FILTER (x < 5) AS idle, count(*) AS points, avg(x) AS x, avg(y) AS y, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(yaw) - min(yaw) AS ez FROM poses GROUP BY uid)
  SELECT uid, uid <> 1 AND age > 5 AND idle < 200 AND points > 8 AND sqrt(x * x + y * y) < 5.5 AND ez > 0 AND coalesce(ln(greatest(ex, ey) / nullif(ez, 0)) < 1.0, false) AND ex * ey * ez < 100 AS shown FROM t""")
def results_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = [(F.max(c) - F.min(c)).alias(e) for c, e in (("x", "ex"), ("y", "ey"), ("yaw", "ez"))]
    t = poses(spark, sf_dir).groupBy("uid").agg(F.max("step").alias("age"), (F.max("step") - F.count_if(F.col("x") < 5)).alias("idle"), F.count("*").alias("points"), F.avg("x").alias("x"), F.avg("y").alias("y"), *size)
    return t.withColumn("z", F.lit(0.0)).select("uid", tracks.result_filter(False, 5, 200, 8, 5.5, 1.0, 100.0).alias("shown"))


@query("SELECT bool_and(label IS NOT NULL) AS all_tagged, count(*) FILTER (label IS NOT NULL) AS tagged, list_sort(list(DISTINCT label)) [1] AS first_label, count(DISTINCT label) AS labels FROM embeddings")
def tags_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.agg(F.bool_and(F.col("label").isNotNull()).alias("all_tagged"), F.count("label").alias("tagged"), F.min("label").alias("first_label"), F.count_distinct("label").alias("labels"))


@query(f"WITH {POINTS} SELECT id, least(floor(abs(atan2(y, x)) / ({math.pi} / 4)), 3)::BIGINT AS sector FROM points WHERE sqrt(x * x + y * y + z * z) < 40 AND (label IS NULL OR label = 1)")
def world_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in range that nobody or the world owns, by sector."""
    p = points(spark, sf_dir)
    yaw, _, dist = geo.to_polar(F.col("x"), F.col("y"), F.col("z"))
    return p.where((dist < 40) & (F.col("label").isNull() | (F.col("label") == 1))).select("id", F.least(F.floor(F.abs(yaw) / (math.pi / 4)), F.lit(3)).alias("sector"))
