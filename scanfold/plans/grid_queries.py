"""Queries over points: grids, neighbours, registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions import geo
from scanfold.functions.vec import norm3
from scanfold.operators import grid, icp, image, knn, segments

from .registry import query, rounded
from .views import POINTS, points

EXTENT = 5.0


def _cell(c: str, e: float = EXTENT) -> str:
    return f"CAST(trunc({c} / {e}) AS INTEGER) - CAST({c} < 0 AS INTEGER)"


CELLS = f"{POINTS}, cells AS (SELECT *, {_cell('x')} AS ix, {_cell('y')} AS iy, {_cell('z')} AS iz FROM points)"
EVEN, ODD = "id % 2 = 0", "id % 2 = 1"
NEAR = "a.ix - b.ix BETWEEN -1 AND 1 AND a.iy - b.iy BETWEEN -1 AND 1 AND a.iz - b.iz BETWEEN -1 AND 1"
D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(f"""WITH {CELLS} SELECT ix, iy, iz, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz, round(avg(conf), 6) AS mconf,
  (ix + 0.5::DOUBLE) * {EXTENT}::DOUBLE AS cx, (iy + 0.5::DOUBLE) * {EXTENT}::DOUBLE AS cy, (iz + 0.5::DOUBLE) * {EXTENT}::DOUBLE AS cz FROM cells GROUP BY ix, iy, iz""")
def grid_cell_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.cell_summary(points(spark, sf_dir), EXTENT), "mx", "my", "mz", "mconf")


@query(f"WITH {CELLS} SELECT ix, iy, iz, id, x, y, z FROM cells QUALIFY row_number() OVER (PARTITION BY ix, iy, iz ORDER BY id DESC) = 1")
def grid_single_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.last_per_cell(points(spark, sf_dir), EXTENT).select("ix", "iy", "iz", "id", "x", "y", "z")


@query(f"""WITH {CELLS} SELECT id, ix, iy, iz FROM cells a WHERE id % 2 = 0 OR NOT EXISTS
  (SELECT 1 FROM cells b WHERE b.id % 2 = 0 AND a.ix = b.ix AND a.iy = b.iy AND a.iz = b.iz)""")
def grid_insert_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return grid.insert_if_empty(p.where(EVEN), p.where(ODD), EXTENT).select("id", "ix", "iy", "iz")


@query(f"""WITH {CELLS} SELECT a.id, b.id AS near_id, round(sqrt({D2}), 6) AS dist FROM cells a JOIN cells b ON a.ix = b.ix AND a.iy = b.iy AND a.iz = b.iz AND a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) = 1""")
def grid_lazy_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return rounded(grid.nearest_in_cell(p, p, EXTENT), "dist")


@query(f"WITH {CELLS} SELECT a.id AS a_id, count(*) AS n, sum(b.id)::BIGINT AS ids FROM cells a JOIN cells b ON {NEAR} GROUP BY a.id")
def grid_cubic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", "x", "y", "z")
    return grid.neighbours(p, p, EXTENT, 1).groupBy("a_id").agg(F.count("*").alias("n"), F.sum("b_id").alias("ids"))


@query(f"WITH {CELLS} SELECT id, ix, iy, iz FROM cells a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.label = 3 AND {NEAR})")
def grid_remove_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return grid.remove_neighbourhood(p, p.where("label = 3"), EXTENT).select("id", "ix", "iy", "iz")


@query(f"WITH {CELLS} SELECT id, x, y, z, conf FROM cells WHERE ix % 2 = 0 AND iy % 2 = 0 AND iz % 2 = 0")
def grid_export_decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.decimate(points(spark, sf_dir), EXTENT, 2).select("id", "x", "y", "z", "conf")


@query(f"WITH {CELLS} SELECT ix, iy, iz, id, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy, iz ORDER BY id) AS nth FROM cells) WHERE nth <= 2")
def uniform_cell_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.sample_cells(points(spark, sf_dir), EXTENT, 2).select("ix", "iy", "iz", "id", "nth")


@query(f"""WITH RECURSIVE {CELLS}, c AS (SELECT ix, iy, iz, id, conf, (abs(x - (ix + 0.5) * {EXTENT}) + abs(y - (iy + 0.5) * {EXTENT}) + abs(z - (iz + 0.5) * {EXTENT})) / {EXTENT} AS off, sqrt(x * x + y * y + z * z) AS rng,
    row_number() OVER (PARTITION BY ix, iy, iz ORDER BY id) AS k FROM cells),
  r AS (SELECT ix, iy, iz, k, id, off, rng, conf FROM c WHERE k = 1 UNION ALL
    SELECT ix, iy, iz, k, CASE WHEN gain > 0.3 THEN id2 ELSE id END, CASE WHEN gain > 0.3 THEN off2 ELSE off END, CASE WHEN gain > 0.3 THEN rng2 ELSE rng END, CASE WHEN gain > 0.3 THEN conf2 ELSE conf END
    FROM (SELECT r.ix, r.iy, r.iz, c.k, r.id, r.off, r.rng, r.conf, c.id AS id2, c.off AS off2, c.rng AS rng2, c.conf AS conf2, (r.off - c.off) / 1.5 + (r.rng - c.rng) / greatest(r.rng, 1e-9) + c.conf - r.conf AS gain
      FROM r JOIN c ON c.ix = r.ix AND c.iy = r.iy AND c.iz = r.iz AND c.k = r.k + 1))
  SELECT ix, iy, iz, id, k AS hits FROM r QUALIFY row_number() OVER (PARTITION BY ix, iy, iz ORDER BY k DESC) = 1""")
def voxel_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.elect(points(spark, sf_dir), EXTENT)


def _knn_sql(k: int, extra: str = "") -> str:
    d2 = f"({D2}{extra})"
    return f"""WITH {POINTS} SELECT a.id, b.id AS near_id, round({d2}, 6) AS d2, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {d2}, b.id) AS INTEGER) AS nth
  FROM points a, points b WHERE a.id <> b.id QUALIFY nth <= {k}"""


@query(_knn_sql(3))
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return rounded(knn.knn(p, p, 3), "d2")


@query(_knn_sql(2, " + 4 * ((a.nx - b.nx) * (a.nx - b.nx) + (a.ny - b.ny) * (a.ny - b.ny) + (a.nz - b.nz) * (a.nz - b.nz))"))
def knn_6d_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and twice the normals."""
    p = points(spark, sf_dir)
    return rounded(knn.knn(p, p, 2, extra={"nx": 2.0, "ny": 2.0, "nz": 2.0}), "d2")


@query(f"""WITH {POINTS}, m AS (SELECT a.id, b.id AS near_id, sqrt({D2}) AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS nth FROM points a, points b WHERE a.id <> b.id QUALIFY nth <= 3),
  f AS (SELECT *, min(d) OVER (PARTITION BY id) AS d0 FROM m)
  SELECT id, near_id, round(CASE WHEN d > 4.0 / ln(2.0) THEN 0.0 ELSE exp(-d / (4.0 / ln(2.0))) * CASE WHEN d > d0 THEN d0 / d ELSE 1.0 END END, 6) AS w FROM f""")
def knn_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = points(spark, sf_dir)
    m = knn.knn(p, p, 3).withColumn("d", F.sqrt("d2"))
    m = m.withColumn("d0", F.min("d").over(Window.partitionBy("id")))
    return rounded(m.select("id", "near_id", knn.correspondence_weight(F.col("d"), F.col("d0"), 4.0).alias("w")), "w")


@query(f"WITH {POINTS} SELECT a.id, count(b.id) AS n FROM points a LEFT JOIN points b ON a.id <> b.id AND {D2} <= 16 GROUP BY a.id")
def radius_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.radius_count(points(spark, sf_dir), 4.0)


@query(f"WITH {POINTS} SELECT a.id AS a_id, b.id AS b_id, round({D2}, 6) AS d2 FROM points a, points b WHERE abs(a.id - b.id) >= 20 AND {D2} <= 9")
def radius_pairs_theiler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.radius_pairs(points(spark, sf_dir), 3.0, 20), "d2")


OFF = "(b.nx * (a.x - b.x) + b.ny * (a.y - b.y) + b.nz * (a.z - b.z))"
MOVE = {"x": 0.75, "y": -0.5, "z": 0.25}
FIRST = f"""a AS (SELECT id, {", ".join(f"{c} + {d} AS {c}" for c, d in MOVE.items())} FROM points),
  m AS (SELECT a.id, b.id AS near_id, a.x, a.y, a.z, b.nx, b.ny, b.nz, {D2} AS d2, {OFF} AS o FROM a, points b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) = 1)"""


def _moved_to_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points, moved, with their nearest among all points where they were."""
    b = points(spark, sf_dir)
    a = b.withColumns({c: F.col(c) + d for c, d in MOVE.items()})
    return knn.matched(a, b, knn.knn(a, b, 1, same_table=False))


@query(f"WITH {POINTS}, {FIRST} SELECT id, near_id, round(o, 6) AS off, round(x - o * nx, 6) AS px, round(y - o * ny, 6) AS py, round(z - o * nz, 6) AS pz FROM m")
def plane_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.project_on_planes(_moved_to_points(spark, sf_dir)), "off", "px", "py", "pz")


@query(f"""WITH {POINTS}, {FIRST}, w AS (SELECT sqrt(d2) AS d, abs(o) AS o, CASE WHEN sqrt(d2) > 5.0 / ln(2.0) THEN 0.0 ELSE exp(-sqrt(d2) / (5.0 / ln(2.0))) END AS w FROM m)
  SELECT round(sum(w), 6) AS w, round(sum(w * o) / sum(w), 6) AS mean_plane, round(sum(w * d) / sum(w), 6) AS mean_point FROM w""")
def reg_error_pt_plane_pt_pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.registration_error(_moved_to_points(spark, sf_dir), 5.0), "w", "mean_plane", "mean_point")


SHIFTED = f"""{CELLS}, p AS (SELECT a.id, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz AS c, {OFF} AS b, exp(-sqrt(sqrt({D2}))) AS wd FROM cells a JOIN cells b ON {NEAR} AND a.id <> b.id),
  g AS (SELECT id, count(*) AS n, sum(c * wd * c * c * b) AS g, sum(c * wd * c * c * c) AS h FROM p WHERE c > 0 GROUP BY id), s AS (SELECT id, n, -g / h AS shift FROM g)"""


@query(f"WITH {SHIFTED} SELECT id, n, round(CASE WHEN n >= 3 AND abs(shift) < 0.5 THEN shift END, 6) AS shift FROM s")
def adapt_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.plane_shift(points(spark, sf_dir), EXTENT), "shift")


PIX = f"""pol AS (SELECT id, atan2(y, x) AS yaw, atan2(-z, sqrt(x * x + y * y)) AS pitch, sqrt(x * x + y * y + z * z) AS dist FROM points),
  b AS (SELECT *, ((pi() - yaw) % (2 * pi()) + 2 * pi()) % (2 * pi()) AS t, ((pitch + 1.2) % (2 * pi()) + 2 * pi()) % (2 * pi()) AS u FROM pol),
  pix AS (SELECT id, dist, CASE WHEN floor(t / (2 * pi() / 180)) < 180 THEN CAST(floor(t / (2 * pi() / 180)) AS INTEGER) END AS px,
    CASE WHEN floor(u / (2.4 / 32)) < 32 THEN CAST(floor(u / (2.4 / 32)) AS INTEGER) END AS py FROM b)"""


def _pixels(p: DataFrame) -> DataFrame:
    import math

    yaw, pitch, dist = geo.to_polar(F.col("x"), F.col("y"), F.col("z"))
    return p.select("id", dist.alias("dist"), geo.regular_bin(yaw, math.pi, -math.pi, 180).alias("px"), geo.regular_bin(pitch, -1.2, 1.2, 32).alias("py"))


@query(f"WITH {POINTS}, {PIX} SELECT id, round(dist, 6) AS dist, px, py FROM pix")
def project_to_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pixels(points(spark, sf_dir)), "dist")


@query(f"WITH {POINTS} SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM points")
def unproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polar coordinates and back."""
    x, y, z = geo.from_polar(*geo.to_polar(F.col("x"), F.col("y"), F.col("z")))
    return rounded(points(spark, sf_dir).select("id", x.alias("x"), y.alias("y"), z.alias("z")), "x", "y", "z")


@query(f"WITH {POINTS}, {PIX}, v AS (SELECT id, px, py, dist, min(dist) OVER (PARTITION BY px, py) AS front FROM pix WHERE px IS NOT NULL AND py IS NOT NULL) SELECT id, px, py, round(dist, 6) AS dist FROM v WHERE dist <= front * 1.02")
def zbuffer_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(points(spark, sf_dir)).where("px is not null and py is not null")
    return rounded(image.nearest_per_pixel(p, 0.02).select("id", "px", "py", "dist"), "dist")


@query(f"""WITH {POINTS}, p AS (SELECT a.id, b.id AS near_id, a.nx AS n1, a.ny AS n2, a.nz AS n3, b.nx AS m1, b.ny AS m2, b.nz AS m3, (b.x - a.x) / sqrt({D2}) AS v1, (b.y - a.y) / sqrt({D2}) AS v2, (b.z - a.z) / sqrt({D2}) AS v3
    FROM points a JOIN points b ON a.id + 1 = b.id),
  s AS (SELECT id, near_id, least(1 - abs(n3), 1 - abs(m3)) AS up, (1 - (n1 * m1 + n2 * m2 + n3 * m3) - 0.049) * 10.0 AS u,
    (greatest(n1 * v1 + n2 * v2 + n3 * v3, -(m1 * v1 + m2 * v2 + m3 * v3)) - 0.104) * 1.0 AS v FROM p)
  SELECT id, near_id, round(greatest(up, 0.5 - 0.5 * u / sqrt(1 + u * u), 0.5 - 0.5 * v / sqrt(1 + v * v)), 6) AS score FROM s""")
def convexity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    cols = ["x", "y", "z", "nx", "ny", "nz"]
    a = p.select(F.col("id"), (F.col("id") + 1).alias("near_id"), *[F.col(c).alias("a_" + c) for c in cols])
    m = a.join(p.select(F.col("id").alias("near_id"), *[F.col(c).alias("b_" + c) for c in cols]), "near_id")
    n1, n2 = (tuple(F.col(f"{s}_n{c}") for c in "xyz") for s in "ab")
    gap = tuple(F.col("b_" + c) - F.col("a_" + c) for c in "xyz")
    size = norm3(gap)
    return rounded(m.select("id", "near_id", segments.edge_score(n1, n2, tuple(g / size for g in gap)).alias("score")), "score")


_START = icp.KNOWN_START
_BACK = [(f"r{i}{j}", _START.rotation[j, i]) for i in range(3) for j in range(3)] + [(f"t{i}", v) for i, v in enumerate(-_START.rotation.T @ _START.translation)]


@query(f"""WITH {POINTS}, k(term, value) AS (VALUES {", ".join(f"('{k}', {float(v)!r}::DOUBLE)" for k, v in _BACK)}), n AS (SELECT count(*) AS n FROM points)
  SELECT term, round(CASE WHEN n > 0 THEN value END, 3) + 0 AS value FROM k, n UNION ALL SELECT 'error', CASE WHEN n > 0 THEN 0.0 END FROM n""")
def icp_point_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration of the table's points, moved by a known pose, back onto themselves, to three digits."""
    return icp.register_known_move(points(spark, sf_dir)).select("term", (F.round("value", 3) + 0).alias("value"))


@query(f"""WITH {SHIFTED} SELECT id, round(x + shift * nx, 6) AS x, round(y + shift * ny, 6) AS y, round(z + shift * nz, 6) AS z, n FROM s JOIN points USING (id) WHERE n >= 3 AND abs(shift) < 0.5""")
def map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that have a plane shift, moved by it: one Jacobi pass of the map filter."""
    p = points(spark, sf_dir)
    s = knn.plane_shift(p, EXTENT).where("shift is not null")
    return rounded(p.join(s, "id").select("id", *[(F.col(c) + F.col("shift") * F.col("n" + c)).alias(c) for c in "xyz"], "n"), *"xyz")


@query(f"""WITH {POINTS}, c AS (SELECT {", ".join(f"covar_samp({a}, {b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM points), q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c),
  p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
  t AS (SELECT *, acos(greatest(least(((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - xz * yz) + xz * (xy * yz - xz * (yy - q))) / (2 * p * p * p), 1.0), -1.0)) / 3 AS t FROM p)
  SELECT round(q + 2 * p * cos(t), 4) AS v0, round(q + 2 * p * cos(t - 2 * pi() / 3), 4) AS v1, round(q + 2 * p * cos(t + 2 * pi() / 3), 4) AS v2, 0.0::DOUBLE AS c01, 0.0::DOUBLE AS c02, 0.0::DOUBLE AS c12 FROM t""")
def pca_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances and covariances of points in the coordinates of their principal axes."""
    from scanfold.operators.learn import pca

    p = points(spark, sf_dir)
    mean, _, axes = pca(p, ["x", "y", "z"])
    turned = p.select("id", *[sum((F.col(c) - F.lit(float(mean[j]))) * F.lit(float(axes[k][j])) for j, c in enumerate("xyz")).alias(f"p{k}") for k in range(3)])
    v = turned.agg(*[F.round(F.var_samp(f"p{k}"), 4).alias(f"v{k}") for k in range(3)], *[(F.round(F.covar_samp(f"p{i}", f"p{j}"), 4) + 0).alias(f"c{i}{j}") for i, j in ((0, 1), (0, 2), (1, 2))])
    return v
