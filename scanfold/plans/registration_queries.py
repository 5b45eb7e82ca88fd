"""Queries on energies, registrations of many tracks and their covariances."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfold.operators import energies, icp, noise, track_icp

from .grid_queries import FIRST, _moved_to_points
from .registry import query, rounded
from .views import PIXELS, POINTS, pixels, points

#: The deviation of a point's normal in these queries.
SIGMA = 0.2
ENERGIES = {"point": energies.PointToPoint(), "plane": energies.PointToPlane(), "noisy": energies.PointToNoisyPlane(), "blend": energies.Blend(energies.PointToPlane(), energies.PointToPoint())}
_D2 = "(dx * dx + dy * dy + dz * dz)"
_OFF = "(dx * nx + dy * ny + dz * nz)"
ENERGY_SQL = {"point": _D2, "plane": f"{_OFF} ** 2", "noisy": f"CASE WHEN {_D2} < 0.0001 THEN 0.0 ELSE {_OFF} ** 2 / {_D2} / {SIGMA} END", "blend": f"conf * {_OFF} ** 2 + (1 - conf) * {_D2}"}
MATCHED = f"{FIRST}, n AS (SELECT m.*, b.x AS qx, b.y AS qy, b.z AS qz, b.conf, a.conf + 0.1 AS w FROM m JOIN points b ON b.id = m.near_id JOIN points a ON a.id = m.id)"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _moved_to_points(spark, sf_dir)
    return m.withColumns({"w": F.col("a_conf") + 0.1, "b_sigma": F.lit(SIGMA)})


def _differences() -> str:
    """SQL for gradients and Hessians by central differences: the energies at the matches moved by steps of H, to first
    order in the angles, as the definition has it."""
    h = 1e-4
    steps = [(0.0,) * 6] + [tuple(s * h if k == i else 0.0 for k in range(6)) for i in range(6) for s in (1, -1)]
    steps += [tuple(s * h if k == i else t * h if k == j else 0.0 for k in range(6)) for i in range(6) for j in range(i) for s in (1, -1) for t in (1, -1)]
    values = ", ".join(str((k, *x)) for k, x in enumerate(steps))
    moved = ["x + ry * z - rz * y + tx - qx", "y + rz * x - rx * z + ty - qy", "z + rx * y - ry * x + tz - qz"]
    number = {x: k for k, x in enumerate(steps)}

    def at(*moves: tuple[int, int]) -> str:
        x = [0.0] * 6
        for i, s in moves:
            x[i] = s * h
        return f"e[{number[tuple(x)] + 1}]"

    rows = [f"SELECT name, 'g{i}' AS term, ({at((i, 1))} - {at((i, -1))}) / {2 * h} AS value FROM e" for i in range(6)]
    rows += [f"SELECT name, 'h{i}{i}', ({at((i, 1))} - 2 * {at()} + {at((i, -1))}) / {h * h} FROM e" for i in range(6)]
    rows += [f"SELECT name, 'h{j}{i}', ({at((i, 1), (j, 1))} - {at((i, 1), (j, -1))} - {at((i, -1), (j, 1))} + {at((i, -1), (j, -1))}) / {4 * h * h} FROM e" for i in range(6) for j in range(i)]
    each = " UNION ALL ".join(f"SELECT '{name}' AS name, k, sum(w * ({sql})) AS e FROM d GROUP BY k" for name, sql in ENERGY_SQL.items())
    return f"""WITH {POINTS}, {MATCHED}, s(k, rx, ry, rz, tx, ty, tz) AS (VALUES {values}),
  d AS (SELECT k, w, nx, ny, nz, conf, {moved[0]} AS dx, {moved[1]} AS dy, {moved[2]} AS dz FROM n, s), sums AS ({each}), e AS (SELECT name, list(e ORDER BY k) AS e FROM sums GROUP BY name),
  t AS ({" UNION ALL ".join(rows)}), top AS (SELECT name, max(abs(value)) FILTER (term[1] = 'h') AS h, max(abs(value)) FILTER (term[1] = 'g') AS g FROM t GROUP BY name)
  SELECT name, term, CAST(round(value / CASE WHEN term[1] = 'h' THEN h ELSE g END, 2) + 0 AS DECIMAL(9, 2)) AS value FROM t JOIN top USING (name)"""


@query(_differences())
def energy_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed gradient and Hessian of each energy over matches, each as a share of its largest entry, to two digits;
    the SQL takes differences of the energies themselves."""
    m = _matches(spark, sf_dir)
    out = None
    names = [f"g{k}" for k in range(6)] + [f"h{i}{j}" for i, j in energies.SIX]
    for name, energy in ENERGIES.items():
        sums = energies.approximated(m, energy).agg(*energies.weighted_sums())
        terms = F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).alias("value")) for c in names])
        rows = sums.select(F.lit(name).alias("name"), F.explode(terms).alias("t")).select("name", "t.*")
        out = rows if out is None else out.unionAll(rows)
    top = F.max(F.abs("value")).over(Window.partitionBy("name", F.substring("term", 1, 1)))
    return out.select("name", "term", (F.round(F.col("value") / top, 2) + 0).cast("decimal(9,2)").alias("value"))


#: Poses of labels that are known: the turn and shift of label k, the least deviation predicted, and thresholds.
YAW, SHIFT = 0.002, (0.01, -0.02, 0.005)
DEVIATION, SURE, FEW = 0.05, 0.45, 50
SETTINGS = track_icp.Settings(confident=SURE, yaw_only_below=FEW)
_LABEL = "(label + 1)"


@query(f"""WITH {POINTS}, k AS (SELECT label AS uid, count(*) AS n, avg(conf) AS conf, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, {YAW}::DOUBLE * {_LABEL} AS a, {SHIFT[0]}::DOUBLE * {_LABEL} AS tx, {SHIFT[1]}::DOUBLE AS ty, {SHIFT[2]}::DOUBLE * {_LABEL} AS tz FROM points GROUP BY label),
  c AS (SELECT *, cos(a) * mx + sin(a) * my - cos(a) * tx - sin(a) * ty AS x, -sin(a) * mx + cos(a) * my + sin(a) * tx - cos(a) * ty AS y, mz - tz AS z FROM k),
  g AS (SELECT *, sqrt(a * a + (mx - x) ** 2 + (my - y) ** 2 + (mz - z) ** 2) / {DEVIATION} AS off FROM c)
  SELECT CAST(uid AS BIGINT) AS uid, conf > {SURE} AS plane, n < {FEW} AS yaw_only, off <= 2 AS accepted, round(off, 2) AS deviations, round(a, 4) AS yaw, round(tx, 3) AS x, round(ty, 3) AS y, round(tz, 3) AS z FROM g""")
def tracks_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's points, taken back from a pose of its own, registered onto the whole table from the identity."""
    p = points(spark, sf_dir)
    known = p.select("label").distinct().withColumn("k", F.col("label") + 1)
    a = F.lit(YAW) * F.col("k")
    back = p.join(known, "label").withColumns({c: F.col(c) - s for c, s in zip("xyz", (F.lit(SHIFT[0]) * F.col("k"), F.lit(SHIFT[1]), F.lit(SHIFT[2]) * F.col("k")), strict=True)})
    x, y = F.cos(a) * F.col("x") + F.sin(a) * F.col("y"), F.cos(a) * F.col("y") - F.sin(a) * F.col("x")
    own = back.select(F.col("label").cast("long").alias("uid"), "id", x.alias("x"), y.alias("y"), "z", "conf")
    one = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    tracks = known.select(F.col("label").cast("long").alias("uid"), F.array(*map(F.lit, one)).alias("pose"), F.array(*map(F.lit, (DEVIATION**2 * np.eye(6)).ravel().tolist())).alias("covariance"))
    r = track_icp.register_tracks(own, tracks, p, SETTINGS)
    pose = F.col("pose").getItem
    out = r.select("uid", "plane", "yaw_only", "accepted", F.round("deviations", 2).alias("deviations"), F.round(F.atan2(pose(4), pose(0)), 4).alias("yaw"), *[F.round(pose(4 * i + 3), 3).alias(c) for i, c in enumerate("xyz")])
    return out


def _sampled() -> str:
    rows = []
    for k, x in enumerate([(0.0,) * 6, *noise.lattice()]):
        r = icp.rotation_from(np.array(x[:3]))
        rows.append(str((k, *x, *map(float, r.ravel()))))
    cells = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum(s * x{i} * x{j}) / 62 AS value FROM p" for i in range(6) for j in range(6))
    return f"""WITH {POINTS}, {MATCHED}, l(k, {", ".join(f"x{i}" for i in range(6))}, {", ".join(f"r{i}{j}" for i in range(3) for j in range(3))}) AS (VALUES {", ".join(rows)}),
  d AS (SELECT k, w, nx, ny, nz, {", ".join(f"r{i}0 * x + r{i}1 * y + r{i}2 * z + x{3 + i} - q{c} AS d{c}" for i, c in enumerate("xyz"))} FROM n, l),
  e AS (SELECT k, sum(w * {_OFF} ** 2) / sum(w) AS e FROM d GROUP BY k), b AS (SELECT e AS b FROM e WHERE k = 0),
  p AS (SELECT l.*, 5 * b / greatest(b / 500, e - b) AS s FROM e JOIN l USING (k), b WHERE k > 0), c AS ({cells})
  SELECT i, j, round(value / max(abs(value)) OVER (), 6) AS value FROM c"""


@query(_sampled())
def registration_sampled_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-to-plane energy at 63 moves of the matches, and the covariance that it implies, as shares of its largest entry."""
    c = noise.sampled_covariance(_matches(spark, sf_dir), energies.PointToPlane())
    return c.select("i", "j", F.round(F.col("value") / F.max(F.abs("value")).over(Window.partitionBy()), 6).alias("value"))


_SIGNS = ", ".join(str((k, sign)) for k in range(6) for sign in (1, -1))
_ROOTS = ["0.015", f"abs(v * {math.sin(0.0015)!r})", f"abs(v * {math.sin(0.00017)!r})", "0.015", f"abs(h * {math.sin(0.0015)!r})", f"abs(h * {math.sin(0.00017)!r})"]
_INPUTS = ["v - dist", "0.0", f"v * {math.sin(0.0072)!r}", "h - dist", f"h * {math.sin(0.0075)!r}", "0.0"]


@query(f"""WITH {PIXELS}, t AS (SELECT p.*, r.dist AS h, u.dist AS v FROM pixels p JOIN pixels r ON r.frame = p.frame AND r.row = p.row AND r.col = p.col + 1 JOIN pixels u ON u.frame = p.frame AND u.row = p.row - 1 AND u.col = p.col
    WHERE p.dist IS NOT NULL AND r.dist IS NOT NULL AND u.dist IS NOT NULL), s(k, sign) AS (VALUES (-1, 0), {_SIGNS}),
  a AS (SELECT frame, row, col, k, sign, {", ".join(f"{x} + CASE WHEN k = {i} THEN sign * {r} ELSE 0.0 END AS a{i}" for i, (x, r) in enumerate(zip(_INPUTS, _ROOTS, strict=True)))} FROM t, s),
  c AS (SELECT frame, row, col, k, a1 * a5 - a2 * a4 AS x, a2 * a3 - a0 * a5 AS y, a0 * a4 - a1 * a3 AS z FROM a),
  n AS (SELECT frame, row, col, k, x / nullif(sqrt(x * x + y * y + z * z), 0) AS x, y / nullif(sqrt(x * x + y * y + z * z), 0) AS y, z / nullif(sqrt(x * x + y * y + z * z), 0) AS z FROM c),
  d AS (SELECT n.frame, n.row, n.col, n.x - b.x AS x, n.y - b.y AS y, n.z - b.z AS z FROM n JOIN n b ON b.frame = n.frame AND b.row = n.row AND b.col = n.col AND b.k = -1 WHERE n.k >= 0)
  SELECT frame, row, col, {", ".join(f"round(CASE WHEN count(*) = count(x) THEN sum({p} * {q}) / 12 END, 6) + 0 AS c{p}{q}" for p, q in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM d GROUP BY frame, row, col""")
def normal_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of pixels' normals by twelve sigma points, from the neighbours to the right and above."""
    p = pixels(spark, sf_dir).where("dist is not null")
    right = p.select("frame", "row", (F.col("col") - 1).alias("col"), F.col("dist").alias("h"))
    above = p.select("frame", (F.col("row") + 1).alias("row"), "col", F.col("dist").alias("v"))
    c = noise.normal_covariance(F.col("dist"), F.col("h"), F.col("v"))
    cells = {"xx": (0, 0), "xy": (0, 1), "xz": (0, 2), "yy": (1, 1), "yz": (1, 2), "zz": (2, 2)}
    return p.join(right, ["frame", "row", "col"]).join(above, ["frame", "row", "col"]).select("frame", "row", "col", *[(F.round(c[i][j], 6) + 0).alias("c" + k) for k, (i, j) in cells.items()])
