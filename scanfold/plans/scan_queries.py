"""Queries over range images and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions.soft import lin_sat, mlog, soft_threshold
from scanfold.operators import image, links, segments, tracks

from scanfold.runs import dealt
from scanfold.stored import stored

from .registry import query, rounded
from .views import HITS, PIXELS, SCAN, hits, pixels, scan

ROW = "PARTITION BY frame ORDER BY col"


@query(f"WITH {SCAN} SELECT frame, col, CASE WHEN dist <= 25 THEN round(dist, 6) END AS dist FROM scan")
def scan_far_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(image.far_filter(scan(spark, sf_dir), 25.0), "dist")


@query(f"WITH {SCAN} SELECT frame, col, CASE WHEN col > 15 AND col <= 45 THEN round(dist, 6) END AS dist FROM scan")
def scan_edge_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(image.edge_mask(scan(spark, sf_dir), 15, 60), "dist")


GAP = """f AS (SELECT *, last_value(dist IGNORE NULLS) OVER b AS d0, last_value(CASE WHEN dist IS NOT NULL THEN {a} END IGNORE NULLS) OVER b AS c0,
    first_value(dist IGNORE NULLS) OVER n AS d1, first_value(CASE WHEN dist IS NOT NULL THEN {a} END IGNORE NULLS) OVER n AS c1 FROM {t}
    WINDOW b AS (PARTITION BY {p} ORDER BY {a} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY {p} ORDER BY {a} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  g AS (SELECT * EXCLUDE (dist), coalesce(dist, CASE WHEN c1 - c0 - 1 > 0 AND c1 - c0 - 1 < {n} AND (d1 - d0) / (c1 - c0 - 1) <= {s} THEN d0 + (d1 - d0) / (c1 - c0 - 1) * ({a} - c0) END) AS dist FROM f)"""


@query(f"WITH {SCAN}, {GAP.format(t='scan', p='frame', a='col', n=5, s=0.5)} SELECT frame, col, round(dist, 6) AS dist FROM g")
def scan_gapfill_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(image.fill_gaps(scan(spark, sf_dir), 5, 0.5), "dist")


@query(f"WITH {PIXELS}, {GAP.format(t='pixels', p='frame, col', a='row', n=2, s=2.0)} SELECT frame, row, col, round(dist, 6) AS dist FROM g")
def image_gapfill_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(image.fill_gaps(pixels(spark, sf_dir), 2, 2.0, "row").select("frame", "row", "col", "dist"), "dist")


@query(f"""WITH {SCAN}, l AS (SELECT *, list_filter([lag(dist) OVER w, lead(dist) OVER w], lambda d: abs(d - dist) < 8) AS n FROM scan WINDOW w AS ({ROW}))
  SELECT frame, col, round(CASE WHEN dist IS NOT NULL THEN (dist + coalesce(list_sum(n), 0)) / (len(n) + 1) END, 6) AS dist FROM l""")
def scan_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(image.smooth(scan(spark, sf_dir), 8.0), "dist")


@query(f"WITH {SCAN} SELECT frame, col, round(dist - lead(dist) OVER ({ROW}), 6) AS d FROM scan")
def scan_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(image.derivative(scan(spark, sf_dir)).select("frame", "col", "d"), "d")


@query(f"WITH {PIXELS} SELECT frame, row, col, round(dist - lead(dist) OVER (PARTITION BY frame, col ORDER BY row), 6) AS d FROM pixels")
def image_derivative_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(image.derivative(pixels(spark, sf_dir), "row").select("frame", "row", "col", "d"), "d")


@query(f"WITH {SCAN} SELECT frame, col, round(dist - lag(dist) OVER (PARTITION BY col ORDER BY frame), 6) AS change FROM scan")
def scan_frame_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(image.frame_difference(scan(spark, sf_dir)).select("frame", "col", "change"), "change")


@query(f"""WITH {SCAN}, l AS (SELECT *, list_sort(list_filter([lag(dist) OVER w, dist, lead(dist) OVER w], lambda d: d IS NOT NULL)) AS v FROM scan WINDOW w AS ({ROW}))
  SELECT frame, col, round(CASE WHEN dist IS NOT NULL THEN v[len(v) // 2 + 1] END, 6) AS median FROM l""")
def scan_median_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(image.median4(scan(spark, sf_dir)).select("frame", "col", "median"), "median")


@query(f"""WITH {PIXELS}, l AS (SELECT *, list_sort(list_filter([dist, lag(dist) OVER h, lead(dist) OVER h, lag(dist) OVER v, lead(dist) OVER v], lambda d: d IS NOT NULL)) AS m FROM pixels
    WINDOW h AS (PARTITION BY frame, row ORDER BY col), v AS (PARTITION BY frame, col ORDER BY row))
  SELECT frame, row, col, CASE WHEN dist IS NOT NULL THEN m[len(m) // 2 + 1] END AS median FROM l""")
def image_median_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.median4(pixels(spark, sf_dir)).select("frame", "row", "col", "median")


def _soft(x: str, t: str, k: str) -> str:
    return f"(0.5 - 0.5 * (({x}) - {t}) * ({k}) / sqrt(1 + (({x}) - {t}) * ({k}) * (({x}) - {t}) * ({k})))"


@query(f"WITH {SCAN} SELECT frame, col, round({_soft('dist', '20.0', '0.5')}, 6) AS soft, round(ln(greatest(1.0, 1 + (dist - 10))), 6) AS mlog, round(least(greatest((dist - 5.0) / 25.0, 0.0), 1.0), 6) AS sat FROM scan")
def soft_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("dist")
    s = scan(spark, sf_dir).select("frame", "col", soft_threshold(d, 20.0, 0.5).alias("soft"), mlog(d - 10).alias("mlog"), F.when(d.isNotNull(), lin_sat(d, 5.0, 30.0)).otherwise(F.lit(0.0)).alias("sat"))
    return rounded(s, "soft", "mlog", "sat")


@query(f"""WITH {SCAN}, l AS (SELECT frame, col, dist AS d1, lead(dist) OVER w AS d2, lag(dist) OVER w - dist AS dl, lead(dist) OVER w - lead(dist, 2) OVER w AS dr FROM scan WINDOW w AS ({ROW})),
  m AS (SELECT *, d1 - d2 AS dd, least(d1, d2) AS m, 1.0 - 1.0 * exp(-least(d1, d2) * 0.02) AS f FROM l)
  SELECT frame, col, round(CASE WHEN d1 IS NULL OR d2 IS NULL OR abs(d1) < 0.01 OR abs(d2) < 0.01 THEN 0.0 WHEN abs(dd) < 0.2 THEN 1.0
    WHEN dl IS NULL OR dr IS NULL OR abs(dl) < 0.01 OR abs(dr) < 0.01 THEN 0.0
    ELSE least({_soft('abs(dd) / m', '0.2', '10.0')}, {_soft('abs((dd - dl) / dl)', '0.1', 'f')}, {_soft('abs((dd - dr) / dr)', '0.1', 'f')}) END, 6) AS weight FROM m""")
def connectivity_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(image.connections(scan(spark, sf_dir)).select("frame", "col", "weight"), "weight")


def _clamped(o: str) -> str:
    return f"coalesce(least(greatest({o} - dist, -5.0), 5.0), 5.0)"


@query(f"""WITH {PIXELS}, l AS (SELECT *, lag(dist) OVER h AS a, lead(dist, 2) OVER h AS b, lag(dist) OVER v AS c, lead(dist, 2) OVER v AS e FROM pixels
    WINDOW h AS (PARTITION BY frame, row ORDER BY col), v AS (PARTITION BY frame, col ORDER BY row))
  SELECT frame, row, col, CASE WHEN a IS NULL OR dist IS NULL THEN 5.0 ELSE {_clamped('a')} END AS col_before, CASE WHEN b IS NULL OR dist IS NULL THEN 5.0 ELSE {_clamped('b')} END AS col_after,
    CASE WHEN c IS NULL OR dist IS NULL THEN 5.0 ELSE {_clamped('c')} END AS row_before, CASE WHEN e IS NULL OR dist IS NULL THEN 5.0 ELSE {_clamped('e')} END AS row_after FROM l""")
def match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.match_features(pixels(spark, sf_dir)).drop("dist")


def _gaps(source: str, out: str, part: str, axis: str, pixels: int) -> str:
    return GAP.format(t=source, p=part, a=axis, n=pixels, s=0.2).replace("f AS (", f"{out}_f AS (", 1).replace("\n  g AS (", f"\n  {out} AS (").replace("FROM f)", f"FROM {out}_f)").replace("EXCLUDE (dist)", "EXCLUDE (dist, d0, c0, d1, c1)")


@query(f"""WITH {PIXELS}, far AS (SELECT frame, row, col, CASE WHEN dist <= 50 THEN dist END AS dist FROM pixels), {_gaps("far", "h", "frame, row", "col", 5)}, {_gaps("h", "v", "frame, col", "row", 2)},
  n AS (SELECT *, list_filter([lag(dist) OVER r, lead(dist) OVER r, lag(dist) OVER c, lead(dist) OVER c], lambda d: abs(d - dist) < 0.5) AS n FROM v WINDOW r AS (PARTITION BY frame, row ORDER BY col), c AS (PARTITION BY frame, col ORDER BY row))
  SELECT frame, row, col, round(CASE WHEN dist IS NOT NULL THEN (dist + coalesce(list_sum(n), 0)) / (len(n) + 1) END, 6) AS dist FROM n""")
def preprocessed_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far filter, gaps along rows and then columns, and the mean over four neighbours."""
    return rounded(image.preprocess(pixels(spark, sf_dir)).select("frame", "row", "col", "dist"), "dist")


@query(f"WITH {PIXELS} SELECT frame, row, col, dist FROM pixels WHERE dist IS NOT NULL")
def valid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).where("dist is not null")


SEGMENTS = f"""WITH RECURSIVE {PIXELS}, px AS (SELECT frame, row, col, dist, row * 100000 + col AS k FROM pixels WHERE dist IS NOT NULL),
  e AS (SELECT a.frame, a.k AS a, b.k AS b FROM px a JOIN px b ON a.frame = b.frame AND (b.k = a.k + 1 OR b.k = a.k + 100000) WHERE abs(a.dist - b.dist) < 2),
  both_e AS (SELECT frame, a, b FROM e UNION ALL SELECT frame, b, a FROM e),
  r AS (SELECT frame, k, k AS s FROM px UNION SELECT r.frame, x.b, r.s FROM r JOIN both_e x ON r.frame = x.frame AND r.k = x.a WHERE r.s < x.b),
  lab AS (SELECT frame, k, min(s) AS segment FROM r GROUP BY frame, k)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of pixels, written and dealt by frame."""
    return dealt(stored(segments.segment_frames(pixels(spark, sf_dir), 2.0)), "frame")


@query(f"{SEGMENTS} SELECT frame, CAST(k // 100000 AS INTEGER) AS row, CAST(k % 100000 AS INTEGER) AS col, CAST(segment AS BIGINT) AS segment FROM lab")
def segment_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_frames(pixels(spark, sf_dir), 2.0).drop("dist")


@query(f"""{SEGMENTS}, j AS (SELECT lab.*, px.dist FROM lab JOIN px USING (frame, k)) SELECT frame, CAST(segment AS BIGINT) AS segment, count(*) AS n, round(avg(k // 100000), 6) AS mrow, round(avg(k % 100000), 6) AS mcol, round(avg(dist), 6) AS mdist
  FROM j GROUP BY ALL HAVING count(*) >= 3""")
def segment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segments.segment_stats(segments.segment_frames(pixels(spark, sf_dir), 2.0), 3), "mrow", "mcol", "mdist")


@query(f"""{SEGMENTS}, j AS (SELECT lab.*, px.dist FROM lab JOIN px USING (frame, k))
  SELECT a.frame, CAST(least(a.segment, b.segment) AS BIGINT) AS a, CAST(greatest(a.segment, b.segment) AS BIGINT) AS b, min(abs(a.dist - b.dist)) AS nearest FROM j a JOIN j b ON a.frame = b.frame AND (b.k = a.k + 1 OR b.k = a.k + 100000) AND a.segment <> b.segment GROUP BY ALL""")
def segment_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_neighbours(_labelled(spark, sf_dir))


@query(f"WITH {HITS} SELECT src, dst, count(*) AS strength FROM hits GROUP BY src, dst")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.count_links(hits(spark, sf_dir))


@query(f"""WITH {HITS}, l AS (SELECT src, dst, count(*) AS strength FROM hits WHERE day <= 10 GROUP BY ALL UNION ALL SELECT src, dst, count(*) FROM hits WHERE day BETWEEN 11 AND 20 GROUP BY ALL)
  SELECT src, dst, CAST(sum(strength) AS BIGINT) AS strength FROM l WHERE dst IN (SELECT DISTINCT dst FROM hits WHERE day > 20) GROUP BY src, dst""")
def links_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    return links.merge_links([links.count_links(h.where("day <= 10")), links.count_links(h.where("day between 11 and 20"))], h.where("day > 20").select("dst"))


@query(f"WITH {HITS}, l AS (SELECT src, dst, count(*) AS strength FROM hits GROUP BY ALL) SELECT src, dst, strength FROM l QUALIFY row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst DESC) = 1")
def links_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.best_link(links.count_links(hits(spark, sf_dir)))


@query(f"WITH {HITS}, l AS (SELECT src, dst, count(*) AS strength FROM hits GROUP BY ALL) SELECT src, dst, strength FROM l QUALIFY row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst) = 1")
def links_top1_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.best_link(links.count_links(hits(spark, sf_dir)), last=False)


@query(f"""WITH {HITS}, a AS (SELECT src, dst, count(*) AS before FROM hits WHERE day <= 15 GROUP BY ALL), b AS (SELECT src, dst, count(*) AS after FROM hits WHERE day > 15 GROUP BY ALL)
  SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, before, after FROM a FULL OUTER JOIN b ON a.src = b.src AND a.dst = b.dst""")
def segment_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    return links.full_match(links.count_links(h.where("day <= 15")), links.count_links(h.where("day > 15")))


@query(f"WITH {HITS} SELECT a.src, b.dst, CAST(count(*) AS BIGINT) AS strength FROM hits a JOIN hits b ON a.src = b.src AND b.day = a.day + 1 GROUP BY a.src, b.dst")
def pixel_colocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's hits against the next day's on the same pixel."""
    h = hits(spark, sf_dir)
    a, b = h.select("src", "day", F.col("src").alias("pixel")), h.select("dst", (F.col("day") - 1).alias("day"), F.col("src").alias("pixel"))
    return links.colocated(a, b, ["pixel", "day"])


@query(f"""WITH {HITS}, l AS (SELECT src, dst, count(*) AS strength FROM hits GROUP BY ALL)
  SELECT 0 AS part, '' AS key, '<graphml><graph edgedefault="directed">' AS line UNION ALL SELECT 4, '', '</graph></graphml>'
  UNION ALL SELECT DISTINCT 1, CAST(src AS VARCHAR), '<node id="s' || src || '"/>' FROM l UNION ALL SELECT DISTINCT 2, CAST(dst AS VARCHAR), '<node id="d' || dst || '"/>' FROM l
  UNION ALL SELECT 3, src || '|' || dst, '<edge source="s' || src || '" target="d' || dst || '"><data key="weight">' || strength || '</data></edge>' FROM l""")
def link_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.to_graphml(links.count_links(hits(spark, sf_dir)))


@query(f"WITH {SCAN} SELECT frame, col, CAST(k AS INTEGER) AS k, floor(k * 0.3) <> floor((k - 1) * 0.3) AS taken FROM (SELECT frame, col, row_number() OVER (PARTITION BY frame ORDER BY col) AS k FROM scan WHERE dist IS NOT NULL)")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.systematic(scan(spark, sf_dir).where("dist is not null"), 0.3, "col", "frame").select("frame", "col", "k", "taken")


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanfold.operators import surface

    rows = image.connections(image.connections(pixels(spark, sf_dir), "col", "wh"), "row", "wv")
    return surface.normals(surface.image_to_points(rows, 360, -0.2, 0.05))


def _connected(source: str, out: str, name: str, part: str, axis: str) -> str:
    w = f"(PARTITION BY {part} ORDER BY {axis})"
    soft = [_soft(x, at, slope) for x, at, slope in (("abs(dd) / m", "0.2", "10.0"), ("abs((dd - dl) / dl)", "0.1", "f"), ("abs((dd - dr) / dr)", "0.1", "f"))]
    return f"""{out}_l AS (SELECT *, dist AS d1, lead(dist) OVER w AS d2, lag(dist) OVER w - dist AS dl, lead(dist) OVER w - lead(dist, 2) OVER w AS dr FROM {source} WINDOW w AS {w}),
  {out}_m AS (SELECT *, d1 - d2 AS dd, least(d1, d2) AS m, 1.0 - 1.0 * exp(-least(d1, d2) * 0.02) AS f FROM {out}_l),
  {out} AS (SELECT * EXCLUDE (d1, d2, dl, dr, dd, m, f), CASE WHEN d1 IS NULL OR d2 IS NULL OR abs(d1) < 0.01 OR abs(d2) < 0.01 THEN 0.0 WHEN abs(dd) < 0.2 THEN 1.0 WHEN dl IS NULL OR dr IS NULL OR abs(dl) < 0.01 OR abs(dr) < 0.01 THEN 0.0
    ELSE least({", ".join(soft)}) END AS {name} FROM {out}_m)"""


_BOTH = ("(PARTITION BY frame, row ORDER BY col)", "(PARTITION BY frame, col ORDER BY row)")
_YAW = f"(pi() - (col + 0.5) * (2 * pi() / 360))"
#: Each side of a pixel: its window, the function that reaches it, and the weight of its connection.
_SIDES = {"right": ("h", "lead", "wh"), "up": ("v", "lag", "lag(wv) OVER v"), "left": ("h", "lag", "lag(wh) OVER h"), "down": ("v", "lead", "wv")}


def _normals_sql() -> str:
    cols = []
    for side, (w, f, weight) in _SIDES.items():
        size = "sqrt(" + " + ".join(f"({f}({c}) OVER {w} - {c}) ** 2" for c in "xyz") + ")"
        cols += [f"coalesce(({f}({c}) OVER {w} - {c}) / nullif({size}, 0), 0.0) AS {side}_{c}" for c in "xyz"]
        cols.append(f"CASE WHEN {f}(dist) OVER {w} IS NULL THEN 0.0 WHEN {f}(dist) OVER {w} > dist + 0.03 THEN 2.0 ELSE coalesce({weight}, 0.0) END AS {side}_w")
    names = list(_SIDES)
    pairs = list(zip(names, [*names[1:], names[0]], strict=True))
    product = lambda a, b: f"{a}_w * {b}_w"
    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    sums = [f"{' + '.join(f'{product(a, b)} * ({a}_{p} * {b}_{q} - {a}_{q} * {b}_{p})' for a, b in pairs)} AS s{c}" for c, (p, q) in cross.items()]
    planar = []
    for w in "hv":
        terms = []
        for f in ("lag", "lead"):
            off = [f"({f}({c}) OVER {w} - {c})" for c in "xyz"]
            sine = f"abs({' + '.join(f'{o} * n{c}' for o, c in zip(off, 'xyz', strict=True))}) / nullif(sqrt({' + '.join(f'{o} ** 2' for o in off)}), 0)"
            terms.append(f"exp(-0.5 * (asin(CASE WHEN {sine} > 1 THEN 1.0 ELSE {sine} END) / 0.2) ** 2)")
        planar.append(f"coalesce({terms[0]} * {terms[1]}, 0.0)")
    windows = f"WINDOW h AS {_BOTH[0]}, v AS {_BOTH[1]}"
    return f"""WITH {PIXELS}, {_connected("pixels", "ch", "wh", "frame, row", "col")}, {_connected("ch", "cv", "wv", "frame, col", "row")},
  p AS (SELECT *, dist * cos(-0.2 + row * 0.05) * cos({_YAW}) AS x, dist * cos(-0.2 + row * 0.05) * sin({_YAW}) AS y, -dist * sin(-0.2 + row * 0.05) AS z FROM cv),
  o AS (SELECT frame, row, col, dist, x, y, z, {", ".join(cols)} FROM p {windows}),
  t AS (SELECT *, {" + ".join(product(a, b) for a, b in pairs)} AS sw, greatest({", ".join(product(a, b) for a, b in pairs)}) AS weight, {", ".join(sums)} FROM o),
  n AS (SELECT frame, row, col, dist, x, y, z, weight, {", ".join(f"CASE WHEN sw >= 0.01 AND sqrt(sx * sx + sy * sy + sz * sz) >= 0.01 AND dist IS NOT NULL THEN CASE WHEN sx * x + sy * y + sz * z > 0 THEN -1.0 ELSE 1.0 END * s{c} / sqrt(sx * sx + sy * sy + sz * sz) END AS n{c}" for c in "xyz")} FROM t),
  c AS (SELECT *, {planar[0]} AS ph, {planar[1]} AS pv FROM n {windows})
  SELECT frame, row, col, {", ".join(f"round(n{c}, 5) + 0 AS n{c}" for c in "xyz")}, round(CASE WHEN nx IS NOT NULL THEN least(1.0, weight, greatest(ph, pv)) ELSE 0.0 END, 5) AS conf FROM c"""


@query(_normals_sql())
def normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals and their confidence at every return."""
    from scanfold.operators import surface

    n = rounded(surface.normal_confidence(_surfaces(spark, sf_dir)).select("frame", "row", "col", "nx", "ny", "nz", "conf"), "nx", "ny", "nz", "conf", digits=5)
    return n.withColumns({c: F.col(c) + 0 for c in ("nx", "ny", "nz")})


_LEAST = lambda a, b: f"least(coalesce({a}, 0.0), coalesce({b}, 0.0))"


@query(f"""WITH {PIXELS}, {_connected("pixels", "ch", "sh", "frame, row", "col")}, {_connected("ch", "cv", "sv", "frame, col", "row")},
  e AS (SELECT *, lead(sv) OVER h AS vn, lead(sh) OVER v AS hb, lag(sh) OVER v AS hu, lag(sv) OVER v AS vu, lag(sv) OVER h AS vl, lag(sh) OVER h AS hl FROM cv WINDOW h AS {_BOTH[0]}, v AS {_BOTH[1]})
  SELECT frame, row, col, round(least(sh, greatest({_LEAST("sv", "hb")}, {_LEAST("vn", "hb")}, {_LEAST("vu", "hu")}, {_LEAST("hu", "vn")})), 6) AS sh,
    round(least(sv, greatest({_LEAST("sh", "vn")}, {_LEAST("hb", "vn")}, {_LEAST("hl", "vl")}, {_LEAST("vl", "hb")})), 6) AS sv FROM e""")
def reinforced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanfold.operators import surface

    rows = image.connections(image.connections(pixels(spark, sf_dir), "col", "sh"), "row", "sv")
    return rounded(surface.reinforced(rows).select("frame", "row", "col", "sh", "sv"), "sh", "sv")


LEAST_SCORE = 0.4


@query(f"""WITH RECURSIVE {PIXELS}, {_connected("pixels", "ch", "sh", "frame, row", "col")}, {_connected("ch", "cv", "sv", "frame, col", "row")},
  px AS (SELECT frame, row, col, dist, sh, sv, row * 100000 + col AS k FROM cv WHERE dist IS NOT NULL),
  e AS (SELECT a.frame, a.k AS a, b.k AS b FROM px a JOIN px b ON a.frame = b.frame AND ((b.k = a.k + 1 AND a.sh > {LEAST_SCORE}) OR (b.k = a.k + 100000 AND a.sv > {LEAST_SCORE}))),
  both_e AS (SELECT frame, a, b FROM e UNION ALL SELECT frame, b, a FROM e), r AS (SELECT frame, k, k AS s FROM px UNION SELECT r.frame, x.b, r.s FROM r JOIN both_e x ON r.frame = x.frame AND r.k = x.a WHERE r.s < x.b)
  SELECT frame, CAST(k // 100000 AS INTEGER) AS row, k % 100000 AS col, CAST(min(s) AS BIGINT) AS segment FROM r GROUP BY frame, k""")
def segments_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments over edges whose connection is strong enough, over all frames at once."""
    rows = image.connections(image.connections(pixels(spark, sf_dir), "col", "sh"), "row", "sv")
    return segments.segment_by_edges(rows, segments.scored_edges(rows, LEAST_SCORE)).select("frame", "row", "col", "segment")


NEAR_BORDER = 3.0


@query(f"""{SEGMENTS}, j AS (SELECT lab.frame, lab.k, lab.segment, px.dist FROM lab JOIN px USING (frame, k)),
  n AS (SELECT a.frame, a.segment AS a, b.segment AS b FROM j a JOIN j b ON a.frame = b.frame AND (b.k = a.k + 1 OR b.k = a.k + 100000) AND a.segment <> b.segment GROUP BY ALL HAVING min(abs(a.dist - b.dist)) < {NEAR_BORDER}),
  m AS (SELECT DISTINCT frame, least(a, b) AS a, greatest(a, b) AS b FROM n), mb AS (SELECT frame, a, b FROM m UNION ALL SELECT frame, b, a FROM m),
  t AS (SELECT DISTINCT frame, segment, segment AS s FROM lab UNION SELECT t.frame, x.b, t.s FROM t JOIN mb x ON t.frame = x.frame AND t.segment = x.a WHERE t.s < x.b),
  i AS (SELECT frame, segment, min(s) AS into_ FROM t GROUP BY ALL)
  SELECT frame, CAST(k // 100000 AS INTEGER) AS row, CAST(k % 100000 AS INTEGER) AS col, CAST(into_ AS BIGINT) AS segment FROM lab JOIN i USING (frame, segment)""")
def segments_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments joined with those that they touch at a small step."""
    lab = _labelled(spark, sf_dir)
    pairs = segments.segment_neighbours(lab).where(F.col("nearest") < NEAR_BORDER)
    return segments.merge_segments(lab, pairs, whole=True).drop("dist")


@query(f"""{SEGMENTS}, j AS (SELECT lab.frame, lab.k, lab.segment, px.dist FROM lab JOIN px USING (frame, k)),
  n AS (SELECT a.frame, CAST(least(a.segment, b.segment) AS BIGINT) AS a, CAST(greatest(a.segment, b.segment) AS BIGINT) AS b, 1 / (1 + abs(a.dist - b.dist)) AS s FROM j a JOIN j b ON a.frame = b.frame AND (b.k = a.k + 1 OR b.k = a.k + 100000) AND a.segment <> b.segment)
  SELECT frame, a, b, round(max(s), 6) AS score FROM n GROUP BY ALL""")
def segment_neighbour_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest score across the border of each pair of touching segments."""
    lab = _labelled(spark, sf_dir)
    return rounded(segments.segment_neighbour_scores(lab, lambda d: 1 / (1 + d)), "score")


DECIDE_W, DECIDE_B = (2.0, -0.5, 0.25), -0.4


@query(f"""WITH {HITS}, l AS (SELECT src, dst, count(*) AS strength FROM hits GROUP BY ALL), t AS (SELECT dst, count(*) AS points, count(DISTINCT src) AS age FROM hits GROUP BY dst),
  f AS (SELECT src, dst, strength, ln(greatest(1.0, 1 + strength)) AS f1, ln(greatest(1.0, 1 + points)) AS f2, ln(greatest(1.0, 1 + age)) AS f3 FROM l JOIN t USING (dst)),
  s AS (SELECT src, dst, strength, -0.4 + 2.0 * (f1 / 4.0) + -0.5 * (f2 / 10.0) + 0.25 * (f3 / 6.0) AS sc, count(*) OVER (PARTITION BY src) AS n FROM f),
  g AS (SELECT *, CASE WHEN n = 1 THEN greatest(sc, 1.0) ELSE sc END AS score FROM s)
  SELECT src, dst, round(score, 6) AS score, CASE WHEN score > 0 THEN 'merge' WHEN strength > 0 THEN 'keep' ELSE 'ignore' END AS decision FROM g QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) = 1""")
def merge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best link of each source by a linear score of logarithmic features."""
    from scanfold.operators import lifecycle

    h = hits(spark, sf_dir)
    t = h.groupBy("dst").agg(F.count("*").alias("points"), F.count_distinct("src").alias("age")).withColumns({k: F.lit(0.0) for k in ("speed",)})
    f = lifecycle.link_features(links.count_links(h).withColumns({"moved": F.lit(0.0), "error": F.lit(0.0)}), t)
    f = f.withColumn("f", F.slice("f", 1, 3))
    return rounded(lifecycle.decide(f, DECIDE_W, DECIDE_B, (0.0, 0.0, 0.0), (4.0, 10.0, 6.0)), "score")
