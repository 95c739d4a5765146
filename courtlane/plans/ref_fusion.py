"""Reference queries: fusion joins, gap filling and derivatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlane.operators import fusion as U
from courtlane.plans.ref_vetoes import CUT, DUALS, dual_motion
from courtlane.plans.views import MEASURED, Registry, phases, quoted, r6, r6_sql, track

add = Registry()

_D = lambda ax, ay, bx, by: f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"
_AT = lambda flag, src="p": f"max(CASE WHEN {flag} THEN frame END) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf, min(CASE WHEN {flag} THEN frame END) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rf"
_OFF = lambda x, y: _D(x, y, "(lx + (frame - lf) / (rf - lf) * (rx - lx))", "(ly + (frame - lf) / (rf - lf) * (ry - ly))")

MERGE_SQL = f"""g0 AS (SELECT *, coalesce(a_vis AND b_vis AND {_D('a_x', 'a_y', 'b_x', 'b_y')} <= 25, false) AS same FROM phases),
g1 AS (SELECT *, {_AT('same')} FROM g0),
g2 AS (SELECT g1.*, l.a_x AS lx, l.a_y AS ly, r.a_x AS rx, r.a_y AS ry FROM g1 LEFT JOIN phases l ON l.match_id = g1.match_id AND l.frame = lf LEFT JOIN phases r ON r.match_id = g1.match_id AND r.frame = rf),
g3 AS (SELECT *, frame - row_number() OVER (PARTITION BY match_id ORDER BY frame) AS g, CASE WHEN frame - lf <= 6 AND rf - frame <= 6 AND a_vis THEN {_OFF('a_x', 'a_y')} END AS oa, CASE WHEN frame - lf <= 6 AND rf - frame <= 6 AND b_vis THEN {_OFF('b_x', 'b_y')} END AS ob FROM g2 WHERE NOT same AND (a_vis OR b_vis)),
g4 AS (SELECT *, avg(oa) OVER (PARTITION BY match_id, g) AS ra, avg(ob) OVER (PARTITION BY match_id, g) AS rb FROM g3),
g5 AS (SELECT match_id, frame, CASE WHEN a_vis AND b_vis THEN CASE WHEN ra IS NULL OR rb IS NULL THEN 'none' WHEN ra + 15 <= rb AND ra <= 110 THEN 'primary' WHEN rb + 15 <= ra AND rb <= 110 THEN 'secondary' ELSE 'none' END
  WHEN a_vis THEN CASE WHEN coalesce(ra <= 165, true) THEN 'primary' ELSE 'none' END ELSE CASE WHEN coalesce(rb <= 165, true) THEN 'secondary' ELSE 'none' END END AS choice FROM g4),
g6 AS (SELECT g0.*, CASE WHEN same THEN 'agree' ELSE coalesce(choice, 'none') END AS choice FROM g0 LEFT JOIN g5 USING (match_id, frame)),
g7 AS (SELECT *, choice IN ('agree', 'primary') AS one, choice = 'secondary' AS two, CASE WHEN choice IN ('agree', 'primary') THEN a_conf WHEN choice = 'secondary' THEN b_conf END AS c FROM g6)"""


@add("phases", MERGE_SQL, "SELECT match_id, frame, one OR two AS vis, CASE WHEN one THEN a_x WHEN two THEN b_x END AS x, CASE WHEN one THEN a_y WHEN two THEN b_y END AS y, CASE WHEN choice = 'none' THEN 'missing' WHEN choice <> 'agree' AND c <= 0.22 THEN 'single_phase_edge' WHEN c <= 0.35 THEN 'model_edge' WHEN one THEN a_source ELSE b_source END AS label, choice FROM g7")
def d01_merge_phases(spark, sf):
    return U.merge_phases(phases(spark, sf))


_MERGED = MERGE_SQL + ", merged AS (SELECT match_id, frame, one OR two AS vis, CASE WHEN one THEN a_x WHEN two THEN b_x END AS x, CASE WHEN one THEN a_y WHEN two THEN b_y END AS y, CASE WHEN choice = 'none' THEN 'missing' WHEN choice <> 'agree' AND c <= 0.22 THEN 'single_phase_edge' WHEN c <= 0.35 THEN 'model_edge' WHEN one THEN a_source ELSE b_source END AS label FROM g7), "
_DUAL_OUT = "SELECT match_id, start_frame, end_frame, " + r6_sql("path_px", "step_px", "spread_px", "delta_px") + " FROM dual"


@add("phases hits", _MERGED + DUALS(12, 80, 35, 10), _DUAL_OUT)
def c18_coherent_dual_motion(spark, sf):
    return dual_motion(spark, sf, U.merge_phases)


@add("phases hits", _MERGED + DUALS(3, 10, 5, 1), _DUAL_OUT)
def c18_slow_dual_motion(spark, sf):
    """With wider limits (3, 10, 5 and 1 px), as the made-up flights are slower."""
    return dual_motion(spark, sf, U.merge_phases, median_step=3, path=10, spread=5, support=1)


def _two_detectors(spark, sf):
    t = track(spark, sf)
    of = lambda s, v, x, y, p: t.where(F.col(v) & F.col(s).isin("model") if p == "a" else F.col(v) & F.col(s).isin("classical", "interp")).select("match_id", "frame", F.lit(True).alias(f"{p}_vis"), F.col(x).alias(f"{p}_x"), (F.col(y) + (F.col("frame") % 7) * 6).alias(f"{p}_y"))
    both = of("source", "vis", "x", "y", "a").join(of("source", "vis", "x", "y", "b").unionByName(t.where("vis and source = 'model' and frame % 3 = 0").select("match_id", "frame", F.lit(True).alias("b_vis"), F.col("x").alias("b_x"), (F.col("y") + F.col("frame") % 5 * 6).alias("b_y"))), ["match_id", "frame"], "full_outer")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("a_vis", "b_vis")})


_TWO = f"""a AS (SELECT match_id, frame, x AS a_x, y + (frame % 7) * 6 AS a_y FROM track WHERE vis AND source = 'model'),
b AS (SELECT match_id, frame, x AS b_x, y + (frame % 7) * 6 AS b_y FROM track WHERE vis AND source IN ('classical', 'interp') UNION ALL SELECT match_id, frame, x, y + (frame % 5) * 6 FROM track WHERE vis AND source = 'model' AND frame % 3 = 0),
p AS (SELECT match_id, frame, a_x, a_y, b_x, b_y, a_x IS NOT NULL AS a_vis, b_x IS NOT NULL AS b_vis FROM a FULL JOIN b USING (match_id, frame)),
e0 AS (SELECT *, coalesce({_D('a_x', 'a_y', 'b_x', 'b_y')} <= 20, false) AS same FROM p),
e1 AS (SELECT *, {_AT('same')} FROM e0),
e2 AS (SELECT e1.*, l.a_x AS lx, l.a_y AS ly, r.a_x AS rx, r.a_y AS ry FROM e1 LEFT JOIN p l ON l.match_id = e1.match_id AND l.frame = lf LEFT JOIN p r ON r.match_id = e1.match_id AND r.frame = rf),
e3 AS (SELECT *, {_OFF('a_x', 'a_y')} AS rm, {_OFF('b_x', 'b_y')} AS rc FROM e2),
e4 AS (SELECT *, CASE WHEN a_vis AND b_vis AND NOT same AND coalesce(rc <= 28 AND rm >= greatest(60, 4 * rc), false) THEN 'classical' WHEN a_vis THEN 'model' WHEN b_vis THEN 'classical' ELSE 'missing' END AS chosen FROM e3)"""


@add("track", _TWO, "SELECT match_id, frame, CASE chosen WHEN 'model' THEN a_x WHEN 'classical' THEN b_x END AS x, CASE chosen WHEN 'model' THEN a_y WHEN 'classical' THEN b_y END AS y, chosen FROM e4")
def d02_merge_classical(spark, sf):
    """The second detector is made from the track: its classical and interpolated points, and every third model point shifted."""
    return U.merge_classical(_two_detectors(spark, sf))


_CUTS = lambda f: (f > 0) & (f % 1500 == 0)
_FILL = f"""c0 AS (SELECT match_id, frame, x, y, conf, frame - row_number() OVER (PARTITION BY match_id ORDER BY frame) AS g FROM ball WHERE phase = 'secondary' AND vis),
c1 AS (SELECT *, count(*) OVER (PARTITION BY match_id, g) AS n, min(frame) OVER (PARTITION BY match_id, g) AS tr FROM (SELECT c0.*, min(frame) OVER (PARTITION BY match_id, g) AS first FROM c0) WHERE conf >= 0.45),
v AS (SELECT match_id, frame, x, y, source FROM track WHERE vis AND frame % 11 > 2),
f0 AS (SELECT match_id, lag(frame) OVER w AS lf, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lag(source) OVER w AS ls, frame AS rf, x AS rx, y AS ry, source AS rs FROM v WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
f1 AS (SELECT * FROM f0 WHERE rf - lf - 1 BETWEEN 1 AND 12 AND ls = 'model' AND rs = 'model' AND NOT ((lf + 1) % 1500 = 0 AND lf + 1 > 0) AND NOT (rf % 1500 = 0 AND rf > 0)),
f2 AS (SELECT f1.*, c1.frame, c1.x, c1.y, c1.conf, c1.first FROM f1 JOIN c1 ON c1.match_id = f1.match_id AND c1.frame > lf AND c1.frame < rf WHERE n >= 3)"""


@add("track ball", _FILL, f"SELECT match_id, frame, x, y, round(least(0.45, 0.65 * conf), 6) AS conf, first AS track_id FROM f2 WHERE {_OFF('x', 'y')} <= 72 AND {_D('x', 'y', 'lx', 'ly')} / (frame - lf) <= 180 AND {_D('x', 'y', 'rx', 'ry')} / (rf - frame) <= 180")
def d03_fill_gaps(spark, sf):
    """The track with three of eleven frames hidden, filled from the secondary phase, whose stretches of consecutive frames stand for classical tracks."""
    from courtlane.operators.sequence import runs
    from courtlane.plans.views import ball

    t = track(spark, sf).withColumn("vis", F.expr("vis and frame % 11 > 2"))
    c = runs(ball(spark, sf).where("phase = 'secondary' and vis").select("match_id", "frame", "x", "y", "conf"), F.lit(True)).withColumnRenamed("run", "track_id")
    return U.fill_gaps(t, c, _CUTS).withColumn("conf", F.round("conf", 6))


_BREAK = "(hole BETWEEN 2 AND 8 AND (((ly <= 35 OR y <= 35) AND abs(y - ly) >= 70) OR (ly <= 35 AND y <= 35) OR abs(y - ly) >= 80)) OR (hole = 1 AND abs(y - ly) >= 80)"
_INT = f"""n0 AS (SELECT match_id, frame AS rf, x AS rx, y, lag(frame) OVER w AS lf, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM track WHERE vis WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
n1 AS (SELECT *, y AS ry, unnest(range(lf + 1, rf)) AS frame FROM (SELECT *, rf - lf - 1 AS hole FROM n0) WHERE hole BETWEEN 1 AND 8 AND NOT ({_BREAK}))"""


@add("track", _INT, "SELECT match_id, frame, round(lx + (frame - lf) / (rf - lf) * (rx - lx), 6) AS x, round(ly + (frame - lf) / (rf - lf) * (ry - ly), 6) AS y FROM n1")
def f01_interpolate(spark, sf):
    """Holes that end a flight over the top (F2) stay open."""
    t = track(spark, sf)
    breaks = U.edge_breaks(t).select("match_id", F.col("start_frame").alias("frame"))
    return U.interpolate(t, breaks=breaks).select("match_id", "frame", *r6("x", "y"))


@add("track", "v AS (SELECT match_id, frame, y, lag(frame) OVER w AS lf, lag(y) OVER w AS ly FROM track WHERE vis WINDOW w AS (PARTITION BY match_id ORDER BY frame))", "SELECT match_id, lf + 1 AS start_frame, frame - 1 AS end_frame FROM v WHERE (frame - lf - 1 BETWEEN 2 AND 8 AND (((ly <= 35 OR y <= 35) AND abs(y - ly) >= 70) OR (ly <= 35 AND y <= 35) OR abs(y - ly) >= 80)) OR (frame - lf - 1 = 1 AND abs(y - ly) >= 80)")
def f02_edge_breaks(spark, sf):
    return U.edge_breaks(track(spark, sf))


_SEGS = f"sg AS (SELECT *, coalesce(max(CASE WHEN {CUT} THEN frame END) OVER (PARTITION BY match_id ORDER BY frame), -1) AS segment FROM track)"


@add("track", f"{_SEGS}, v AS (SELECT match_id, frame, segment, lag(frame) OVER w AS lf, lag(segment) OVER w AS ls FROM sg WHERE vis WINDOW w AS (PARTITION BY match_id ORDER BY frame))", "SELECT match_id, CAST(max(CASE WHEN ls = segment THEN frame - lf - 1 ELSE 0 END) AS BIGINT) AS longest_gap FROM v GROUP BY match_id")
def e03_longest_gap(spark, sf):
    return U.longest_gap(track(spark, sf), F.expr(CUT))


@add("track", _SEGS, "SELECT match_id, frame, segment FROM sg")
def f06_segment_ids(spark, sf):
    from courtlane.operators.sequence import segments

    return segments(track(spark, sf).select("match_id", "frame"), F.expr(CUT))


_W1 = "(PARTITION BY match_id ORDER BY frame RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
_W2 = "(PARTITION BY match_id ORDER BY frame RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)"
DERIV_SQL = f"""{_SEGS},
h0 AS (SELECT match_id, frame, segment, vis AND source IN ({quoted(MEASURED)}) AS measured, CASE WHEN vis AND source IN ({quoted(MEASURED)}) THEN x END AS x, CASE WHEN vis AND source IN ({quoted(MEASURED)}) THEN y END AS y FROM sg),
h1 AS (SELECT *, max(x) OVER a AS px, max(y) OVER a AS py, max(segment) OVER a AS ps, max(x) OVER b AS nx, max(y) OVER b AS ny, max(segment) OVER b AS ns FROM h0 WINDOW a AS {_W1}, b AS {_W2}),
h2 AS (SELECT match_id, frame, segment, measured, ps, ns, coalesce(x, CASE WHEN ps = segment AND ns = segment THEN (px + nx) / 2 END) AS x, coalesce(y, CASE WHEN ps = segment AND ns = segment THEN (py + ny) / 2 END) AS y FROM h1),
h3 AS (SELECT *, x - max(x) OVER a AS ax, y - max(y) OVER a AS ay, max(x) OVER b - x AS bx, max(y) OVER b - y AS by_ FROM h2 WINDOW a AS {_W1}, b AS {_W2}),
h4 AS (SELECT *, sqrt(ax * ax + ay * ay) AS s0, sqrt(bx * bx + by_ * by_) AS s1 FROM h3),
deriv AS (SELECT match_id, frame, segment, measured, x, y, coalesce(CASE WHEN ps = segment AND ns = segment THEN (s0 + s1) / 2 END, 0) AS speed, coalesce(CASE WHEN ps = segment AND ns = segment THEN sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) END, 0) AS curvature,
 coalesce(CASE WHEN ps = segment AND ns = segment AND ax IS NOT NULL AND bx IS NOT NULL THEN CASE WHEN s0 > 1e-3 AND s1 > 1e-3 THEN greatest(0, -(ax * bx + ay * by_) / (s0 * s1)) ELSE 0 END END, 0) AS reversal FROM h4)"""


@add("track", DERIV_SQL, f"SELECT match_id, frame, {r6_sql('speed', 'curvature', 'reversal')} FROM deriv")
def f05_derivatives(spark, sf):
    return U.derivatives(track(spark, sf), F.expr(CUT), MEASURED).select("match_id", "frame", *r6("speed", "curvature", "reversal"))
