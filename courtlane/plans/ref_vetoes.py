"""Reference queries: predicates of the veto family."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlane.functions import geometry as G
from courtlane.operators import vetoes as V
from courtlane.plans.views import EDGE, Registry, hits, impulses, phases, poses, quoted, r6, track, with_info

add = Registry()
Q = [f"q{k}" for k in range(8)]
WIDE = G.expanded_quad(Q, 60, 20, 25)
#: There is no table of camera cuts; every 1500th frame stands for one.
CUT = "frame > 0 AND frame % 1500 = 0"
_KEEP = ("match_id", "frame", "vis", "x", "y", "source", "conf")


def _hide_sql(views, ctes, base, when, veto):
    g = f"(vis AND coalesce({when}, false))"
    return views, ctes, f"SELECT match_id, frame, vis AND NOT {g} AS vis, CASE WHEN NOT {g} THEN x END AS x, CASE WHEN NOT {g} THEN y END AS y, CASE WHEN {g} THEN '{veto}' ELSE source END AS source, CASE WHEN {g} THEN 0 ELSE conf END AS conf FROM {base}"


@add(*_hide_sql("track info", "", "track JOIN info USING (match_id)", f"NOT {G.in_quad('x', 'y', WIDE)} AND NOT (source IN ({quoted(EDGE)}) AND {G.edge_corridor('x', 'y', WIDE)})", "court_gate"))
def c01_court_gate(spark, sf):
    return V.court_gate(with_info(track(spark, sf).select(*_KEEP), spark, sf), WIDE, EDGE).select(*_KEEP)


@add("track info", f"c AS (SELECT match_id, min(frame) AS stop FROM track WHERE {CUT} GROUP BY match_id)", f"SELECT match_id, frame, vis AND coalesce(frame < stop, true) AND coalesce(x BETWEEN least(q0, q6) - 60 AND greatest(q2, q4) + 60, false) AS kept FROM track JOIN info USING (match_id) LEFT JOIN c USING (match_id)")
def c02_roi_until_first_cut(spark, sf):
    t = with_info(track(spark, sf).select("match_id", "frame", "vis", "x"), spark, sf)
    from courtlane.session import join_small

    t = join_small(t, t.where(CUT).groupBy("match_id").agg(F.min("frame").alias("stop")), ["match_id"])
    return t.select("match_id", "frame", F.expr("vis AND coalesce(frame < stop, true) AND coalesce(x BETWEEN least(q0, q6) - 60 AND greatest(q2, q4) + 60, false)").alias("kept"))


@add(*_hide_sql("track", f"n AS (SELECT *, max(CASE WHEN {CUT} THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM track)", "n", "near = 1", "scene_cut"))
def c03_near_cuts(spark, sf):
    return V.near_cuts(track(spark, sf).select(*_KEEP), F.expr(CUT), 3).select(*_KEEP)


_STILL = """p0 AS (SELECT match_id, frame, raw_x, raw_y, raw_vis AND raw_source = 'model' AS model, CASE WHEN raw_vis AND raw_source = 'classical' THEN 1 ELSE 0 END AS c FROM track),
p1 AS (SELECT match_id, frame, c, model, CASE WHEN model THEN raw_x END AS x, CASE WHEN model THEN raw_y END AS y FROM p0),
w AS (SELECT a.match_id, a.frame, count(b.x) AS n, max(b.c) AS c, median(b.x) AS mx, median(b.y) AS my FROM p1 a JOIN p1 b ON a.match_id = b.match_id AND b.frame BETWEEN a.frame AND a.frame + 19 GROUP BY 1, 2 HAVING count(b.x) >= 18 AND max(b.c) = 0),
s AS (SELECT w.match_id, w.frame FROM w JOIN p1 b ON w.match_id = b.match_id AND b.frame BETWEEN w.frame AND w.frame + 19 AND b.model GROUP BY 1, 2 HAVING max((b.x - mx) * (b.x - mx) + (b.y - my) * (b.y - my)) <= 64)"""


@add("track", _STILL, "SELECT DISTINCT p1.match_id, p1.frame FROM p1 JOIN s ON p1.match_id = s.match_id AND p1.frame BETWEEN s.frame AND s.frame + 19 WHERE p1.model")
def c04_static_windows(spark, sf):
    return V.static_windows(track(spark, sf))


_RE = f"""t0 AS (SELECT t.*, coalesce({G.in_quad('x', 'y', WIDE)}, false) AS inside FROM (SELECT match_id, frame, vis, x, y, source FROM track) t JOIN info USING (match_id)),
t1 AS (SELECT *, max(x) OVER o AS px, max(y) OVER o AS py, max(CASE WHEN vis AND y <= 60 THEN frame END) OVER b AS edge_at, min(CASE WHEN vis AND inside THEN frame END) OVER a AS inside_at FROM t0 WINDOW o AS (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
t2 AS (SELECT match_id, frame, frame - row_number() OVER (PARTITION BY match_id ORDER BY frame) AS g FROM t1 WHERE vis AND source = 'model' AND NOT inside AND y - py > 2 AND y - py <= 80 AND abs(x - px) <= 70 AND frame - edge_at <= 6 AND inside_at - frame <= 6)"""


@add("track info", _RE, "SELECT match_id, frame FROM t2 QUALIFY count(*) OVER (PARTITION BY match_id, g) >= 2")
def c09_edge_reentry(spark, sf):
    return V.edge_reentry(with_info(track(spark, sf).select("match_id", "frame", "vis", "x", "y", "source"), spark, sf), WIDE, 60.0)


@add("track poses", "", f"SELECT DISTINCT match_id, frame FROM track JOIN poses USING (match_id, frame) WHERE vis AND track.source = 'model' AND y > 35 AND x BETWEEN b0 - 400 AND b2 + 400 AND y BETWEEN b1 - 400 AND b3 + 400 AND {G.dist('x', 'y', 'kp[10].x', 'kp[10].y')} > 38 AND {G.dist('x', 'y', 'kp[11].x', 'kp[11].y')} > 38")
def c10_in_player_boxes(spark, sf):
    """The made-up boxes are small, so a margin of 400 px is used."""
    return V.in_player_box(track(spark, sf), poses(spark, sf), margin=400)


_ISO = """i0 AS (SELECT *, a_vis AND b_vis AS both_vis, CASE WHEN a_vis THEN a_x ELSE b_x END AS x, CASE WHEN a_vis THEN a_y ELSE b_y END AS y FROM phases),
i1 AS (SELECT *, max(CASE WHEN both_vis THEN frame END) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf, min(CASE WHEN both_vis THEN frame END) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rf FROM i0),
i2 AS (SELECT i1.*, l.a_x AS lx, l.a_y AS ly, r.a_x AS rx, r.a_y AS ry, (i1.frame - lf) / (rf - lf) AS t FROM i1 LEFT JOIN phases l ON l.match_id = i1.match_id AND l.frame = lf LEFT JOIN phases r ON r.match_id = i1.match_id AND r.frame = rf WHERE i1.a_vis <> i1.b_vis)"""


@add("phases", _ISO, "SELECT match_id, frame FROM i2 WHERE NOT (y <= 35 OR coalesce(frame - lf <= 5 AND rf - frame <= 5 AND sqrt((x - lx - t * (rx - lx)) * (x - lx - t * (rx - lx)) + (y - ly - t * (ry - ly)) * (y - ly - t * (ry - ly))) <= 110, false))")
def c11_isolated_phase(spark, sf):
    return V.isolated_phase(phases(spark, sf))


_TOP = f"""s0 AS (SELECT *, coalesce(max(CASE WHEN {CUT} THEN frame END) OVER (PARTITION BY match_id ORDER BY frame), -1) AS seg, max(CASE WHEN vis AND y <= 120 THEN frame END) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top_at FROM track)"""


@add("track", _TOP, "SELECT match_id, frame FROM s0 WHERE vis AND source = 'model' AND y >= 300 AND frame - top_at <= 8 AND top_at >= seg")
def c12_top_exit_branch(spark, sf):
    return V.top_exit_branch(track(spark, sf), F.expr(CUT), top=120)


_LEAD = """l0 AS (SELECT match_id, frame, x, y, max(x) OVER o AS nx, max(y) OVER o AS ny FROM track WHERE vis WINDOW o AS (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)),
l1 AS (SELECT *, frame - row_number() OVER (PARTITION BY match_id ORDER BY frame) AS g FROM l0 WHERE y - ny >= 8 AND sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) <= 220),
l2 AS (SELECT match_id, g FROM l1 GROUP BY match_id, g HAVING count(*) >= 3 AND arg_max(ny, frame) <= 120)"""


@add("track", _LEAD, "SELECT match_id, frame FROM l1 SEMI JOIN l2 USING (match_id, g)")
def c16_top_entry_lead(spark, sf):
    return V.top_entry_lead(track(spark, sf), top=120)


_BRANCH = """b0 AS (SELECT match_id, frame, x, y, max(x) OVER o AS px, max(y) OVER o AS py, max(x) OVER p AS qx, max(y) OVER p AS qy, max(y) OVER n AS ny FROM track WHERE vis WINDOW o AS (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING), n AS (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)),
b1 AS (SELECT *, coalesce(sqrt(power(x - px, 2) + power(y - py, 2)) >= 240, false) OR coalesce(sqrt(power(x - 2 * px + qx, 2) + power(y - 2 * py + qy, 2)) >= 45 AND (x - px) * (px - qx) + (y - py) * (py - qy) < 0, false) AS cut FROM b0),
b2 AS (SELECT *, max(CASE WHEN px IS NULL OR cut THEN frame END) OVER (PARTITION BY match_id ORDER BY frame) AS branch FROM b1),
b3 AS (SELECT *, count(*) OVER (PARTITION BY match_id, branch) AS n FROM b2 QUALIFY count(*) OVER (PARTITION BY match_id, branch) <= 3 AND bool_or(cut) OVER (PARTITION BY match_id, branch))"""


@add("track", _BRANCH, "SELECT match_id, frame, branch FROM b3")
def c17_short_branches(spark, sf):
    return V.short_branches(track(spark, sf))


_UNSUP = _BRANCH + """, u0 AS (SELECT match_id, frame, x, y, CASE WHEN n >= 2 THEN ny - y ELSE coalesce(y - py, 0) END AS vy FROM b3 WHERE frame = branch),
u1 AS (SELECT u0.match_id, u0.frame, vy, p.side, sqrt(power(greatest(b0 - x, 0, x - b2), 2) + power(greatest(b1 - y, 0, y - b3), 2)) AS box, least(sqrt(power(x - kp[10].x, 2) + power(y - kp[10].y, 2)), sqrt(power(x - kp[11].x, 2) + power(y - kp[11].y, 2))) AS wrist FROM u0 LEFT JOIN poses p USING (match_id, frame)),
u2 AS (SELECT * FROM u1 QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY least(box, wrist), side, box, wrist) = 1)"""


@add("track poses", _UNSUP, "SELECT b3.match_id, b3.frame FROM b3 JOIN u2 ON u2.match_id = b3.match_id AND u2.frame = b3.branch WHERE side IS NULL OR (box > 42 AND wrist > 90) OR (side = 'far' AND vy < -8) OR (side = 'near' AND vy > 8)")
def c17_unsupported_branches(spark, sf):
    """The branches that no player explains."""
    t = track(spark, sf)
    return V.unsupported_branches(V.short_branches(t), t, poses(spark, sf))


DUALS = lambda step, path, spread, support: f"""d0 AS (SELECT p.match_id, p.frame, p.a_x, p.a_y, p.b_x, p.b_y, coalesce(max(CASE WHEN p.frame > 0 AND p.frame % 1500 = 0 THEN p.frame END) OVER (PARTITION BY p.match_id ORDER BY p.frame), -1) AS seg, coalesce(a_vis AND b_vis AND sqrt(power(a_x - b_x, 2) + power(a_y - b_y, 2)) <= 25, false) AS same FROM phases p),
d1 AS (SELECT d0.*, g.x, g.y, g.label FROM d0 JOIN merged g USING (match_id, frame) WHERE same AND g.vis),
d2 AS (SELECT match_id, seg, frame, frame - row_number() OVER (PARTITION BY match_id, seg ORDER BY frame) AS g FROM d1 WHERE label = 'model' AND y > 35 AND EXISTS (SELECT 1 FROM hits h WHERE h.match_id = d1.match_id AND d1.frame BETWEEN h.frame - 2 AND h.frame + 2)),
d3 AS (SELECT match_id, seg, min(frame) AS a, max(frame) AS z, count(*) AS n FROM d2 GROUP BY match_id, seg, g HAVING count(*) BETWEEN 2 AND 8),
d4 AS (SELECT d3.match_id, a, z, n, d1.frame, x, y, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS v, sqrt(power((a_x - lag(a_x) OVER w) - (b_x - lag(b_x) OVER w), 2) + power((a_y - lag(a_y) OVER w) - (b_y - lag(b_y) OVER w), 2)) AS dv, median(x) OVER (PARTITION BY d3.match_id, a) AS mx, median(y) OVER (PARTITION BY d3.match_id, a) AS my FROM d3 JOIN d1 ON d1.match_id = d3.match_id AND d1.seg = d3.seg AND d1.frame BETWEEN a - 2 AND z + 2 WINDOW w AS (PARTITION BY d3.match_id, a ORDER BY d1.frame)),
d5 AS (SELECT match_id, a AS start_frame, z AS end_frame, sum(v) AS path_px, median(v) AS step_px, max(sqrt(power(x - mx, 2) + power(y - my, 2))) AS spread_px, median(dv) AS delta_px, max(v) FILTER (frame = a - 1) AS first, max(v) FILTER (frame = z + 2) AS last FROM d4 GROUP BY match_id, a, z, n HAVING count(*) = n + 4),
dual AS (SELECT * FROM d5 WHERE step_px >= {step} AND path_px >= {path} AND spread_px >= {spread} AND first >= {support} AND last >= {support} AND delta_px <= 18)"""  # noqa: E731
_D6 = ("path_px", "step_px", "spread_px", "delta_px")


def dual_motion(spark, sf, merge, **limits):
    """Candidates are the frames within two of a hit."""
    near = hits(spark, sf).select("match_id", F.explode(F.sequence(F.col("frame") - 2, F.col("frame") + 2)).alias("frame"))
    p = phases(spark, sf)
    d = V.coherent_dual_motion(p, merge(p), near, F.expr(CUT), **limits)
    return d.select("match_id", "start_frame", "end_frame", *r6(*_D6))


_INTER = f"""z0 AS (SELECT match_id, frame, x, y, coalesce(seg, -1) AS seg FROM (SELECT *, max(CASE WHEN {CUT} THEN frame END) OVER (PARTITION BY match_id ORDER BY frame) AS seg FROM track) WHERE vis AND source IN ('model', 'model_edge', 'single_phase_edge') AND y <= 200),
z1 AS (SELECT *, frame - row_number() OVER (PARTITION BY match_id ORDER BY frame) AS g FROM z0),
z2 AS (SELECT *, y - lag(y) OVER (PARTITION BY match_id, g, seg ORDER BY frame) AS d FROM z1),
z3 AS (SELECT match_id, g, min(d) AS lo, max(d) AS hi, min(frame) AS fa, max(frame) AS fz, arg_min(x, frame) AS xa, arg_min(y, frame) AS ya, arg_max(x, frame) AS xz, arg_max(y, frame) AS yz, min(seg) AS seg FROM z2 GROUP BY match_id, g HAVING count(*) >= 2 AND count(DISTINCT seg) = 1),
z4 AS (SELECT u.match_id, u.fz AS lf, u.xz AS lx, u.yz AS ly, d.fa AS rf, d.xa AS rx, d.ya AS ry FROM z3 u JOIN z3 d ON u.match_id = d.match_id AND u.seg = d.seg AND d.fa BETWEEN u.fz + 2 AND u.fz + 41 WHERE u.hi <= 3 AND u.ya - u.yz >= 6 AND u.yz <= 160 AND d.lo >= -3 AND d.yz - d.ya >= 6 AND d.ya <= 160),
z5 AS (SELECT t.match_id, t.frame, max(sqrt(power(t.x - lx - (t.frame - lf) / (rf - lf) * (rx - lx), 2) + power(t.y - ly - (t.frame - lf) / (rf - lf) * (ry - ly), 2))) AS residual FROM z4 JOIN track t ON t.match_id = z4.match_id AND t.frame > lf AND t.frame < rf AND t.vis AND t.source = 'model' GROUP BY t.match_id, t.frame)"""
_FREE = "NOT EXISTS (SELECT 1 FROM track t JOIN poses p USING (match_id, frame) WHERE t.match_id = b.match_id AND t.frame = b.frame AND least(sqrt(power(t.x - kp[10].x, 2) + power(t.y - kp[10].y, 2)), sqrt(power(t.x - kp[11].x, 2) + power(t.y - kp[11].y, 2))) <= 150)"


def _interstitial(spark, sf):
    """Wider limits than in production (y <= 200, core 160, 15 px off), as the made-up tracks seldom reach the top."""
    return V.interstitial_branches(track(spark, sf), F.expr(CUT), top=200, core=160, off=15)


@add("track", _INTER, "SELECT match_id, frame, round(residual, 6) AS residual FROM z5 WHERE residual > 15")
def c14_interstitial_branches(spark, sf):
    return _interstitial(spark, sf).select("match_id", "frame", *r6("residual"))


@add("track poses", _INTER, f"SELECT match_id, frame FROM z5 b WHERE residual > 15 AND {_FREE}")
def c15_veto_interstitial(spark, sf):
    return V.without_contacts(_interstitial(spark, sf), track(spark, sf), poses(spark, sf), 150)


@add("track poses", _TOP + ", b AS (SELECT match_id, frame FROM s0 WHERE vis AND source = 'model' AND y >= 300 AND frame - top_at <= 8 AND top_at >= seg)", f"SELECT match_id, frame FROM b WHERE {_FREE}")
def c13_veto_top_exit(spark, sf):
    return V.without_contacts(V.top_exit_branch(track(spark, sf), F.expr(CUT), top=120), track(spark, sf), poses(spark, sf), 150)


_SLOPE = lambda a, c, cond: f"regr_slope(b.{c}, b.frame) FILTER ({cond})"
_OFFB = f"""q0 AS (SELECT match_id, frame, x, y, coalesce(seg, -1) AS seg FROM (SELECT *, max(CASE WHEN {CUT} THEN frame END) OVER (PARTITION BY match_id ORDER BY frame) AS seg FROM track) WHERE vis AND source IN ({quoted(('model', 'classical', *EDGE, 'classical_gap'))})),
q1 AS (SELECT a.match_id, a.frame, b.frame AS bf, b.x AS bx, b.y AS by_, row_number() OVER (PARTITION BY a.match_id, a.frame, b.frame <= a.frame ORDER BY abs(b.frame - a.frame)) AS k, row_number() OVER (PARTITION BY a.match_id, a.frame, b.frame >= a.frame ORDER BY abs(b.frame - a.frame)) AS m FROM q0 a JOIN q0 b ON a.match_id = b.match_id AND a.seg = b.seg AND b.frame BETWEEN a.frame - 8 AND a.frame + 8),
q2 AS (SELECT match_id, frame, regr_slope(bx, bf) FILTER (bf <= frame AND k <= 4) AS ux, regr_slope(by_, bf) FILTER (bf <= frame AND k <= 4) AS uy, regr_slope(bx, bf) FILTER (bf >= frame AND m <= 4) AS wx, regr_slope(by_, bf) FILTER (bf >= frame AND m <= 4) AS wy FROM q1 GROUP BY match_id, frame),
q3 AS (SELECT q0.*, ux, uy, wx, wy, lag(frame) OVER w AS lf, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lag(seg) OVER w AS ls, lag(ux) OVER w AS lux, lag(uy) OVER w AS luy FROM q0 JOIN q2 USING (match_id, frame) WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
q4 AS (SELECT * FROM q3 WHERE frame - lf - 1 BETWEEN 4 AND 40 AND seg = ls AND least(y, ly) <= 400 AND luy <= -4 AND wy >= 4 AND sqrt(lux * lux + luy * luy) >= 5 AND sqrt(wx * wx + wy * wy) >= 5 AND NOT (lux * wx < 0 AND abs(lux) >= 8 AND abs(wx) >= 8)),
q5 AS (SELECT *, unnest(range(lf + 1, frame)) AS f FROM q4)"""


@add("track", _OFFB, "SELECT match_id, f AS frame, round(lx + (f - lf) / (frame - lf) * (x - lx), 6) AS x, round(ly + (f - lf) / (frame - lf) * (y - ly), 6) AS y FROM q5")
def f04_offscreen_bridges(spark, sf):
    """With a top zone of 400 px instead of 30, as flights that leave the picture are rare here."""
    return V.offscreen_bridges(track(spark, sf), F.expr(CUT), ("model", "classical", *EDGE, "classical_gap"), top=400).select("match_id", "frame", *r6("x", "y"))
