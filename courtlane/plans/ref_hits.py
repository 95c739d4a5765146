"""Reference queries: hits, their evidence and rallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlane.operators import fusion as U
from courtlane.operators import hits as H
from courtlane.operators.sequence import suppressed
from courtlane.plans.ref_fusion import DERIV_SQL
from courtlane.plans.ref_vetoes import CUT
from courtlane.plans.views import EDGE, MEASURED, REAL, Registry, hits, impulses, info, phases, poses, quoted, r6, r6_sql, track

add = Registry()

_CAND = DERIV_SQL + """,
th AS (SELECT match_id, greatest(10, quantile_cont(CASE WHEN curvature > 0 AND speed >= 7 THEN curvature END, 0.78)) AS c, greatest(7, 0.7 * coalesce(quantile_cont(CASE WHEN speed > 0 THEN speed END, 0.35), 0)) AS s FROM deriv GROUP BY match_id HAVING count(CASE WHEN curvature > 0 AND speed >= 7 THEN 1 END) > 0),
nb AS (SELECT a.match_id, a.frame, max(CASE WHEN b.segment = a.segment THEN b.curvature END) AS local, max(CASE WHEN b.frame = a.frame - 1 THEN b.speed END) AS sp, max(CASE WHEN b.frame = a.frame + 1 THEN b.speed END) AS sn, count(CASE WHEN abs(b.frame - a.frame) = 2 THEN 1 END) AS ends FROM deriv a JOIN deriv b ON a.match_id = b.match_id AND b.frame BETWEEN a.frame - 2 AND a.frame + 2 GROUP BY 1, 2),
cand AS (SELECT d.match_id, d.frame, d.segment, d.x, d.y, d.speed, 0.55 * least(1, curvature / greatest(c, 1)) + 0.30 * reversal + 0.15 * least(1, abs(coalesce(sn, 0) - coalesce(sp, 0)) / greatest(d.speed, 1)) AS score
 FROM deriv d JOIN th USING (match_id) JOIN nb USING (match_id, frame) WHERE measured AND d.speed >= s AND curvature >= greatest(c, 0.72 * local) AND ends = 2)"""


def _candidates(spark, sf):
    return H.hit_candidates(U.derivatives(track(spark, sf), F.expr(CUT), MEASURED))


@add("track", _CAND, f"SELECT match_id, frame, {r6_sql('x', 'y', 'speed', 'score')} FROM cand")
def f07_hit_candidates(spark, sf):
    return _candidates(spark, sf).select("match_id", "frame", *r6("x", "y", "speed", "score"))


def nms_sql(source: str, score: str, sep: int, keys: str = "match_id", extra: str = "") -> str:
    """Greedy suppression as a fold over the list of a key's candidates by falling score."""
    return f"""l AS (SELECT {keys}, list(struct_pack(s := -({score}), f := frame) ORDER BY -({score}), frame) AS c FROM {source} {extra} GROUP BY {keys}),
k AS (SELECT {keys}, unnest(list_reduce(list_prepend(CAST([] AS STRUCT(s DOUBLE, f BIGINT)[]), list_transform(c, lambda e: [CAST(e AS STRUCT(s DOUBLE, f BIGINT))])), lambda acc, e: CASE WHEN len(list_filter(acc, lambda a: abs(a.f - e[1].f) < {sep})) = 0 THEN list_concat(acc, e) ELSE acc END)) AS p FROM l)"""


@add("track", _CAND + ", sc AS (SELECT *, round(score, 9) AS rs FROM cand), " + nms_sql("sc", "rs", 10, "match_id, segment"), "SELECT match_id, p.f AS frame, round(-p.s, 6) AS score FROM k")
def f08_suppressed_hits(spark, sf):
    c = _candidates(spark, sf).withColumn("score", F.round("score", 9))
    return suppressed(c, F.col("score"), 10, by="segment").select("match_id", "frame", F.round("score", 6).alias("score"))


_BONUS = "CASE source WHEN 'top_edge_exit' THEN 0.25 WHEN 'piecewise' THEN 0.18 WHEN 'curvature' THEN 0.12 WHEN 'endpoint' THEN 0.04 ELSE 0 END"


@add("hits", "hv AS (SELECT match_id, frame, max(CAST(coalesce(score, 0) AS DOUBLE) + " + _BONUS + ") AS rank FROM hits WHERE source <> 'audio_pose' GROUP BY match_id, frame), " + nms_sql("hv", "round(rank, 9)", 8), "SELECT match_id, p.f AS frame, round(-p.s, 6) AS rank FROM k")
def f09_merged_hits(spark, sf):
    """Of hits on one frame the best ranked stands for it."""
    bonus = F.coalesce(*[F.when(F.col("source") == s, F.lit(b)) for s, b in H.SOURCE_BONUS.items()], F.lit(0.0))
    h = hits(spark, sf).where("source <> 'audio_pose'").groupBy("match_id", "frame").agg(F.max(F.coalesce("score", F.lit(0.0)) + bonus).alias("rank"))
    return suppressed(h.withColumn("rank", F.round("rank", 9)), F.col("rank"), 8).select("match_id", "frame", F.round("rank", 6).alias("rank"))


_EXIT = f"""x0 AS (SELECT match_id, frame, x, CASE WHEN vis AND source IN ({quoted(REAL)}) THEN y END AS ry, CASE WHEN vis AND source IN ({quoted(EDGE + ('interp', 'kalman'))}) THEN y END AS ey FROM track),
x1 AS (SELECT a.match_id, a.frame, a.x, a.ry AS y, a.ry - b.ry AS i1, b.ry - c.ry AS i2, d.ey - a.ry AS o1, e.ey - d.ey AS o2 FROM x0 a JOIN x0 b ON b.match_id = a.match_id AND b.frame = a.frame - 1 JOIN x0 c ON c.match_id = a.match_id AND c.frame = a.frame - 2 JOIN x0 d ON d.match_id = a.match_id AND d.frame = a.frame + 1 JOIN x0 e ON e.match_id = a.match_id AND e.frame = a.frame + 2)"""


@add("track", _EXIT, "SELECT match_id, frame, x, y, round(least(0.96, greatest(0.72, 0.72 + 0.012 * least(15, (i1 + i2) / 2) + 0.010 * least(18, -(o1 + o2) / 2))), 6) AS score, round(greatest((i1 + i2) / 2, -(o1 + o2) / 2), 6) AS speed FROM x1 WHERE i1 >= 4 AND i2 >= 4 AND o1 <= -4 AND o2 <= -4")
def f10_edge_exits(spark, sf):
    """Forecasts and interpolated points stand in for edge points too, as edge labels are few here, and a rise of 4 px is enough."""
    return H.edge_exits(track(spark, sf), REAL, (*EDGE, "interp", "kalman"), outgoing=4.0).select("match_id", "frame", "x", "y", *r6("score", "speed"))


_EV = """ask AS (SELECT h.hit_id, h.match_id, h.frame, h.x, h.y, h.source FROM hits h),
rp AS (SELECT match_id, frame, x, y FROM track WHERE vis AND source IN ('model', 'classical')),
nr AS (SELECT a.hit_id, count(r.frame) AS n, arg_max(struct_pack(f := r.frame, x := r.x, y := r.y), r.frame) FILTER (r.frame < a.frame) AS l, arg_min(struct_pack(f := r.frame, x := r.x, y := r.y), r.frame) FILTER (r.frame > a.frame) AS r, any_value(r.x) FILTER (r.frame = a.frame) AS ox, any_value(r.y) FILTER (r.frame = a.frame) AS oy FROM ask a LEFT JOIN rp r ON r.match_id = a.match_id AND r.frame BETWEEN a.frame - 10 AND a.frame + 10 GROUP BY a.hit_id),
au AS (SELECT DISTINCT a.hit_id FROM ask a JOIN impulses i ON i.match_id = a.match_id AND i.frame BETWEEN a.frame - 6 AND a.frame + 6),
bx AS (SELECT a.hit_id, bool_or(a.x BETWEEN b0 - 8 AND b2 + 8 AND a.y BETWEEN b1 - 8 AND b3 + 8) AS inside, bool_or(least(sqrt((a.x - kp[10].x) * (a.x - kp[10].x) + (a.y - kp[10].y) * (a.y - kp[10].y)), sqrt((a.x - kp[11].x) * (a.x - kp[11].x) + (a.y - kp[11].y) * (a.y - kp[11].y))) <= 45) AS touch FROM ask a JOIN poses USING (match_id, frame) GROUP BY a.hit_id),
mf AS (SELECT match_id, max(frame) AS stop FROM track GROUP BY match_id),
al AS (SELECT a.*, stop, t.source AS ts, n, l, r, ox, oy, au.hit_id IS NOT NULL AS heard, coalesce(inside AND NOT touch, false) AS body, (a.frame - l.f) / (r.f - l.f) AS w FROM ask a JOIN nr USING (hit_id) LEFT JOIN track t ON t.match_id = a.match_id AND t.frame = a.frame LEFT JOIN mf ON mf.match_id = a.match_id LEFT JOIN au ON au.hit_id = a.hit_id LEFT JOIN bx ON bx.hit_id = a.hit_id),
es AS (SELECT *, CASE WHEN ox IS NOT NULL THEN ox WHEN l IS NOT NULL AND r IS NOT NULL THEN l.x * (1 - w) + r.x * w ELSE coalesce(l.x, r.x) END AS ex, CASE WHEN ox IS NOT NULL THEN oy WHEN l IS NOT NULL AND r IS NOT NULL THEN l.y * (1 - w) + r.y * w ELSE coalesce(l.y, r.y) END AS ey FROM al),
ev AS (SELECT hit_id, match_id, frame, ox IS NOT NULL AS seen, CASE WHEN source = 'audio_pose' THEN 'pose_only' WHEN frame < 0 OR coalesce(frame > stop, true) OR x IS NULL OR y IS NULL THEN 'invalid_frame_or_position' WHEN ts IN ('model_edge', 'single_phase_edge', 'classical_gap', 'offscreen_bridge') THEN 'edge_or_derived_event' WHEN body THEN 'player_overlap' WHEN NOT heard THEN 'missing_audio'
 WHEN n < 2 THEN 'insufficient_real_points' WHEN source IN ('curvature', 'piecewise') AND (l IS NULL OR r IS NULL OR n < 3) THEN 'missing_bidirectional_trajectory' WHEN sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey)) > 90 THEN 'trajectory_position_mismatch' ELSE 'accepted' END AS reason FROM es)"""


@add("track hits impulses poses", _EV, "SELECT hit_id, match_id, frame, reason, reason = 'accepted' AND seen AS ball_observed FROM ev")
def c19_hit_evidence(spark, sf):
    return H.evidence(hits(spark, sf), track(spark, sf), impulses(spark, sf), poses(spark, sf))


@add("track hits impulses poses", _EV, "SELECT reason, CAST(count(*) AS BIGINT) AS hits FROM ev GROUP BY reason")
def c19_reject_counts(spark, sf):
    return c19_hit_evidence(spark, sf).groupBy("reason").agg(F.count("*").alias("hits"))


@add("track hits impulses", "hd AS (SELECT DISTINCT h.hit_id FROM hits h JOIN impulses i ON i.match_id = h.match_id AND i.frame BETWEEN h.frame - 3 AND h.frame + 3)", "SELECT h.hit_id, coalesce(h.uncertain, false) OR h.source LIKE 'audio\\_%' ESCAPE '\\' OR coalesce(t.source <> 'model', true) OR h.source = 'endpoint' OR (coalesce(h.score, 0) < 0.72 AND NOT coalesce(t.vis AND t.source = 'model' AND hd.hit_id IS NOT NULL, false)) AS uncertain FROM hits h LEFT JOIN track t USING (match_id, frame) LEFT JOIN hd ON hd.hit_id = h.hit_id")
def c20_uncertainty(spark, sf):
    return H.uncertainty(hits(spark, sf), track(spark, sf), impulses(spark, sf))


@add("hits impulses", "", "SELECT hit_id FROM hits h WHERE EXISTS (SELECT 1 FROM impulses i WHERE i.match_id = h.match_id AND i.frame BETWEEN h.frame - 4 AND h.frame + 4)")
def d06_hits_with_audio(spark, sf):
    heard = impulses(spark, sf).select("match_id", F.explode(F.sequence(F.col("frame") - 4, F.col("frame") + 4)).alias("frame")).distinct()
    return hits(spark, sf).join(heard, ["match_id", "frame"], "left_semi").select("hit_id")


_LONE = """sp AS (SELECT * FROM hits WHERE hitter IN ('near', 'far') AND hitter_source = 'pose_contact' AND hitter_confidence >= 0.63 AND source = 'audio_pose'),
vi AS (SELECT * FROM hits WHERE source <> 'audio_pose'),
pr AS (SELECT sp.hit_id AS aid, sp.frame AS af, sp.hitter, sp.hitter_confidence, vi.hit_id, vi.hitter AS was, count(*) OVER (PARTITION BY sp.hit_id) AS n FROM sp JOIN vi ON vi.match_id = sp.match_id AND abs(vi.frame - sp.frame) <= 60)"""


@add("hits", _LONE, "SELECT hit_id, hitter, hitter_confidence FROM pr WHERE n = 1 AND was = 'unknown' QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY af, aid) = 1")
def d07_lone_supplements(spark, sf):
    """60 frames instead of 3, as supplements seldom lie that near here."""
    h = hits(spark, sf)
    return H.lone_supplements(h.where("source <> 'audio_pose'"), h.where("source = 'audio_pose'"), reach=60)


_BALL = """mp AS (SELECT match_id, frame, x, y, raw_vis FROM track WHERE vis AND source IN ('model', 'classical', 'interp')),
ba AS (SELECT h.hit_id, h.frame, arg_max(struct_pack(f := m.frame, x := m.x, y := m.y), m.frame) FILTER (m.frame < h.frame) AS l, arg_min(struct_pack(f := m.frame, x := m.x, y := m.y), m.frame) FILTER (m.frame > h.frame) AS r, any_value(m.x) FILTER (m.frame = h.frame) AS ox, any_value(m.y) FILTER (m.frame = h.frame) AS oy, bool_or(m.raw_vis) FILTER (m.frame = h.frame) AS orv FROM hits h JOIN mp m ON m.match_id = h.match_id AND m.frame BETWEEN h.frame - 18 AND h.frame + 18 GROUP BY h.hit_id, h.frame)"""


@add("track hits", _BALL, "SELECT hit_id, round(CASE WHEN ox IS NOT NULL THEN ox WHEN l IS NOT NULL AND r IS NOT NULL THEN l.x + (frame - l.f) / (r.f - l.f) * (r.x - l.x) ELSE coalesce(l.x, r.x) END, 6) AS bx, round(CASE WHEN ox IS NOT NULL THEN oy WHEN l IS NOT NULL AND r IS NOT NULL THEN l.y + (frame - l.f) / (r.f - l.f) * (r.y - l.y) ELSE coalesce(l.y, r.y) END, 6) AS by, coalesce(orv, false) AS observed FROM ba")
def d08_ball_at_hits(spark, sf):
    return H.ball_at_hits(hits(spark, sf), track(spark, sf)).select("hit_id", *r6("bx", "by"), "observed")


@add("hits", "", "SELECT hit_id, lead(frame) OVER w AS end_frame, CASE WHEN lead(hitter) OVER w IN ('near', 'far') AND lead(hitter) OVER w <> hitter AND lead(frame) OVER w > frame THEN lead(hitter) OVER w END AS receiver FROM hits WHERE rally > 0 WINDOW w AS (PARTITION BY match_id, rally ORDER BY frame, hit_id)")
def d09_receivers(spark, sf):
    return H.receivers(hits(spark, sf))


_RALLY = f"""ac AS (SELECT match_id, frame FROM track WHERE vis AND source IN ({quoted(MEASURED)}) UNION SELECT match_id, frame FROM hits),
ct AS (SELECT match_id, frame FROM track WHERE {CUT}),
a1 AS (SELECT match_id, frame, lag(frame) OVER (PARTITION BY match_id ORDER BY frame) AS prev FROM ac),
a2 AS (SELECT a1.*, greatest(1, floor(5 * greatest(fps, 1) + 0.5)) AS gap, EXISTS (SELECT 1 FROM ct WHERE ct.match_id = a1.match_id AND ct.frame > a1.prev AND ct.frame <= a1.frame) AS crossed FROM a1 JOIN info USING (match_id)),
a3 AS (SELECT *, sum(CASE WHEN prev IS NULL OR frame - prev > gap OR crossed THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame) AS c FROM a2),
spans AS (SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY min(frame)) AS rally, min(frame) AS start_frame, max(frame) AS end_frame FROM a3 GROUP BY match_id, c HAVING count(*) >= 3)"""


def _spans(spark, sf):
    return H.rally_spans(track(spark, sf), hits(spark, sf), info(spark, sf), F.expr(CUT), MEASURED)


@add("track hits info", _RALLY, "SELECT match_id, rally, start_frame, end_frame FROM spans")
def f11_rally_spans(spark, sf):
    return _spans(spark, sf)


@add("track hits info", _RALLY, "SELECT t.match_id, t.frame, coalesce(rally_, 0) AS rally FROM (SELECT match_id, frame FROM track) t LEFT JOIN (SELECT match_id, rally AS rally_, start_frame, end_frame FROM spans) s ON s.match_id = t.match_id AND t.frame BETWEEN start_frame AND end_frame")
def d05_label_frames(spark, sf):
    t = track(spark, sf).select("match_id", "frame")
    return H.label_frames(t, _spans(spark, sf)).join(t, ["match_id", "frame"], "left_semi")


_ROW = "struct_pack(f := frame, h := hitter, s := hitter IN ('near', 'far') AND coalesce(hitter_source = 'pose_contact', false) AND coalesce(hitter_confidence, 0) >= 0.75, e := source IN ('top_edge_exit', 'endpoint'))"


@add("hits", f"z AS (SELECT *, source IN ('top_edge_exit', 'endpoint') AS loose, lag({_ROW}) OVER w AS p, lead({_ROW}) OVER w AS n FROM hits WHERE rally > 0 WINDOW w AS (PARTITION BY match_id, rally ORDER BY frame, hit_id))", "SELECT hit_id, CASE WHEN p.h = 'near' THEN 'far' ELSE 'near' END AS hitter FROM z WHERE hitter = 'unknown' AND p.s AND n.s AND NOT p.e AND NOT n.e AND NOT loose AND frame - p.f > 10 AND n.f - frame > 10 AND p.h = n.h")
def f26_infer_single_unknown(spark, sf):
    return H.infer_single_unknown(hits(spark, sf))


_ALT = """z0 AS (SELECT *, lower(trim(coalesce(hitter_source, 'sidecar'))) AS src, source IN ('edge_exit', 'top_edge_exit', 'endpoint', 'classical_endpoint') AS loose, CASE WHEN hitter NOT IN ('near', 'far') THEN 0 WHEN hitter_confidence IS NULL OR hitter_confidence < 0 THEN 0.48 WHEN hitter_confidence > 1 THEN least(1, hitter_confidence / 100) ELSE hitter_confidence END AS c FROM hits WHERE rally > 0),
z1 AS (SELECT *, hitter IN ('near', 'far') AND c >= CASE WHEN src = 'sidecar' THEN 0.85 ELSE 0.6 END AS anchor FROM z0),
z2 AS (SELECT *, lag(anchor) OVER w AND lead(anchor) OVER w AND NOT anchor AND lag(hitter) OVER w = lead(hitter) OVER w AND NOT loose AND NOT lag(loose) OVER w AND NOT lead(loose) OVER w AND NOT (frame - lag(frame) OVER w BETWEEN 1 AND 10) AND NOT (lead(frame) OVER w - frame BETWEEN 1 AND 10) AS gap, CASE lag(hitter) OVER w WHEN 'near' THEN 'far' ELSE 'near' END AS other FROM z1 WINDOW w AS (PARTITION BY match_id, rally ORDER BY frame, hit_id)),
z3 AS (SELECT *, coalesce(gap AND hitter = 'unknown', false) AS inf, coalesce(gap AND hitter NOT IN ('unknown', other) AND c < 0.6 AND speed >= 45, false) AS cor FROM z2)"""


@add("hits", _ALT, "SELECT hit_id, CASE WHEN inf OR cor THEN other ELSE hitter END AS hitter, round(CASE WHEN inf THEN 0.55 WHEN cor THEN least(0.58, greatest(0.45, c)) ELSE c END, 6) AS hitter_confidence, CASE WHEN inf THEN 'rally_alternation_inferred' WHEN cor THEN 'rally_alternation_corrected' WHEN hitter = 'unknown' THEN 'unknown' ELSE src END AS provenance FROM z3")
def f27_alternation(spark, sf):
    """With K6. There is no direction of flight per hit; the other side, as sure as the speed in percent, stands for it."""
    h = hits(spark, sf).withColumns({"towards": F.when(F.col("hitter") == "near", "far").otherwise("near"), "sure": F.col("speed") / 100})
    return H.alternation(h, direction=("towards", "sure")).withColumn("hitter_confidence", F.round("hitter_confidence", 6))


@add("hits", "", "SELECT hit_id, CAST(row_number() OVER (PARTITION BY match_id, rally ORDER BY frame, hit_id) AS BIGINT) AS rally_hit_index FROM hits WHERE rally > 0")
def f30_hit_counters(spark, sf):
    from pyspark.sql import Window

    return hits(spark, sf).where("rally > 0").select("hit_id", F.row_number().over(Window.partitionBy("match_id", "rally").orderBy("frame", "hit_id")).cast("long").alias("rally_hit_index"))
