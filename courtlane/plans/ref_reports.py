"""Reference queries: landings, coaching samples and small operators."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtlane.functions import geometry as G
from courtlane.functions.strokes import posture_signals
from courtlane.operators import coaching as K
from courtlane.operators import landing as L
from courtlane.operators import players as P
from courtlane.plans.ref_strokes import _FAM, _STROKE, _classified
from courtlane.plans.views import Registry, hits, impulses, info, phases, poses, r6, r6_sql, table, track, with_info

add = Registry()

_REST = f"""o0 AS (SELECT match_id, frame, x, y, conf, CASE WHEN frame - lag(frame) OVER (PARTITION BY match_id ORDER BY frame) <= 2 THEN 0 ELSE 1 END AS op FROM track WHERE vis AND source IN ('model', 'classical')),
o1 AS (SELECT *, sum(op) OVER (PARTITION BY match_id ORDER BY frame) AS g FROM o0),
o2 AS (SELECT match_id, g, min(frame) AS run, max(frame) - min(frame) AS span, count(*) AS n, list(struct_pack(f := frame, x := x, y := y, c := conf) ORDER BY frame DESC)[1:5] AS t FROM o1 GROUP BY match_id, g HAVING count(*) >= 5),
o3 AS (SELECT o2.*, fps, least(1800, greatest(400, sqrt(abs({G.shoelace([f'q{k}' for k in range(8)])})))) AS scale FROM o2 JOIN info USING (match_id)),
o4 AS (SELECT *, {', '.join(f"sqrt(power(t[{i}].x - t[{j}].x, 2) + power(t[{i}].y - t[{j}].y, 2)) AS d{i}{j}" for i, j in ((1, 2), (2, 3), (1, 3), (3, 4), (4, 5)))}, list_median([t[1].x, t[2].x, t[3].x]) AS mx, list_median([t[1].y, t[2].y, t[3].y]) AS my, 3 * least(12, greatest(4, 0.012 * scale)) AS settle, greatest(7, 0.012 * scale) / 3 AS lo, greatest(28, 0.05 * scale) AS hi FROM o3),
rest AS (SELECT match_id, run, t[3].f AS event_frame, mx AS x, my AS y, d34 / greatest(1, t[3].f - t[4].f) AS approach, greatest(d12, d13, d23) AS settle_px FROM o4 WHERE span >= greatest(4, floor(greatest(fps, 1) * 0.16 + 0.5)) AND t[1].f - t[2].f = 1 AND t[2].f - t[3].f = 1 AND greatest(d12, d13, d23) <= settle AND least(t[1].c, t[2].c, t[3].c) >= 0.35 AND (t[1].c + t[2].c + t[3].c) / 3 >= 0.55
 AND d34 / greatest(1, t[3].f - t[4].f) >= lo AND d45 / greatest(1, t[4].f - t[5].f) >= 0.55 * lo AND d34 / greatest(1, t[3].f - t[4].f) <= greatest(hi, d45 / greatest(1, t[4].f - t[5].f) * 3.5)
 AND (t[3].x - t[4].x) * (t[4].x - t[5].x) + (t[3].y - t[4].y) * (t[4].y - t[5].y) >= 0.25 * d34 * d45 AND d34 > 1e-6 AND d45 > 1e-6 AND sqrt(power(t[4].x - mx, 2) + power(t[4].y - my, 2)) >= least(18, greatest(8, 0.012 * scale)) / 3 AND greatest(d12, d23) <= settle)"""


def _rest(spark, sf):
    """With an ease of 3, as flights here are cut by the next hit and hardly one comes to rest."""
    return L.rest_evidence(L.observation_runs(track(spark, sf)), info(spark, sf), ease=3.0)


@add("track info", _REST, "SELECT match_id, run, event_frame, x, y, round(approach, 6) AS approach, round(settle_px, 6) AS settle_px FROM rest")
def f24_rest_evidence(spark, sf):
    return _rest(spark, sf).select("match_id", "run", "event_frame", "x", "y", *r6("approach", "settle_px"))


_CALLX, _CALLY = G.project("rx", "ry")
_REST1 = _REST.replace("track WHERE vis AND source IN ('model', 'classical')", "(SELECT match_id, rally, frame, x, y, conf FROM tail)").replace("PARTITION BY match_id ORDER BY frame) <= 2", "PARTITION BY match_id, rally ORDER BY frame) <= 2").replace("sum(op) OVER (PARTITION BY match_id ORDER BY frame)", "rally * 1000000 + sum(op) OVER (PARTITION BY match_id, rally ORDER BY frame)").replace("SELECT match_id, frame, x, y, conf, CASE", "SELECT match_id, rally, frame, x, y, conf, CASE").replace("3 * least(12,", "least(12,").replace("/ 3 AS lo", "AS lo").replace("0.012 * scale)) / 3 AND", "0.012 * scale)) AND")
_HITS = f"""fr AS (SELECT match_id, rally, frame, CASE WHEN raw_vis AND raw_source IN ('model', 'classical') THEN raw_x END AS x, CASE WHEN raw_vis AND raw_source IN ('model', 'classical') THEN raw_y END AS y, CASE WHEN vis THEN conf ELSE 0.65 END AS conf FROM track WHERE rally > 0),
he AS (SELECT match_id, frame, arg_max(struct_pack(u := uncertain, c := hitter_confidence, s := hitter_source), hit_id) AS e FROM hits GROUP BY 1, 2),
sc AS (SELECT match_id, fps, coalesce(least(1800, greatest(400, sqrt(abs({G.shoelace([f'q{k}' for k in range(8)])})))), 800) AS scale FROM info),
hr AS (SELECT t.match_id, t.rally, t.frame, coalesce(hitscore, 0) AS score, lower(trim(hitsource)) AS src, hitter, NOT coalesce(e.u, false) AND raw_vis AS sure, raw_vis AS seen, coalesce(e.c, 0) AS hc, lower(trim(coalesce(e.s, ''))) AS hs, shot_end, scale FROM track t LEFT JOIN he USING (match_id, frame) JOIN sc USING (match_id) WHERE t.rally > 0 AND t.hit),
h1 AS (SELECT *, NOT sure AND seen AND ((hs = 'pose_contact' AND hc >= 0.85 AND score >= 0.7) OR (coalesce(src IN ('curvature', 'edge_exit'), false) AND score >= 0.88) OR (score >= 0.9 AND hc >= 0.9)) AS strong FROM hr),
w0 AS (SELECT h.match_id, h.rally, h.frame, max(scale) AS scale, list(struct_pack(f := f.frame, x := f.x, y := f.y) ORDER BY f.frame) AS p FROM h1 h JOIN fr f ON f.match_id = h.match_id AND f.rally = h.rally AND f.frame BETWEEN h.frame - 6 AND h.frame + 6 AND f.x IS NOT NULL AND f.y IS NOT NULL WHERE strong GROUP BY 1, 2, 3),
w1 AS (SELECT match_id, rally, frame, scale, list_filter(p, lambda q: q.f < frame)[-3:] AS b, list_filter(p, lambda q: q.f = frame)[1] AS e, list_filter(p, lambda q: q.f > frame)[1:4] AS a FROM w0),
w2 AS (SELECT *, list_concat(b, [e], a) AS way, len(b) AS n FROM w1 WHERE len(b) >= 2 AND len(a) >= 3 AND e IS NOT NULL),
w3 AS (SELECT *, list_transform(range(1, len(way)), lambda i: way[i + 1].f - way[i].f) AS gaps, list_transform(range(1, len(way)), lambda i: sqrt(power(way[i + 1].x - way[i].x, 2) + power(way[i + 1].y - way[i].y, 2)) / greatest(1, way[i + 1].f - way[i].f)) AS v FROM w2),
w4 AS (SELECT *, (v[n - 1] + v[n]) / 2 AS pre, list_median([v[n + 1], v[n + 2], v[n + 3]]) AS post, sqrt(power(a[3].x - e.x, 2) + power(a[3].y - e.y, 2)) AS away, (e.x - b[n].x) * (a[1].x - e.x) + (e.y - b[n].y) * (a[1].y - e.y) AS dot, sqrt(power(e.x - b[n].x, 2) + power(e.y - b[n].y, 2)) * sqrt(power(a[1].x - e.x, 2) + power(a[1].y - e.y, 2)) AS size FROM w3 WHERE list_max(gaps) <= 2),
two AS (SELECT match_id, rally, frame FROM w4 WHERE pre >= greatest(4, 0.008 * scale) AND post >= greatest(4, 0.008 * scale) AND away >= greatest(8, 0.018 * scale) AND size > 1e-12 AND (dot <= 0.65 * size OR post >= 1.35 * pre OR post <= 0.55 * pre))"""
_CALL = _HITS + f""", r0 AS (SELECT match_id, rally, max(frame) FILTER (sure) AS hit_frame, arg_max(hitter, frame) FILTER (sure) AS hitter, arg_max(hs, frame) FILTER (sure) AS hs, max(frame) FILTER (strong) AS strong_at FROM h1 GROUP BY 1, 2),
r1 AS (SELECT r0.*, h1.shot_end, coalesce(h1.shot_end > hit_frame, false) AS goes FROM r0 LEFT JOIN h1 ON h1.match_id = r0.match_id AND h1.rally = r0.rally AND h1.frame = r0.hit_frame),
r2 AS (SELECT *, goes AND (NOT EXISTS (SELECT 1 FROM fr WHERE fr.match_id = r1.match_id AND fr.rally = r1.rally AND fr.frame = r1.shot_end) OR EXISTS (SELECT 1 FROM two WHERE two.match_id = r1.match_id AND two.rally = r1.rally AND two.frame = r1.shot_end) OR EXISTS (SELECT 1 FROM h1 WHERE h1.match_id = r1.match_id AND h1.rally = r1.rally AND h1.frame = r1.shot_end AND sure)) AS continues, coalesce(strong_at > hit_frame, false) AS later,
  CASE WHEN hitter IN ('near', 'far') AND hs NOT IN ('rally_alternation_inferred', 'rally_alternation_corrected') THEN hitter ELSE 'unknown' END AS who FROM r1),
tail AS (SELECT fr.*, hit_frame FROM fr JOIN r2 USING (match_id, rally) WHERE hit_frame IS NOT NULL AND NOT continues AND NOT later AND x IS NOT NULL AND y IS NOT NULL AND frame > hit_frame AND (NOT goes OR frame <= shot_end)),
{_REST1},
g0 AS (SELECT match_id, rally, min(frame) AS run, max(frame) AS z, count(*) AS n, avg(conf) AS mean FROM (SELECT o1.*, g FROM o1) GROUP BY match_id, rally, g),
g1 AS (SELECT match_id, rally, count(*) AS al, count(*) FILTER (n >= 3) AS coherent, arg_min(struct_pack(run := run, n := n, z := z, mean := mean), run) FILTER (n >= 3) AS t FROM g0 GROUP BY 1, 2),
k0 AS (SELECT r2.*, al, coherent, t, rest.x AS rx, rest.y AS ry, info.* EXCLUDE (match_id) FROM r2 LEFT JOIN g1 USING (match_id, rally) JOIN info USING (match_id) LEFT JOIN rest ON rest.match_id = r2.match_id AND rest.run = t.run),
k1 AS (SELECT *, {_CALLX} AS x_m, {_CALLY} AS y_m, greatest(fps, 1) AS rate, coalesce(coherent - 1, 0) AS rejected, t.z - hit_frame AS flight FROM k0),
k2 AS (SELECT *, {G.line_distance('x_m', 'y_m')} AS line_m, {G.target_half('who', 'y_m')} AS target FROM k1),
k3 AS (SELECT *, who = 'unknown' OR rejected > 0 AS held, round_even(100 * (0.38 * least(1, t.n / 5) + 0.25 * t.mean + 0.22 * least(1, flight / greatest(1, rate * 0.7)) + 0.15 * CASE WHEN target THEN 1 ELSE 0.68 END), 0) AS score FROM k2),
k4 AS (SELECT *, CASE WHEN held THEN least(79, score) ELSE score END AS conf FROM k3),
calls AS (SELECT *, CASE WHEN hit_frame IS NULL THEN 'no_confirmed_hit' WHEN continues THEN 'shot_continues_to_next_contact' WHEN later THEN 'later_hit_unconfirmed' WHEN al IS NULL THEN 'no_post_hit_observation' WHEN coherent = 0 THEN 'discontinuous_terminal_track' WHEN flight < greatest(3, round_even(rate * 0.18, 0)) THEN 'flight_too_short'
 WHEN rx IS NULL THEN 'no_landing_evidence' WHEN line_m IS NULL THEN 'projection_failed' WHEN line_m < -1 THEN 'landing_out_of_bounds' WHEN NOT coalesce(target, true) THEN 'wrong_target_half' WHEN conf < 66 THEN 'low_confidence' END AS reason FROM k4)"""


def _rally_rows(spark, sf):
    """The rows of positive rallies with what a detector saw, and the hit rows with what the hit events know of them."""
    t = track(spark, sf).where("rally > 0")
    real = F.col("raw_vis") & F.col("raw_source").isin("model", "classical")
    frames = t.select("match_id", "rally", "frame", F.when(real, F.col("raw_x")).alias("x"), F.when(real, F.col("raw_y")).alias("y"), F.when(F.col("vis"), F.col("conf")).otherwise(0.65).alias("conf"))
    e = hits(spark, sf).groupBy("match_id", "frame").agg(F.max_by(F.struct("uncertain", "hitter_confidence", "hitter_source"), "hit_id").alias("e"))
    h = t.where("hit").join(e, ["match_id", "frame"], "left")
    return frames, h.select("match_id", "rally", "frame", F.col("hitscore").alias("score"), F.col("hitsource").alias("source"), "hitter", "e.uncertain", F.col("raw_vis").alias("ball_observed"), "e.hitter_confidence", "e.hitter_source", "shot_end")


def _calls(spark, sf):
    return L.rally_calls(*_rally_rows(spark, sf), info(spark, sf))


@add("track hits info", _CALL, f"SELECT match_id, rally, reason, hit_frame, CASE WHEN reason IS NULL THEN t.z END AS frame, who AS hitter, round(CASE WHEN reason IS NULL THEN line_m END, 6) AS line_m, CASE WHEN reason IS NULL THEN CASE WHEN held THEN 'review' ELSE {G.line_call('line_m')} END END AS decision, CASE WHEN reason IS NULL THEN conf END AS confidence, CAST(rejected AS BIGINT) AS rejected_runs FROM calls")
def f25_rally_calls(spark, sf):
    """With C23. Landings are rare in this data: rallies are mostly cut by the next hit."""
    return _calls(spark, sf).select("match_id", "rally", "reason", "hit_frame", "frame", "hitter", *r6("line_m"), "decision", "confidence", "rejected_runs")


@add("track hits info", _CALL, "SELECT coalesce(reason, 'called') AS reason, CAST(count(*) AS BIGINT) AS rallies, CAST(list_position([" + ", ".join(f"'{r}'" for r in L.REASONS) + "], reason) AS BIGINT) AS priority FROM calls GROUP BY ALL")
def e21_landing_diagnostics(spark, sf):
    prio = F.coalesce(*[F.when(F.col("reason") == r, F.lit(i).cast("long")) for i, r in enumerate(L.REASONS, 1)])
    return _calls(spark, sf).groupBy("reason").agg(F.count("*").alias("rallies")).select(F.coalesce("reason", F.lit("called")).alias("reason"), "rallies", prio.alias("priority"))


@add("track hits info", _HITS, "SELECT match_id, rally, h1.frame, sure AS confirmed, strong, two.frame IS NOT NULL AS two_sided FROM h1 LEFT JOIN two USING (match_id, rally, frame)")
def c23_confirmed_hits(spark, sf):
    """Confirmed hits, strong unconfirmed ones, and which of these have flight on both sides."""
    frames, h = _rally_rows(spark, sf)
    h = with_info(h, spark, sf).withColumns({"confirmed": L.confirmed_hit(F.col("uncertain"), F.col("ball_observed")), "strong": L.strong_unconfirmed(*[F.col(c) for c in ("uncertain", "ball_observed", "score", "source", "hitter_confidence", "hitter_source")]), "scale": L.court_scale([f"q{k}" for k in range(8)])})
    two = L.two_sided(h.where("strong"), frames.where("x is not null and y is not null")).withColumn("two", F.lit(True))
    return h.select("match_id", "rally", "frame", "confirmed", "strong").join(two, ["match_id", "rally", "frame"], "left").select("match_id", "rally", "frame", "confirmed", "strong", F.coalesce("two", F.lit(False)).alias("two_sided"))


_FOOT = lambda base: f"CASE WHEN kp[{15 + base}].conf >= 0.22 AND kp[{16 + base}].conf >= 0.22 THEN (kp[{15 + base}].x + kp[{16 + base}].x) / 2 WHEN kp[{15 + base}].conf >= 0.22 THEN kp[{15 + base}].x WHEN kp[{16 + base}].conf >= 0.22 THEN kp[{16 + base}].x ELSE (b0 + b2) / 2 END"
_FOOTY = lambda base: f"CASE WHEN kp[{15 + base}].conf >= 0.22 AND kp[{16 + base}].conf >= 0.22 THEN greatest(kp[{15 + base}].y, kp[{16 + base}].y) WHEN kp[{15 + base}].conf >= 0.22 THEN kp[{15 + base}].y WHEN kp[{16 + base}].conf >= 0.22 THEN kp[{16 + base}].y ELSE b3 END"
_INNER = P.inner_quad([f"q{k}" for k in range(8)])


@add("poses info", f"ft AS (SELECT match_id, frame, side, b2 - b0 AS w, b3 - b1 AS h, {_FOOT(1)} AS fx, {_FOOTY(1)} AS fy, info.* EXCLUDE (match_id) FROM poses JOIN info USING (match_id))", f"SELECT match_id, frame, side, round(fx, 6) AS fx, round(fy, 6) AS fy FROM ft WHERE w >= 10 AND h >= 20 AND {G.in_quad('fx', 'fy', [f'q{k}' for k in range(8)])} AND {G.in_quad('fx', 'fy', _INNER)}")
def c28_player_filters(spark, sf):
    """With B13: boxes of 10 x 20 px or more whose foot stands in the court and in the inner quadrilateral; nobody is followed here, so no earlier far player excuses one."""
    p = with_info(poses(spark, sf), spark, sf).withColumns({"fx": F.expr(_FOOT(0)), "fy": F.expr(_FOOTY(0))})
    return P.player_candidates(p, [f"q{k}" for k in range(8)]).select("match_id", "frame", "side", *r6("fx", "fy"))


@add("", "", "SELECT doc_id, CASE WHEN lower(trim(lang)) IN ('en', 'zh', 'es', 'de', 'id', 'ja') THEN lower(trim(lang)) ELSE 'other' END AS lang, substring(text, 1, 80) AS title, CAST(least(5000, greatest(0, n_chars)) AS BIGINT) AS n_chars FROM documents")
def c29_public_projection(spark, sf):
    """Allow-lists, length caps and clamps of a public boundary; the cut title is what the boundary shows."""
    d = table(spark, sf, "documents")
    lang = F.lower(F.trim("lang"))
    return d.select("doc_id", F.when(lang.isin("en", "zh", "es", "de", "id", "ja"), lang).otherwise("other").alias("lang"), F.substring("text", 1, 80).alias("title"), F.least(F.lit(5000), F.greatest(F.lit(0), F.col("n_chars"))).cast("long").alias("n_chars"))


_K = lambda e: re.sub(r"\[(\d+)\]", r"kp[\1]", e)
_KD = lambda e: re.sub(r"\[(\d+)\]", lambda m: f"kp[{int(m[1]) + 1}]", e)
_TORSO = G.dist("([5].x + [6].x) / 2", "([5].y + [6].y) / 2", "([11].x + [12].x) / 2", "([11].y + [12].y) / 2")
_REACH = f"greatest({G.dist('[5].x', '[5].y', '[9].x', '[9].y')}, {G.dist('[6].x', '[6].y', '[10].x', '[10].y')}) / nullif({_TORSO}, 0)"
_ANG = lambda a, b, c: G.angle(f"[{a}].x", f"[{a}].y", f"[{b}].x", f"[{b}].y", f"[{c}].x", f"[{c}].y")
_KNEE = f"least({_ANG(11, 13, 15)}, {_ANG(12, 14, 16)})"
_STANCE = f"{G.dist('[15].x', '[15].y', '[16].x', '[16].y')} / nullif({G.dist('[5].x', '[5].y', '[6].x', '[6].y')}, 0)"
_METR = f"mt AS (SELECT match_id, side, frame, {_KD(_REACH)} AS reach, {_KD(_KNEE)} AS knee, {_KD(_STANCE)} AS stance, kp[10].y < kp[6].y AS high, CASE WHEN kp[10].conf >= kp[11].conf THEN 'left' ELSE 'right' END AS arm, (kp[10].conf + kp[11].conf) / 2 AS conf FROM poses)"


def _metrics(spark, sf):
    return poses(spark, sf).select("match_id", "side", "frame", F.expr(_K(_REACH)).alias("reach"), F.expr(_K(_KNEE)).alias("knee"), F.expr(_K(_STANCE)).alias("stance"), (F.col("kp")[9]["y"] < F.col("kp")[5]["y"]).alias("high"), F.when(F.col("kp")[9]["conf"] >= F.col("kp")[10]["conf"], "left").otherwise("right").alias("arm"), ((F.col("kp")[9]["conf"] + F.col("kp")[10]["conf"]) / 2).alias("conf"))


_SCORES = {"reach": "({m} - 0.70) / 0.70 * 100", "knee": "(170.0 - {m}) / 35.0 * 100", "stance": "({m} - 0.50) / 0.55 * 100"}


@add("poses", _METR + ", ag AS (SELECT match_id, side, count(*) AS n, avg(reach) AS reach, avg(knee) AS knee, avg(stance) AS stance FROM mt GROUP BY ALL)", "SELECT match_id, side, CAST(n AS BIGINT) AS samples, " + ", ".join(f"round(least(100, greatest(0, {e.format(m=m)})), 6) AS {m}_score" for m, e in _SCORES.items()) + " FROM ag WHERE n >= 2")
def e14_coaching_scores(spark, sf):
    g = _metrics(spark, sf).groupBy("match_id", "side").agg(F.count("*").alias("samples"), *[F.avg(m).alias(m) for m in _SCORES]).where("samples >= 2")
    return g.select("match_id", "side", "samples", *[F.expr(f"round(least(100, greatest(0, {e.format(m=m)})), 6)").alias(f"{m}_score") for m, e in _SCORES.items()])


_NEAR = _METR + ", nr AS (SELECT h.hit_id, mt.*, row_number() OVER (PARTITION BY h.hit_id ORDER BY abs(mt.frame - h.frame), mt.frame) AS k FROM hits h JOIN mt ON mt.match_id = h.match_id AND mt.frame BETWEEN h.frame - 30 AND h.frame + 30), n3 AS (SELECT * FROM nr WHERE k <= 3)"


@add("hits poses", _NEAR, "SELECT hit_id, CAST(count(*) AS BIGINT) AS samples, round(median(reach), 6) AS reach, round(median(knee), 6) AS knee, round(avg(conf), 6) AS pose_confidence, CASE WHEN max(l) >= 0.67 THEN 'left' WHEN max(l) <= 0.33 THEN 'right' END AS arm FROM (SELECT *, avg((arm = 'left')::INT) OVER (PARTITION BY hit_id) AS l FROM n3) GROUP BY hit_id")
def e16_pose_metrics(spark, sf):
    """With E22: the three pose samples nearest to a hit, their medians, and the arm that two thirds agree on."""
    h = hits(spark, sf).select("hit_id", "match_id", F.col("frame").alias("hf"), F.explode(F.sequence(F.col("frame") - 30, F.col("frame") + 30)).alias("frame"))
    w = Window.partitionBy("hit_id").orderBy(F.abs(F.col("frame") - F.col("hf")), "frame")
    n = h.join(_metrics(spark, sf), ["match_id", "frame"]).withColumn("k", F.row_number().over(w)).where("k <= 3")
    left = F.avg((F.col("arm") == "left").cast("int"))
    return n.groupBy("hit_id").agg(F.count("*").alias("samples"), F.round(F.percentile("reach", F.lit(0.5)), 6).alias("reach"), F.round(F.percentile("knee", F.lit(0.5)), 6).alias("knee"), F.round(F.avg("conf"), 6).alias("pose_confidence"), F.when(left >= 0.67, "left").when(left <= 0.33, "right").alias("arm"))


_PHASE = _METR + ", ph AS (SELECT h.hit_id, mt.*, (mt.frame - h.frame) / fps AS dt FROM hits h JOIN info USING (match_id) JOIN mt ON mt.match_id = h.match_id AND mt.frame BETWEEN h.frame - 60 AND h.frame + 60)"


@add("hits poses info", _PHASE, "SELECT hit_id, CAST(count(*) FILTER (dt BETWEEN -0.5 AND -0.12) AS BIGINT) AS prep, CAST(count(*) FILTER (dt BETWEEN -0.2 AND 0.2) AS BIGINT) AS contact, CAST(count(*) FILTER (dt BETWEEN 0.2 AND 0.9) AS BIGINT) AS recovery, round(max(reach) FILTER (dt BETWEEN -0.2 AND 0.2), 6) AS peak_reach, round(arg_max(dt, (reach, -frame)) FILTER (dt BETWEEN -0.2 AND 0.2), 6) AS peak_at FROM ph GROUP BY hit_id")
def e17_phase_windows(spark, sf):
    h = with_info(hits(spark, sf).select("hit_id", "match_id", F.col("frame").alias("hf")), spark, sf).select("hit_id", "match_id", "hf", "fps", F.explode(F.sequence(F.col("hf") - 60, F.col("hf") + 60)).alias("frame"))
    p = h.join(_metrics(spark, sf), ["match_id", "frame"]).withColumn("dt", (F.col("frame") - F.col("hf")) / F.col("fps"))
    at = lambda a, b: F.col("dt").between(a, b)
    return p.groupBy("hit_id").agg(F.count_if(at(-0.5, -0.12)).alias("prep"), F.count_if(at(-0.2, 0.2)).alias("contact"), F.count_if(at(0.2, 0.9)).alias("recovery"), F.round(F.max(F.when(at(-0.2, 0.2), F.col("reach"))), 6).alias("peak_reach"), F.round(F.max_by("dt", F.when(at(-0.2, 0.2), F.struct(F.col("reach"), -F.col("frame")))), 6).alias("peak_at"))


@add("poses", _METR, "SELECT match_id, side, round(median(knee), 6) AS knee, round(avg((knee >= 160)::INT), 6) AS straight_share, round(quantile_cont(reach, 0.9) - quantile_cont(reach, 0.1), 6) AS sway, round(median(reach) FILTER (high), 6) AS overhead_reach FROM mt GROUP BY ALL")
def e18_motion_analysis(spark, sf):
    """A player's samples of one match are few, so exact percentiles are cheap."""
    p = lambda c, q: F.percentile(c, F.lit(q))
    g = _metrics(spark, sf).groupBy("match_id", "side").agg(p("knee", 0.5).alias("knee"), F.avg((F.col("knee") >= 160).cast("int")).alias("straight_share"), (p("reach", 0.9) - p("reach", 0.1)).alias("sway"), F.percentile(F.when(F.col("high"), F.col("reach")), F.lit(0.5)).alias("overhead_reach"))
    return g.select("match_id", "side", *r6("knee", "straight_share", "sway", "overhead_reach"))


_TIP = lambda w, e, c: f"kp[{w}].{c} + 0.35 * (kp[{w}].{c} - kp[{e}].{c})"
_D1 = lambda w, e: G.dist(_TIP(w, e, "x"), _TIP(w, e, "y"), "h.x", "h.y")
_STRICT = f"tp AS (SELECT h.hit_id, p.side, least({_D1(10, 8)}, {_D1(11, 9)}) / greatest({_KD(_TORSO)}, 4) AS d FROM hits h JOIN poses p ON p.match_id = h.match_id AND p.frame BETWEEN h.frame - 20 AND h.frame + 20 WHERE h.x IS NOT NULL AND h.y IS NOT NULL), sd AS (SELECT hit_id, min(d) FILTER (side = 'near') AS dn, min(d) FILTER (side = 'far') AS df FROM tp GROUP BY hit_id), pk AS (SELECT *, least(dn, df) AS best, CASE WHEN dn IS NOT NULL AND (df IS NULL OR dn <= df) THEN 'near' ELSE 'far' END AS side, abs(dn - df) AS margin FROM sd)"


def _strict(spark, sf, most: float = 7.5):
    h = hits(spark, sf).where("x is not null and y is not null").select("hit_id", "match_id", F.struct("x", "y").alias("h"), F.explode(F.sequence(F.col("frame") - 20, F.col("frame") + 20)).alias("frame"))
    tip = lambda w, e, c: f"kp[{w}].{c} + 0.35 * (kp[{w}].{c} - kp[{e}].{c})"
    d1 = lambda w, e: G.dist(tip(w, e, "x"), tip(w, e, "y"), "h.x", "h.y")
    t = h.join(poses(spark, sf), ["match_id", "frame"]).select("hit_id", "side", F.expr(f"least({d1(9, 7)}, {d1(10, 8)}) / greatest({_K(_TORSO)}, 4)").alias("d"))
    g = t.groupBy("hit_id").agg(F.min(F.when(F.col("side") == "near", F.col("d"))).alias("dn"), F.min(F.when(F.col("side") == "far", F.col("d"))).alias("df"))
    side = F.when(F.col("dn").isNotNull() & (F.col("df").isNull() | (F.col("dn") <= F.col("df"))), "near").otherwise("far")
    g = g.select("hit_id", side.alias("side"), F.least("dn", "df").alias("best"), F.abs(F.col("dn") - F.col("df")).alias("margin"))
    ok = F.when(F.col("margin").isNull(), F.col("best") <= most).otherwise((F.col("best") <= most * 1.4) & (F.col("margin") >= 0.35))
    return g.where(ok).select("hit_id", "side", F.round(0.5 + 0.3 * (1 - F.least(F.lit(1.0), F.col("best") / (most * 1.4))) + 0.15 * F.least(F.lit(1.0), F.coalesce("margin", F.lit(0.0))), 6).alias("confidence"))


_SCONF = "round(0.5 + 0.3 * (1 - least(1, best / 10.5)) + 0.15 * least(1, coalesce(margin, 0)), 6)"
_SOK = "CASE WHEN margin IS NULL THEN best <= 7.5 ELSE best <= 10.5 AND margin >= 0.35 END"


@add("hits poses", _STRICT, f"SELECT hit_id, side, {_SCONF} AS confidence FROM pk WHERE {_SOK}")
def f28_strict_hitter(spark, sf):
    """With B25 and K4: the side whose racket tip is nearest to the hit. Limits are ten times the usual, as the made-up players stand anywhere."""
    return _strict(spark, sf)


@add("hits poses", _STRICT + f", ev AS (SELECT hit_id, side, {_SCONF} AS c FROM pk WHERE {_SOK})", "SELECT h.hit_id, CASE WHEN ev.side IS NULL THEN CASE WHEN hitter_source = 'legacy_side' AND coalesce(hitter_confidence, 0.48) < 0.6 THEN 'unknown' ELSE hitter END WHEN hitter = 'unknown' OR coalesce(hitter_source = 'legacy_side', false) OR ev.c >= coalesce(hitter_confidence, 0.48) + 0.16 THEN ev.side ELSE hitter END AS hitter FROM hits h LEFT JOIN ev USING (hit_id)")
def k05_pose_associations(spark, sf):
    """With K6 (a missing confidence counts 0.48): pose evidence replaces an unknown, legacy or clearly weaker side; a weak legacy side without evidence becomes unknown."""
    e = _strict(spark, sf).select("hit_id", F.col("side").alias("es"), F.col("confidence").alias("ec"))
    conf, legacy = F.coalesce("hitter_confidence", F.lit(0.48)), F.coalesce(F.col("hitter_source") == "legacy_side", F.lit(False))
    side = F.when(F.col("es").isNull(), F.when(legacy & (conf < 0.6), "unknown").otherwise(F.col("hitter"))).when((F.col("hitter") == "unknown") | legacy | (F.col("ec") >= conf + 0.16), F.col("es")).otherwise(F.col("hitter"))
    return hits(spark, sf).join(e, "hit_id", "left").select("hit_id", side.alias("hitter"))


@add("track", "", "SELECT match_id, frame, CASE WHEN raw_vis AND raw_source IN ('model', 'classical') THEN raw_x WHEN vis AND source IN ('model', 'classical') THEN x END AS mx, CASE WHEN raw_vis AND raw_source IN ('model', 'classical') THEN raw_y WHEN vis AND source IN ('model', 'classical') THEN y END AS my FROM track WHERE (raw_vis AND raw_source IN ('model', 'classical')) OR (vis AND source IN ('model', 'classical'))")
def k02_measured_points(spark, sf):
    """With K1 and K3: the raw point where it was measured, else the smoothed one under the same test."""
    t = track(spark, sf)
    raw, own = F.col("raw_vis") & F.col("raw_source").isin("model", "classical"), F.col("vis") & F.col("source").isin("model", "classical")
    return t.where(raw | own).select("match_id", "frame", F.when(raw, F.col("raw_x")).otherwise(F.col("x")).alias("mx"), F.when(raw, F.col("raw_y")).otherwise(F.col("y")).alias("my"))


_FX, _FY = G.project("(b0 + b2) / 2 + 250", "b3 + 250")


@add("poses info", f"s AS (SELECT match_id, frame, side AS given, {_FY} AS cy, b3 + 250 AS fy, height FROM poses JOIN info USING (match_id))", "SELECT match_id, frame, CASE WHEN coalesce(cy < 6.7, fy < height / 2) THEN 'far' ELSE 'near' END AS side FROM s")
def k07_pose_sides(spark, sf):
    """Far or near by the foot's court position, by the middle of the picture where it can't be projected."""
    p = with_info(poses(spark, sf), spark, sf)
    return p.select("match_id", "frame", F.expr(f"CASE WHEN coalesce({_FY} < 6.7, b3 + 250 < height / 2) THEN 'far' ELSE 'near' END").alias("side"))


@add("track", "", "SELECT match_id, min(frame) AS first_cut FROM track WHERE frame > 0 AND frame % 1500 = 0 GROUP BY match_id")
def k10_first_cut(spark, sf):
    return track(spark, sf).where("frame > 0 AND frame % 1500 = 0").groupBy("match_id").agg(F.min("frame").alias("first_cut"))


@add("hits", "g AS (SELECT match_id, avg(coalesce(hitter_confidence, 0)) * avg((hitter <> 'unknown')::INT) AS s FROM hits GROUP BY match_id)", "SELECT match_id, round(s, 6) AS score, CASE WHEN s >= 0.72 THEN 'high' WHEN s >= 0.57 THEN 'medium' ELSE 'low' END AS label FROM g")
def k14_confidence_labels(spark, sf):
    g = hits(spark, sf).groupBy("match_id").agg((F.avg(F.coalesce("hitter_confidence", F.lit(0.0))) * F.avg((F.col("hitter") != "unknown").cast("int"))).alias("s"))
    return g.select("match_id", F.round("s", 6).alias("score"), F.when(F.col("s") >= 0.72, "high").when(F.col("s") >= 0.57, "medium").otherwise("low").alias("label"))


_ELBOW = f"greatest({_ANG(5, 7, 9)}, {_ANG(6, 8, 10)})"
_SIG = _STROKE + ", " + _FAM + f""", mt AS (SELECT match_id, frame, {_KD(_REACH)} AS reach, {_KD(_KNEE)} AS knee, {_KD(_STANCE)} AS stance, {_KD(_ELBOW)} AS elbow, kp[10].y < kp[6].y AS high, (kp[10].conf + kp[11].conf) / 2 AS conf FROM poses),
ms AS (SELECT fc.hit_id, fc.family, count(*) AS n, avg(conf) AS conf, median(knee) AS knee, median(stance) AS stance, median(elbow) AS elbow, median(reach) AS reach, avg(mt.high::INT) AS hs FROM fc JOIN mt ON mt.match_id = fc.match_id AND mt.frame BETWEEN fc.frame - 30 AND fc.frame + 30 GROUP BY ALL)"""
_FRONT, _BACK = ("'net', 'lift', 'push', 'cross_net', 'net_kill', 'front_unknown'", "'clear', 'drive_clear', 'drop', 'smash', 'defensive_drive', 'back_unknown'")


@add("hits info poses", _SIG, f"SELECT hit_id, CASE WHEN n >= 2 AND conf >= 0.4 THEN list_filter([CASE WHEN family = 'serve' AND n >= 3 AND (knee >= 165 OR stance < 0.52) THEN 'serve_preparation' END, CASE WHEN family IN ({_FRONT}) AND n >= 3 AND (knee >= 168 OR stance < 0.48) THEN 'front_support' END, CASE WHEN family IN ({_BACK}) AND n >= 3 AND hs >= 0.67 AND elbow < 145 AND reach < 1.05 THEN 'overhead_extension' END, CASE WHEN family IN ({_BACK}) AND n >= 3 AND knee >= 170 THEN 'back_support' END], lambda v: v IS NOT NULL) ELSE CAST([] AS VARCHAR[]) END AS signals FROM ms")
def h10_posture_signals(spark, sf):
    """The posture rules over the pose samples within 30 frames of a stroke; advice texts aren't built."""
    m = poses(spark, sf).select("match_id", "frame", F.expr(_K(_REACH)).alias("reach"), F.expr(_K(_KNEE)).alias("knee"), F.expr(_K(_STANCE)).alias("stance"), F.expr(_K(_ELBOW)).alias("elbow"), (F.col("kp")[9]["y"] < F.col("kp")[5]["y"]).cast("int").alias("high"), ((F.col("kp")[9]["conf"] + F.col("kp")[10]["conf"]) / 2).alias("conf"))
    h = _classified(spark, sf).select("hit_id", "family", "match_id", F.explode(F.sequence(F.col("frame") - 30, F.col("frame") + 30)).alias("frame"))
    mid = lambda c: F.percentile(c, F.lit(0.5)).alias(c)
    g = h.join(m, ["match_id", "frame"]).groupBy("hit_id", "family").agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), mid("knee"), mid("stance"), mid("elbow"), mid("reach"), F.avg("high").alias("hs"))
    return g.select("hit_id", posture_signals(*[F.col(c) for c in ("family", "n", "conf", "knee", "stance", "elbow", "reach", "hs")]).alias("signals"))


#: What a review knows of a stroke, made from hit_id; the same input in both engines.
_KNOWN = {
    "contact_samples": "hit_id % 6", "pose_confidence": "(hit_id % 21) / 2e1", "knee": "150e0 + hit_id % 30", "knee_samples": "hit_id % 5", "stance": "4e-1 + (hit_id % 11) / 2e1", "stance_samples": "(hit_id + 1) % 5", "elbow": "120e0 + hit_id % 50", "elbow_samples": "(hit_id + 2) % 5",
    "reach": "8e-1 + (hit_id % 9) / 1e1", "reach_samples": "(hit_id + 3) % 5", "contact_distance": "5e-1 + (hit_id % 13) / 2e1", "contact_distance_samples": "(hit_id + 4) % 5", "post_motion_m": "(hit_id % 10) / 2e1", "arm": "CASE hit_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'unknown' END",
    "arm_above_share": "(hit_id % 7) / 6e0", "arm_above_samples": "hit_id % 6", "prep_samples": "hit_id % 5", "prep_knee": "150e0 + hit_id % 25", "prep_knee_samples": "hit_id % 5", "prep_stance": "4e-1 + (hit_id % 8) / 2e1", "prep_stance_samples": "(hit_id + 1) % 5", "prep_wrist": "(hit_id % 5) / 2e1 - 2e-1",
    "contact_wrist": "(hit_id % 7) / 2e1", "contact_wrist_samples": "hit_id % 4", "peak_wrist_speed": "(hit_id % 9) / 4e0", "flight_seconds": "(hit_id % 17) / 1e1", "recovery_intervals": "hit_id % 6", "recovery_observed": "(hit_id % 11) / 1e1", "recovery_stable": "hit_id % 4 = 0", "recovery_stable_seconds": "(hit_id % 10) / 1e1",
    "phase_confidence": "8e-1 + (hit_id % 9) / 4e1", "real_points": "3 + hit_id % 8",
}


def _reviewed(spark, sf):
    n = F.col("hit_id") % 5
    given = F.when(n == 0, F.array(F.lit("arm_unresolved"))).when(n == 1, F.array(F.lit("prep_samples_low"))).when(n == 2, F.array(F.lit("recovery_samples_low"))).otherwise(F.array().cast("array<string>"))
    h = _classified(spark, sf).select("hit_id", "match_id", "rally", "idx", "frame", "family", "confidence", F.col("confirmed").alias("event_confirmed"), "candidate", given.alias("phase_reasons"), *[F.expr(e).alias(c) for c, e in _KNOWN.items()])
    return K.reviewed(h)


_LIST = lambda rules: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items()) + "], lambda v: v IS NOT NULL)"
_OVER = "'clear', 'drive_clear', 'drop', 'smash'"
_LOW = lambda k, s: f"((knee_samples >= 3 AND knee >= {k}) OR (stance_samples >= 3 AND stance < {s}))"
_GATES = _STROKE + ", " + _FAM + f""", kn AS (SELECT fc.hit_id, match_id, rally, idx, frame, family, least(least(score0, c1), least(c2, c3)) AS confidence, confirmed, candidate, {', '.join(f'{e} AS {c}' for c, e in _KNOWN.items())} FROM fc),
s1 AS (SELECT *, contact_samples >= 2 AND pose_confidence >= 0.45 AS shown, """ + _LIST({
    "serve_preparation": f"family = 'serve' AND {_LOW(165, 0.52)}", "serve_first_step": "family = 'serve' AND post_motion_m < 0.18", "front_support": f"family IN ({_FRONT}) AND {_LOW(168, 0.48)}", "front_contact_space": f"family IN ({_FRONT}) AND contact_distance_samples >= 3 AND contact_distance < 0.78",
    "overhead_extension": f"family IN ({_OVER}) AND arm <> 'unknown' AND arm_above_share >= 0.67 AND arm_above_samples >= 3 AND elbow_samples >= 3 AND elbow < 145 AND reach_samples >= 3 AND reach < 1.05", "back_support": f"family IN ({_BACK}) AND knee_samples >= 3 AND knee >= 170",
}) + " AS sig, " + _LIST({
    "preparation_support": "prep_samples >= 3 AND ((prep_knee_samples >= 3 AND prep_knee >= 165) OR (prep_stance_samples >= 3 AND prep_stance < 0.52))", "overhead_preparation": "prep_samples >= 3 AND prep_wrist < -0.08 AND contact_wrist >= 0.05 AND contact_wrist_samples >= 2 AND peak_wrist_speed >= 1",
    "recovery_stability": "flight_seconds >= 0.75 AND recovery_intervals >= 3 AND recovery_observed >= 0.7 AND (NOT recovery_stable OR recovery_stable_seconds > 0.65)",
}) + " AS psig FROM kn), s2 AS (SELECT * EXCLUDE (sig, psig), CASE WHEN shown THEN sig ELSE [] END AS signals, CASE WHEN shown THEN psig ELSE [] END AS phase_signals FROM s1), s3 AS (SELECT *, " + _LIST({
    "stroke_family_unknown": "family IN ('unknown', 'front_unknown', 'back_unknown')", "stroke_confidence_low": "confidence < 72", "contact_samples_low": "contact_samples < 3", "pose_confidence_low": "pose_confidence < 0.8", "trajectory_points_low": "real_points < 6", "no_actionable_signal": "len(signals) = 0",
}) + " AS type_reasons, " + _LIST({
    "event_unconfirmed": "NOT confirmed", "contact_samples_low": "contact_samples < 3", "phase_pose_confidence_low": "phase_confidence < 0.8", "trajectory_points_low": "real_points < 6", "arm_unresolved": "hit_id % 5 = 0", "prep_samples_low": "hit_id % 5 = 1 AND (list_contains(phase_signals, 'preparation_support') OR list_contains(phase_signals, 'overhead_preparation'))",
    "recovery_samples_low": "hit_id % 5 = 2 AND list_contains(phase_signals, 'recovery_stability')", "no_actionable_phase_signal": "len(phase_signals) = 0",
}) + " AS phase_reasons FROM s2), s4 AS (SELECT *, list_concat(CASE WHEN len(type_reasons) = 0 THEN signals ELSE [] END, CASE WHEN len(phase_reasons) = 0 THEN phase_signals ELSE [] END) AS eligible FROM s3)"


@add("hits info", _GATES, "SELECT hit_id, signals, phase_signals, type_reasons, phase_reasons, eligible AS eligible_signals FROM s4")
def c25_coaching_gates(spark, sf):
    """With H10: the signals of a stroke and of its phases, and what keeps either from counting, in a fixed order. What a review knows of a stroke is made from hit_id."""
    return _reviewed(spark, sf).select("hit_id", "signals", "phase_signals", "type_reasons", F.col("phase_reasons_all").alias("phase_reasons"), "eligible_signals")


_ADVICE = _GATES + """, rv AS (SELECT * FROM s4 WHERE candidate),
torn AS (SELECT match_id, rally, idx FROM rv JOIN (SELECT match_id, frame FROM rv GROUP BY ALL HAVING count(DISTINCT (rally, idx)) > 1) USING (match_id, frame)),
ones AS (SELECT match_id, rally, idx, max(family) AS family, unnest(arg_min(eligible, hit_id)) AS signal FROM rv WHERE (match_id, rally, idx) NOT IN (SELECT (match_id, rally, idx) FROM torn) GROUP BY match_id, rally, idx),
fits AS (SELECT * FROM ones WHERE signal IN ('preparation_support', 'overhead_preparation', 'recovery_stability') OR (signal LIKE 'serve%' AND family = 'serve') OR (signal LIKE 'front%' AND family IN ('net', 'lift', 'push', 'cross_net', 'net_kill')) OR (signal = 'overhead_extension' AND family IN ('clear', 'drive_clear', 'drop', 'smash')) OR (signal = 'back_support' AND family IN ('clear', 'drive_clear', 'drop', 'smash', 'defensive_drive'))),
adv AS (SELECT match_id, CASE WHEN signal LIKE 'serve%' THEN 'serve' WHEN signal LIKE 'front%' THEN 'frontcourt' WHEN signal LIKE 'overhead%' THEN 'overhead' WHEN signal LIKE 'back%' THEN 'backcourt' WHEN signal LIKE 'prep%' THEN 'preparation' ELSE 'recovery' END AS coach_group, signal, count(*) AS hits FROM fits GROUP BY ALL HAVING count(*) >= 3)"""


@add("hits info", _ADVICE, "SELECT match_id, coach_group, signal, hits, CAST(row_number() OVER w AS BIGINT) AS place, CASE WHEN hits >= 5 THEN 'high' ELSE 'medium' END AS priority FROM adv WINDOW w AS (PARTITION BY match_id ORDER BY hits DESC, coach_group, signal) QUALIFY row_number() OVER w <= 3")
def e15_recommendations(spark, sf):
    """With C26 and K13: the three commonest signals of a match that three independent hits show: a top-k report."""
    return K.recommendations(K.independent_hits(_reviewed(spark, sf).where("candidate"))).select("match_id", "coach_group", "signal", "hits", "place", "priority")
