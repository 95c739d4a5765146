"""Reference queries: summaries, shots, movement and local statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtlane.functions import geometry as G
from courtlane.operators import shots as S
from courtlane.operators.sequence import anchors, around, at_offsets, runs, suppressed
from courtlane.plans.ref_hits import nms_sql
from courtlane.plans.views import DERIVED, EDGE, MEASURED, REAL, Registry, hits, info, phases, poses, quoted, r6, r6_sql, track, with_info

add = Registry()


@add("track info", "", """SELECT match_id, CAST(count(*) AS BIGINT) AS frame_count, CAST(count(*) FILTER (hit) AS BIGINT) AS hit_count, CAST(count(DISTINCT CASE WHEN rally > 0 THEN rally END) AS BIGINT) AS rally_count, round(avg(vis::INT), 6) AS visible_coverage, round(avg((source IN ('model', 'classical'))::INT), 6) AS real_coverage,
 round(max(speed) FILTER (hit AND speed >= 0), 6) AS max_speed_kmh, round(avg(speed) FILTER (hit AND speed >= 0), 6) AS avg_speed_kmh, round(count(*) / greatest(1, max(fps)), 6) AS duration_seconds FROM track JOIN info USING (match_id) GROUP BY match_id""")
def e01_sidecar_summary(spark, sf):
    d = S.summary(track(spark, sf), info(spark, sf))
    return d.select("match_id", "frame_count", "hit_count", "rally_count", *r6("visible_coverage", "real_coverage", "max_speed_kmh", "avg_speed_kmh", "duration_seconds"))


@add("track", "", f"SELECT match_id, round(avg(vis::INT), 6) AS total, round(avg((vis AND source IN ({quoted(REAL)}))::INT), 6) AS real, round(avg((vis AND source IN ({quoted(EDGE + DERIVED)}))::INT), 6) AS derived FROM track GROUP BY match_id")
def e02_coverage(spark, sf):
    return S.coverage(track(spark, sf), REAL, EDGE + DERIVED).select("match_id", *r6("total", "real", "derived"))


_SEGM = """g AS (SELECT match_id, rally, min(frame) AS t0, max(frame) AS end_frame, min(CASE WHEN hit THEN frame END) AS h0, count(*) FILTER (hit) AS hit_count FROM track WHERE rally > 0 GROUP BY match_id, rally),
g1 AS (SELECT g.*, coalesce(h0, t0) AS start_frame, greatest(0, coalesce(h0, t0) / greatest(1, fps) - 0.8) AS s, (end_frame + 1) / greatest(1, fps) + 1.0 AS e FROM g JOIN info USING (match_id)),
g2 AS (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS ns, row_number() OVER w AS segment_index FROM g1 WHERE e - s >= 1.5 WINDOW w AS (PARTITION BY match_id ORDER BY t0, rally))"""


@add("track info", _SEGM, "SELECT match_id, CAST(segment_index AS BIGINT) AS segment_index, rally, start_frame, end_frame, round(CASE WHEN pe > s THEN (pe + s) / 2 ELSE s END, 6) AS start_seconds, round(CASE WHEN e > ns THEN (e + ns) / 2 ELSE e END, 6) AS end_seconds, CAST(hit_count AS BIGINT) AS hit_count, CASE WHEN hit_count >= 2 THEN 'hit_anchored' WHEN hit_count = 1 THEN 'single_hit' ELSE 'trajectory_fallback' END AS quality, CASE WHEN h0 IS NULL THEN 'first_trajectory' ELSE 'first_hit' END AS start_reason FROM g2")
def e04_rally_segments(spark, sf):
    """With D12: overlapping padded clips are parted in the middle."""
    d = S.rally_segments(track(spark, sf), info(spark, sf))
    return d.select("match_id", "segment_index", "rally", "start_frame", "end_frame", *r6("start_seconds", "end_seconds"), "hit_count", "quality", "start_reason")


@add("hits", "b AS (SELECT match_id, rally, count(*) FILTER (hitter = 'near') AS a, count(*) FILTER (hitter = 'far') AS f, count(*) AS n FROM hits WHERE rally > 0 GROUP BY match_id, rally)", "SELECT match_id, rally, CAST(a AS BIGINT) AS near_count, CAST(f AS BIGINT) AS far_count, CAST(n - a - f AS BIGINT) AS unknown_count, CAST(abs(a - f) AS BIGINT) AS difference, abs(a - f) <= 1 AS within_one, n = a + f AS complete FROM b")
def e05_hitter_balance(spark, sf):
    return S.hitter_balance(hits(spark, sf))


_EVAL = "ev AS (SELECT match_id, CASE WHEN NOT a_vis AND NOT b_vis THEN 'TN' WHEN b_vis AND NOT a_vis THEN 'FP2' WHEN a_vis AND NOT b_vis THEN 'FN' WHEN sqrt((a_x - b_x) * (a_x - b_x) + (a_y - b_y) * (a_y - b_y)) > 4 THEN 'FP1' ELSE 'TP' END AS kind FROM phases)"


def _typed(spark, sf):
    p = phases(spark, sf)
    off = F.sqrt((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2)
    kind = F.when(~F.col("a_vis") & ~F.col("b_vis"), "TN").when(~F.col("a_vis"), "FP2").when(~F.col("b_vis"), "FN").when(off > 4, "FP1").otherwise("TP")
    return p.select("match_id", kind.alias("kind"))


_METRIC = "c AS (SELECT match_id, count(*) AS n, count(*) FILTER (kind = 'TP') AS tp, count(*) FILTER (kind = 'TN') AS tn, count(*) FILTER (kind IN ('FP1', 'FP2')) AS fp, count(*) FILTER (kind = 'FN') AS fn FROM ev GROUP BY match_id)"


@add("phases", f"{_EVAL}, {_METRIC}", "SELECT match_id, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fn / nullif(tp + fn, 0), 0), 6) AS miss_rate FROM c")
def e06_detection_metrics(spark, sf):
    """The primary phase as truth, the secondary as prediction."""
    k = lambda *names: F.count_if(F.col("kind").isin(*names))
    c = _typed(spark, sf).groupBy("match_id").agg(F.count("*").alias("n"), k("TP").alias("tp"), k("TN").alias("tn"), k("FP1", "FP2").alias("fp"), k("FN").alias("fn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("match_id", ratio(tp + F.col("tn"), F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fn, tp + fn).alias("miss_rate"))


@add("phases", _EVAL, "SELECT match_id, kind, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY match_id, kind")
def e07_prediction_types(spark, sf):
    return _typed(spark, sf).groupBy("match_id", "kind").agg(F.count("*").alias("n"))


@add("phases", "", "SELECT match_id, round(avg(-((1 - p) * (1 - p) * y * ln(least(1, greatest(1e-7, p))) + p * p * (1 - y) * ln(least(1, greatest(1e-7, 1 - p))))), 6) AS loss FROM (SELECT match_id, coalesce(b_conf, 0) AS p, a_vis::INT AS y FROM phases) GROUP BY match_id")
def e08_weighted_bce(spark, sf):
    p = phases(spark, sf).select("match_id", F.coalesce("b_conf", F.lit(0.0)).alias("p"), F.col("a_vis").cast("int").alias("y"))
    loss = -((1 - F.col("p")) ** 2 * F.col("y") * F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-7), F.col("p")))) + F.col("p") ** 2 * (1 - F.col("y")) * F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-7), 1 - F.col("p")))))
    return p.groupBy("match_id").agg(F.round(F.avg(loss), 6).alias("loss"))


_X, _Y = G.project("x", "y")
_PX, _PY = G.project("(b0 + b2) / 2 + 250", "b3 + 250")
_PLAYER = f"pl AS (SELECT match_id, side, frame, fps, {_PX} AS mx, {_PY} AS my FROM poses JOIN info USING (match_id))"


def _players(spark, sf):
    p = with_info(poses(spark, sf), spark, sf)
    return p.select("match_id", "side", "frame", "fps", F.expr(_PX).alias("mx"), F.expr(_PY).alias("my"))


@add("poses info", f"{_PLAYER}, m1 AS (SELECT *, (frame - lag(frame) OVER w) / greatest(fps, 1e-6) AS dt, sqrt(pow(mx - lag(mx) OVER w, 2) + pow(my - lag(my) OVER w, 2)) AS d FROM pl WHERE mx IS NOT NULL WINDOW w AS (PARTITION BY match_id, side ORDER BY frame))", "SELECT match_id, side, round(coalesce(sum(d) FILTER (d <= 8 * dt + 0.05), 0), 6) AS distance_m, round(coalesce(sum(dt) FILTER (d <= 8 * dt + 0.05), 0), 6) AS seconds, round(coalesce(max(d / greatest(dt, 1e-6)) FILTER (d <= 8 * dt + 0.05), 0), 6) AS max_speed FROM m1 GROUP BY match_id, side")
def e09_motion(spark, sf):
    return S.motion(_players(spark, sf), F.col("fps")).select("match_id", "side", *r6("distance_m", "seconds", "max_speed"))


_SHOT = f"""hf AS (SELECT DISTINCT match_id, frame FROM hits),
sh AS (SELECT match_id, frame AS a, lead(frame) OVER (PARTITION BY match_id ORDER BY frame) AS b FROM hf),
pt AS (SELECT match_id, frame, greatest(fps, 1e-6) AS fps, source, CASE WHEN ok THEN mx END AS mx, CASE WHEN ok THEN my END AS my, coalesce(ok, false) AND source IN ({quoted(REAL)}) AS real FROM (SELECT *, vis AND source IN ({quoted(MEASURED)}) AND mx BETWEEN -6 AND {G.COURT_W + 6} AND my BETWEEN -6 AND {G.COURT_L + 6} AS ok FROM (SELECT match_id, frame, vis, source, fps, {_X} AS mx, {_Y} AS my FROM track JOIN info USING (match_id)))),
st AS (SELECT p.*, sqrt((p.mx - q.mx) * (p.mx - q.mx) + (p.my - q.my) * (p.my - q.my)) AS step FROM pt p LEFT JOIN pt q ON q.match_id = p.match_id AND q.frame = p.frame - 1),
js AS (SELECT st.*, a, b, coalesce(step * st.fps > 160, false) AS fast FROM sh JOIN st ON st.match_id = sh.match_id AND st.frame > a AND st.frame <= b WHERE b IS NOT NULL),
fr AS (SELECT match_id, frame, (row_number() OVER (PARTITION BY match_id, a, g ORDER BY frame) - 1) % 2 = 0 AS rejected FROM (SELECT match_id, frame, a, frame - row_number() OVER (PARTITION BY match_id, a ORDER BY frame) AS g FROM js WHERE fast)),
jr AS (SELECT js.*, coalesce(fr.rejected, false) AS rejected FROM js LEFT JOIN fr USING (match_id, frame)),
jc AS (SELECT *, step IS NOT NULL AND NOT fast AND NOT coalesce(max(CASE WHEN rejected THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, a ORDER BY frame RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) = 1, false) AS counted FROM jr),
sg AS (SELECT match_id, a, b, max(fps) AS fps, coalesce(sum(step) FILTER (counted), 0) AS distance_m, count(*) FILTER (counted) AS segments, count(*) FILTER (real) AS rp FROM jc GROUP BY match_id, a, b),
sp AS (SELECT sg.match_id, a AS start_frame, b AS end_frame, distance_m, segments, rp + CASE WHEN p.real THEN 1 ELSE 0 END AS real_points, segments / sg.fps AS observed_seconds, segments / sg.fps / greatest((b - a) / sg.fps, 1e-6) AS coverage FROM sg LEFT JOIN pt p ON p.match_id = sg.match_id AND p.frame = a),
shots AS (SELECT *, CASE WHEN real_points < 2 THEN 'insufficient_real_points' WHEN segments < 3 THEN 'insufficient_segments' WHEN coverage < 0.55 THEN 'insufficient_coverage' WHEN distance_m / observed_seconds <= 55 THEN 'ok' ELSE 'average_speed_outlier' END AS quality, CASE WHEN segments > 0 THEN distance_m / observed_seconds * 3.6 END AS kmh FROM sp)"""


def _shots(spark, sf):
    return S.shot_speeds(track(spark, sf), hits(spark, sf), info(spark, sf), MEASURED, REAL)


@add("track hits info", _SHOT, "SELECT match_id, start_frame, end_frame, round(distance_m, 6) AS distance_m, round(observed_seconds, 6) AS observed_seconds, round(coverage, 6) AS coverage, CAST(real_points AS BIGINT) AS real_points, CAST(segments AS BIGINT) AS segments, round(CASE WHEN quality = 'ok' THEN kmh END, 6) AS speed_kmh, quality FROM shots")
def e10_shot_speeds(spark, sf):
    return _shots(spark, sf).select("match_id", "start_frame", "end_frame", *r6("distance_m", "observed_seconds", "coverage"), "real_points", "segments", *r6("speed_kmh"), "quality")


@add("track hits info", _SHOT, "SELECT match_id, start_frame, round(ceil(cume_dist() OVER (PARTITION BY match_id ORDER BY round(kmh, 6)) * 1e9) / 1e9, 6) AS speed_percentile FROM shots WHERE quality = 'ok'")
def f31_speed_percentile(spark, sf):
    """Share of the match's reliable shots that are not faster; a window over shots, a thousandth of the frames."""
    w = Window.partitionBy("match_id").orderBy(F.round("speed_kmh", 6))
    return _shots(spark, sf).where("quality = 'ok'").select("match_id", "start_frame", F.round(F.ceil(F.cume_dist().over(w) * 1e9) / 1e9, 6).alias("speed_percentile"))


_HEAT = f"{_PLAYER}, hw AS (SELECT *, least(12, coalesce(frame - lag(frame) OVER (PARTITION BY match_id, side ORDER BY frame), 1)) AS w FROM pl WHERE mx IS NOT NULL)"


@add("poses info", _HEAT, f"SELECT match_id, side, CAST(least(66, greatest(0, floor(my / {G.COURT_L} * 67))) AS BIGINT) AS row, CAST(least(30, greatest(0, floor(mx / {G.COURT_W} * 31))) AS BIGINT) AS col, CAST(sum(w) AS DOUBLE) AS weight FROM hw GROUP BY ALL")
def e11_heatmap(spark, sf):
    return S.heatmap(_players(spark, sf))


@add("track info", f"n AS (SELECT match_id, greatest(1, floor(count(*) / 2000)) AS step FROM track GROUP BY match_id), c AS (SELECT match_id, least({G.COURT_W}, greatest(0, {_X})) AS cx, least({G.COURT_L}, greatest(0, {_Y})) AS cy FROM track JOIN info USING (match_id) JOIN n USING (match_id) WHERE vis AND frame % step = 0)", f"SELECT match_id, round(CASE WHEN count(*) >= 50 THEN least({G.COURT_W / 4}, greatest({-G.COURT_W / 4}, {G.COURT_W / 2} - median(cx))) ELSE 0 END, 6) AS shift_m FROM c WHERE cy BETWEEN 0.05 AND {G.COURT_L - 0.05} GROUP BY match_id")
def e12_centre_shift(spark, sf):
    return S.centre_shift(track(spark, sf), info(spark, sf)).select("match_id", *r6("shift_m"))


_TRAJ = """hf AS (SELECT DISTINCT match_id, frame FROM hits), sh AS (SELECT match_id, frame AS a, lead(frame) OVER (PARTITION BY match_id ORDER BY frame) AS b FROM hf),
mp AS (SELECT sh.match_id, a, b, t.frame, y FROM sh JOIN track t ON t.match_id = sh.match_id AND t.frame BETWEEN a AND b WHERE b IS NOT NULL AND vis AND source IN ('model', 'classical')),
en AS (SELECT match_id, a, b, count(*) AS n, min(frame) AS f0, max(frame) AS f1, arg_min(y, frame) AS y0, arg_max(y, frame) AS y1 FROM mp GROUP BY match_id, a, b),
of AS (SELECT mp.*, n, f0, f1, fps, greatest(q5, q7) - least(q1, q3) AS tall, y0, y1 FROM mp JOIN en USING (match_id, a, b) JOIN info USING (match_id))"""


@add("track hits info", _TRAJ, "SELECT match_id, a AS start_frame, b AS end_frame, CAST(max(n) AS BIGINT) AS real_points, round(max((f1 - f0) / greatest(fps, 1)), 6) AS flight_seconds, round(coalesce(max(CASE WHEN frame > f0 AND frame < f1 AND n >= 4 AND tall > 1 THEN abs(y - y0 - (frame - f0) / (f1 - f0) * (y1 - y0)) / tall END), 0), 6) AS arc FROM of GROUP BY match_id, a, b")
def e19_trajectory_metrics(spark, sf):
    shots = anchors(hits(spark, sf).select("match_id", "frame").distinct(), after={"end_frame": F.col("frame")}).where("end_frame is not null").withColumnRenamed("frame", "start_frame")
    return S.trajectory_metrics(track(spark, sf), shots, info(spark, sf)).select("match_id", "start_frame", "end_frame", "real_points", *r6("flight_seconds", "arc"))


_DIR = """hd AS (SELECT h.hit_id, h.match_id, h.frame AS a, h.frame + greatest(6, CAST(floor(0.55 * greatest(1, fps) + 0.5) AS BIGINT)) AS b, greatest(q5, q7) - least(q1, q3) AS tall FROM hits h JOIN info USING (match_id)),
dp AS (SELECT hit_id, tall, t.frame, y, lag(t.frame) OVER w AS pf, lag(y) OVER w AS py FROM hd JOIN track t ON t.match_id = hd.match_id AND t.frame > a AND t.frame <= b WHERE vis AND source IN ('model', 'classical') WINDOW w AS (PARTITION BY hit_id ORDER BY t.frame)),
dv AS (SELECT hit_id, max(tall) AS tall, count(*) AS n, count(*) FILTER (frame - pf <= 2) AS k, median((y - py) / (frame - pf)) FILTER (frame - pf <= 2) AS v FROM dp GROUP BY hit_id)"""


@add("track hits info", _DIR, "SELECT hit_id, CASE WHEN v < 0 THEN 'near' ELSE 'far' END AS side, round(least(0.76, 0.42 + 0.20 * least(1, abs(v) / greatest(greatest(7, tall * 0.008) * 3, 1)) + 0.12 * least(1, (n - 2) / 5)), 6) AS confidence FROM dv WHERE n >= 3 AND k >= 2 AND abs(v) >= greatest(7, tall * 0.008)")
def e20_outgoing_direction(spark, sf):
    """The points a hit can see are joined by (match, frame): each hit is spread over the half second after it. The planner takes the spread rows for as few as the hits, hence the hint: they
    may not be broadcast."""
    h = with_info(hits(spark, sf).select("hit_id", "match_id", F.col("frame").alias("a")), spark, sf)
    span = F.greatest(F.lit(6), F.floor(0.55 * F.greatest("fps", F.lit(1.0)) + 0.5)).cast("long")
    h = h.select("hit_id", "match_id", (F.greatest("q5", "q7") - F.least("q1", "q3")).alias("tall"), F.explode(F.sequence(F.col("a") + 1, F.col("a") + span)).alias("frame"))
    t = track(spark, sf).where(F.col("vis") & F.col("source").isin(*REAL)).select("match_id", "frame", "y")
    w = Window.partitionBy("hit_id").orderBy("frame")
    p = h.hint("merge").join(t, ["match_id", "frame"]).withColumns({"pf": F.lag("frame").over(w), "py": F.lag("y").over(w)})
    near = F.col("frame") - F.col("pf") <= 2
    g = p.groupBy("hit_id").agg(F.max("tall").alias("tall"), F.count("*").alias("n"), F.count(F.when(near, 1)).alias("k"), F.percentile(F.when(near, (F.col("y") - F.col("py")) / (F.col("frame") - F.col("pf"))), F.lit(0.5)).alias("v"))
    least = F.greatest(F.lit(7.0), F.col("tall") * 0.008)
    conf = F.least(F.lit(0.76), 0.42 + 0.20 * F.least(F.lit(1.0), F.abs("v") / F.greatest(least * 3, F.lit(1.0))) + 0.12 * F.least(F.lit(1.0), (F.col("n") - 2) / 5))
    return g.where((F.col("n") >= 3) & (F.col("k") >= 2) & (F.abs("v") >= least)).select("hit_id", F.when(F.col("v") < 0, "near").otherwise("far").alias("side"), F.round(conf, 6).alias("confidence"))


_ENS = "wk AS (SELECT unnest(range(0, 8)) AS k), wt AS (SELECT k, least(k + 1, 8 - k) AS w FROM wk), en AS (SELECT t.match_id, t.frame + k AS frame, w, conf FROM track t, wt WHERE t.frame >= 0), ex AS (SELECT e.match_id, e.frame, sum(w * conf) AS s, sum(w) AS sw, count(*) AS n FROM en e GROUP BY ALL)"


@add("track", _ENS, "SELECT match_id, frame, round(s / sw, 6) AS score, CAST(n AS BIGINT) AS windows FROM ex SEMI JOIN track USING (match_id, frame)")
def e23_temporal_ensemble(spark, sf):
    """Windows of eight frames slide by one; a frame's score is the triangle-weighted mean over the windows that hold it, each with the confidence of its first frame."""
    t = track(spark, sf).select("match_id", "frame", "conf")
    w = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(min(k + 1, 8 - k))).alias("w")) for k in range(8)]))
    e = t.where("frame >= 0").withColumn("o", w).groupBy("match_id", (F.col("frame") + F.col("o.k")).alias("frame")).agg(F.sum(F.col("o.w") * F.col("conf")).alias("s"), F.sum("o.w").alias("sw"), F.count("*").alias("windows"))
    return e.join(t.select("match_id", "frame"), ["match_id", "frame"], "left_semi").select("match_id", "frame", F.round(F.col("s") / F.col("sw"), 6).alias("score"), "windows")


_ROB = """rz AS (SELECT a.match_id, a.frame, a.conf, list(b.conf) AS ctx FROM track a JOIN track b ON a.match_id = b.match_id AND b.frame BETWEEN a.frame - 30 AND a.frame + 30 AND abs(b.frame - a.frame) > 5 GROUP BY 1, 2, 3),
rm AS (SELECT *, list_median(ctx) AS med FROM rz)"""


@add("track", _ROB, "SELECT match_id, frame, round((conf - med) / (1.4826 * list_median(list_transform(ctx, lambda v: abs(v - med))) + 0.04), 6) AS z FROM rm")
def f12_robust_z(spark, sf):
    """On the confidences, with a radius of 30 frames."""
    return S.robust_z(track(spark, sf).select("match_id", "frame", "conf"), "conf", radius=30).select("match_id", "frame", *r6("z"))


@add("impulses", "f AS (SELECT match_id, frame, max(coalesce(score, 0)) AS score FROM impulses GROUP BY match_id, frame), g AS (SELECT *, 0.55 * least(score, score * 1.2) + 0.25 * score * 0.8 + 0.15 * score + 0.05 * (score - 0.5) AS impact FROM f), h AS (SELECT * FROM g WHERE impact >= 1.25), " + nms_sql("h", "round(impact, 9)", 8), "SELECT match_id, p.f AS frame, round(-p.s, 6) AS impact FROM k")
def f13_impact_score(spark, sf):
    """The four local z features are made from the impulse score; gate at 1.25, suppression within 8 frames."""
    from courtlane.plans.views import impulses

    s = F.col("score")
    f = impulses(spark, sf).groupBy("match_id", "frame").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    f = f.select("match_id", "frame", F.round(0.55 * F.least(s, s * 1.2) + 0.25 * s * 0.8 + 0.15 * s + 0.05 * (s - 0.5), 9).alias("impact")).where("impact >= 1.25")
    return suppressed(f, F.col("impact"), 8).select("match_id", "frame", *r6("impact"))


_CUTS = """df AS (SELECT match_id, frame, abs(conf - max(conf) OVER (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)) * 100 AS d FROM track),
md AS (SELECT match_id, median(d) AS med FROM df GROUP BY match_id), ma AS (SELECT match_id, max(med) AS med, median(abs(d - med)) AS mad FROM df JOIN md USING (match_id) GROUP BY match_id),
cd AS (SELECT df.* FROM df JOIN ma USING (match_id) WHERE frame > 1 AND d >= greatest(28, greatest(med + greatest(6, 6 * mad), 2.4 * med))), """


@add("track", _CUTS + nms_sql("cd", "round(d, 9)", 8), "SELECT match_id, p.f AS frame FROM k")
def f14_scene_cuts(spark, sf):
    """On the frame-to-frame change of the confidence, as there is no picture: max(28, median + max(6, 6 MAD), 2.4 medians), then suppression within 8 frames."""
    from courtlane.operators.sequence import percentiles_by
    from courtlane.session import join_small, staged

    d = at_offsets(track(spark, sf).select("match_id", "frame", "conf"), ["conf"], [-1]).select("match_id", "frame", (F.abs(F.col("conf") - F.col("conf_m1")) * 100).alias("d"))
    d = staged(d, "changes")
    med = percentiles_by(d, ["match_id"], F.col("d"), {"med": 0.5}, 1.0)
    d = join_small(d, med, ["match_id"], "inner")
    d = join_small(d, percentiles_by(d, ["match_id"], F.abs(F.col("d") - F.col("med")), {"mad": 0.5}, 1.0), ["match_id"], "inner")
    c = d.where((F.col("frame") > 1) & (F.col("d") >= F.greatest(F.lit(28.0), F.col("med") + F.greatest(F.lit(6.0), 6 * F.col("mad")), 2.4 * F.col("med"))))
    return suppressed(c.select("match_id", "frame", F.round("d", 9).alias("d")), F.col("d"), 8).select("match_id", "frame")


_PEAK = """s9 AS (SELECT match_id, frame, round(sum(conf) OVER (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9, 9) AS s FROM track),
pk AS (SELECT * FROM (SELECT *, max(s) OVER (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS a, max(s) OVER (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS b FROM s9) WHERE s > a AND s >= b), """


@add("track", _PEAK + nms_sql("pk", "s", 30), "SELECT match_id, p.f AS frame, round(-p.s, 6) AS energy FROM k QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY p.s, p.f) <= 5")
def f15_motion_peaks(spark, sf):
    """The five highest peaks of the confidence's nine-frame mean, at least 30 frames apart: a top-k report per match."""
    s = around(track(spark, sf).select("match_id", "frame", "conf"), {"t": (F.sum("conf"), -4, 4)}).select("match_id", "frame", F.round(F.col("t") / 9, 9).alias("s"))
    p = at_offsets(s, ["s"], [-1, 1]).where("s > s_m1 and s >= s_p1").select("match_id", "frame", "s")
    k = suppressed(p, F.col("s"), 30)
    w = Window.partitionBy("match_id").orderBy(F.desc("s"), "frame")
    return k.withColumn("n", F.row_number().over(w)).where("n <= 5").select("match_id", "frame", F.round("s", 6).alias("energy"))


@add("info", "", "SELECT match_id, CAST(unnest(list_transform(range(1, 6), lambda i: floor(i * fps * 10 / 6))) AS BIGINT) AS centre FROM info")
def f16_uniform_centres(spark, sf):
    return info(spark, sf).select("match_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.floor(i * F.col("fps") * 10 / 6))).alias("centre"))


_ST = "w3 AS (SELECT a.match_id, a.frame, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2, a.conf AS c0, b.conf AS c1, c.conf AS c2 FROM track a JOIN track b ON b.match_id = a.match_id AND b.frame = a.frame + 1 JOIN track c ON c.match_id = a.match_id AND c.frame = a.frame + 2 WHERE a.vis AND b.vis AND c.vis), w4 AS (SELECT *, greatest(sqrt((x0-x1)*(x0-x1)+(y0-y1)*(y0-y1)), sqrt((x0-x2)*(x0-x2)+(y0-y2)*(y0-y2)), sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2))) AS spread_px FROM w3)"


@add("track", _ST, "SELECT match_id, frame, list_median([x0, x1, x2]) AS x, list_median([y0, y1, y2]) AS y, round(spread_px, 6) AS spread_px, round((c0 + c1 + c2) / 3, 6) AS conf FROM w4 WHERE spread_px <= 12 AND least(c0, c1, c2) >= 0.35 AND (c0 + c1 + c2) / 3 >= 0.55")
def f23_stable_windows(spark, sf):
    return S.stable_windows(track(spark, sf)).select("match_id", "frame", "x", "y", *r6("spread_px", "conf"))


_MASK = "k0 AS (SELECT *, max(CASE WHEN vis THEN frame END) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf, min(CASE WHEN vis THEN frame END) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rf FROM track)"


@add("track", _MASK, "SELECT k0.match_id, k0.frame, round(l.x + CASE WHEN rf - lf = 2 THEN 0 ELSE (k0.frame - lf - 1) / (rf - lf - 2) END * (r.x - l.x), 6) AS x, round(l.y + CASE WHEN rf - lf = 2 THEN 0 ELSE (k0.frame - lf - 1) / (rf - lf - 2) END * (r.y - l.y), 6) AS y FROM k0 JOIN track l ON l.match_id = k0.match_id AND l.frame = lf JOIN track r ON r.match_id = k0.match_id AND r.frame = rf WHERE NOT k0.vis AND l.y > 30 AND r.y > 30")
def f32_inpaint(spark, sf):
    """Frames of holes between points below the top 30 px, filled so that the first and last hole frames take the values of the points beside them."""
    at = F.when(F.col("vis"), F.struct("frame", "x", "y"))
    t = anchors(track(spark, sf).select("match_id", "frame", "vis", "x", "y"), before={"l": at}, after={"r": at}).where("not vis and l.y > 30 and r.y > 30")
    n = F.col("r.frame") - F.col("l.frame") - 2
    s = F.when(n == 0, 0.0).otherwise(F.try_divide(F.col("frame") - F.col("l.frame") - 1, n))
    return t.select("match_id", "frame", *[F.round(F.col(f"l.{c}") + s * (F.col(f"r.{c}") - F.col(f"l.{c}")), 6).alias(c) for c in "xy"])


@add("track", "v AS (SELECT match_id, frame, frame - row_number() OVER (PARTITION BY match_id ORDER BY frame) AS g FROM track WHERE vis)", "SELECT match_id, min(frame) AS start_frame, max(frame) AS end_frame, CAST(count(*) AS BIGINT) AS points FROM v GROUP BY match_id, g HAVING count(*) >= 2")
def f33_trails(spark, sf):
    r = runs(track(spark, sf).where("vis").select("match_id", "frame"), F.lit(True))
    return r.groupBy("match_id", F.col("run").alias("start_frame")).agg(F.max("frame").alias("end_frame"), F.count("*").alias("points")).where("points >= 2")


_CR = """tr AS (SELECT match_id, frame, x, y, frame - row_number() OVER (PARTITION BY match_id ORDER BY frame) AS g FROM track WHERE vis),
cr AS (SELECT match_id, frame, lead(frame) OVER w IS NULL AS final, """ + ", ".join(f"coalesce(lag({c}) OVER w, {c}) AS {c}0, {c} AS {c}1, coalesce(lead({c}) OVER w, {c}) AS {c}2, coalesce(lead({c}, 2) OVER w, lead({c}) OVER w, {c}) AS {c}3" for c in "xy") + """ FROM tr WINDOW w AS (PARTITION BY match_id, g ORDER BY frame)),
cs AS (SELECT *, k / 12 AS t FROM cr, (SELECT unnest(range(0, 12)) AS k) WHERE k = 0 OR NOT final)"""
_CRE = lambda c: f"round(0.5 * (2 * {c}1 + ({c}2 - {c}0) * t + (2 * {c}0 - 5 * {c}1 + 4 * {c}2 - {c}3) * t * t + (3 * {c}1 - {c}0 - 3 * {c}2 + {c}3) * t * t * t), 6) AS {c}"


@add("track", _CR, f"SELECT match_id, frame, CAST(k AS BIGINT) AS step, {_CRE('x')}, {_CRE('y')} FROM cs")
def b30_catmull_rom(spark, sf):
    """Twelve points for every segment of every trail (consecutive visible frames) and its last point. A trail's ends stand in for the points beyond them."""
    return S.spline(track(spark, sf)).select("match_id", "frame", "step", *r6("x", "y"))


_FIT = "q AS (SELECT a.match_id, a.frame, count(b.x) AS n, " + ", ".join(f"sum(power(b.frame - a.frame, {k})) AS s{k}" for k in range(1, 5)) + ", sum(b.x) AS t0, sum((b.frame - a.frame) * b.x) AS t1, sum(power(b.frame - a.frame, 2) * b.x) AS t2 FROM track a JOIN track b ON a.match_id = b.match_id AND b.frame BETWEEN a.frame - 3 AND a.frame + 3 AND b.vis WHERE a.vis GROUP BY 1, 2), d AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM q WHERE n >= 5)"
_FITX = "(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det"
_FITV = "(n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det"


@add("track", _FIT, f"SELECT match_id, frame, round({_FITX}, 6) AS x_fit, round({_FITV}, 6) AS vx_fit FROM d WHERE abs(det) > 1e-9")
def b31_quadratic_fit(spark, sf):
    """Least squares parabola over the visible points up to three frames away: position and velocity at the frame, by the normal equations. Sums are taken in absolute frames
    of the block's start, then shifted, so one window serves all rows."""
    v = track(spark, sf).where("vis").select("match_id", "frame", "x")
    t = around(v, {"p": (F.collect_list(F.struct("frame", "x")), -3, 3)}).where(F.size("p") >= 5)
    s = lambda e: F.expr(f"aggregate(p, 0.0D, (a, q) -> a + {e})")
    k = "(q.frame - frame)"
    t = t.select("match_id", "frame", F.size("p").alias("n"), *[s("*".join([k] * i)).alias(f"s{i}") for i in range(1, 5)], s("q.x").alias("t0"), s(f"{k} * q.x").alias("t1"), s(f"{k} * {k} * q.x").alias("t2"))
    t = t.withColumn("det", F.expr("n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)")).where("abs(det) > 1e-9")
    return t.select("match_id", "frame", F.expr(f"round({_FITX}, 6)").alias("x_fit"), F.expr(f"round({_FITV}, 6)").alias("vx_fit"))
