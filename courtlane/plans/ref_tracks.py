"""Reference queries: sequential kernels and candidate tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlane.operators import classical as C
from courtlane.operators import kernels as K
from courtlane.operators import tracklets as T
from courtlane.operators.sequence import at_offsets, runs
from courtlane.plans.views import REAL, TRACKING, Registry, info, poses, r6, r6_sql, track, with_info
from courtlane.session import staged

add = Registry()


def _drawn(t):
    """Components of a picture made from visible points of the track: the ball itself (k 0; a sliver on every 50th frame), a decoy mirrored to a fixed line on every second frame (1), and a static
    spot on every third (2). Other columns stay."""
    part = lambda k, on, **m: F.when(F.expr(on), F.struct(F.lit(k).alias("k"), *[F.expr(e).cast("double").alias(n) for n, e in m.items()]))
    ball = part(0, "true", x="x", y="y", width="5 + frame % 4", height="if(frame % 50 = 0, 1, 6 + frame % 3)", area="floor(0.7 * (5 + frame % 4) * if(frame % 50 = 0, 1, 6 + frame % 3))", motion="42 + 20 * conf", value="170", background="130")
    decoy = part(1, "frame % 2 = 0", x="x * 0.5 + 200", y="900 - y * 0.5", width="12", height="7", area="50", motion="22", value="160", background="140")
    spot = part(2, "frame % 3 = 0", x="640", y="300 + frame % 4", width="9", height="9", area="60", motion="14", value="180", background="150")
    c = t.withColumn("c", F.explode(F.array(ball, decoy, spot))).where("c is not null")
    return c.select(*[k for k in t.columns if k not in ("x", "y", "conf")], "c.*").withColumn("cand_id", F.col("frame") * 4 + F.col("k"))


def components(spark, sf):
    return _drawn(track(spark, sf).where("vis").select("match_id", "frame", "x", "y", "conf"))


def candidates(spark, sf):
    return C.shape_candidates(components(spark, sf))


CAND = """comp AS (SELECT match_id, frame, 0 AS k, x, y, 5 + frame % 4 AS w, CASE WHEN frame % 50 = 0 THEN 1 ELSE 6 + frame % 3 END AS h, NULL::DOUBLE AS given, 42 + 20 * conf AS motion, 170 AS value, 130 AS background FROM track WHERE vis
 UNION ALL SELECT match_id, frame, 1, x * 0.5 + 200, 900 - y * 0.5, 12, 7, 50, 22, 160, 140 FROM track WHERE vis AND frame % 2 = 0
 UNION ALL SELECT match_id, frame, 2, 640.0, 300.0 + frame % 4, 9, 9, 60, 14, 180, 150 FROM track WHERE vis AND frame % 3 = 0),
comp1 AS (SELECT *, coalesce(given, floor(0.7 * w * h)) AS area FROM comp),
comp2 AS (SELECT *, area / (w * h) AS density, CASE WHEN w < h THEN w / h ELSE h / w END AS aspect, value - background AS contrast FROM comp1 WHERE area >= 3 AND area <= 150 AND w >= 2 AND w <= 28 AND h >= 2 AND h <= 28),
cand AS (SELECT match_id, frame, frame * 4 + k AS cand_id, x, y, CAST(area AS DOUBLE) AS area, aspect, density, CAST(contrast AS DOUBLE) AS contrast, 0.023 * motion + 0.014 * contrast + 0.0025 * value + sqrt(aspect * density) - 0.004 * abs(area - 45) AS quality FROM comp2 WHERE density >= 0.22 AND aspect >= 0.18)"""
#: Two overlapping tracks in every stretch of consecutive visible frames: the ball, and a weaker copy from the fourth frame on.
PTS = CAND + """, trail AS (SELECT match_id, frame, min(frame) OVER (PARTITION BY match_id, g) AS run FROM (SELECT match_id, frame, frame - row_number() OVER (PARTITION BY match_id ORDER BY frame) AS g FROM track WHERE vis)),
pts AS (SELECT match_id, run, 0 AS track, frame, cand_id, x, y, quality, aspect, density, contrast FROM cand JOIN trail USING (match_id, frame) WHERE cand_id = frame * 4
 UNION ALL SELECT match_id, run, 1, frame, cand_id, x + 40, y, quality - 0.1, aspect, density, contrast FROM cand JOIN trail USING (match_id, frame) WHERE cand_id = frame * 4 AND frame >= run + 3)"""
_TW = "(PARTITION BY match_id, run, track ORDER BY frame)"
MEAS = PTS + f""", m1 AS (SELECT *, (x - lag(x) OVER w) / (frame - lag(frame) OVER w) AS vx, (y - lag(y) OVER w) / (frame - lag(frame) OVER w) AS vy FROM pts WINDOW w AS {_TW}),
m2 AS (SELECT *, lag(vx) OVER w AS wx, lag(vy) OVER w AS wy, sqrt(vx * vx + vy * vy) AS v FROM m1 WINDOW w AS {_TW}),
m3 AS (SELECT match_id, run, track, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n, median(v) AS median_speed, max(x) - min(x) + max(y) - min(y) AS spread, avg(quality) AS quality, avg(aspect) AS aspect, avg(density) AS density, avg(contrast) AS contrast, min(y) AS min_y,
 coalesce(quantile_cont(sqrt(power(vx - wx, 2) + power(vy - wy, 2)), 0.8), 0) AS accel_p80, coalesce(quantile_cont(CASE WHEN v > 1 AND sqrt(wx * wx + wy * wy) > 1 THEN degrees(acos(greatest(-1, least(1, (vx * wx + vy * wy) / (v * sqrt(wx * wx + wy * wy)))))) END, 0.8), 0) AS turn_p80,
 sum(v) / greatest(1, sqrt(power(arg_max(x, frame) - arg_min(x, frame), 2) + power(arg_max(y, frame) - arg_min(y, frame), 2))) AS bend FROM m2 GROUP BY match_id, run, track HAVING count(*) >= 3),
meas AS (SELECT *, n / (end_frame - start_frame + 1) AS fill, quality + 0.05 * least(n, 20) + 0.01 * least(spread, 100) - 0.03 * abs(median_speed - 12) + 0.3 * n / (end_frame - start_frame + 1) AS rank FROM m3),
good AS (SELECT * FROM meas WHERE median_speed >= 2.5 AND median_speed <= 90 AND spread >= 25 AND fill >= 0.55)"""


def _points(spark, sf):
    """Points of tracks without a tracker, so that SQL can hold what is measured on them: see PTS."""
    c = candidates(spark, sf).where("cand_id = frame * 4")
    r = runs(track(spark, sf).where("vis").select("match_id", "frame"), F.lit(True))
    p = c.join(r, ["match_id", "frame"]).select("match_id", "run", F.lit(0).cast("long").alias("track"), "frame", "cand_id", "x", "y", "quality", "aspect", "density", "contrast")
    return p.unionByName(p.where("frame >= run + 3").withColumns({"track": F.lit(1).cast("long"), "x": F.col("x") + 40, "quality": F.col("quality") - 0.1}))


def _measured(spark, sf):
    return T.plausible(T.measures(_points(spark, sf)))


def _observed(spark, sf):
    """The detectors' own observations as a track; a label that is no tracking source counts as the model's."""
    return track(spark, sf).select("match_id", "frame", F.col("raw_vis").alias("vis"), F.col("raw_x").alias("x"), F.col("raw_y").alias("y"), F.when(F.col("raw_source").isin(*TRACKING), F.col("raw_source")).otherwise("model").alias("source"), "conf")


@add()
def f03_smooth_track(spark, sf):
    """Edge breaks, interpolation and the filter over the raw observations, one row per frame. No SQL: a filter with a state. Tests hold it against a four-dimensional matrix filter."""
    return K.smoothed_track(_observed(spark, sf), TRACKING)


@add()
def k16_smooth_around_cuts(spark, sf):
    """F3 with the CLI's preset: the filter starts anew within three frames of a camera cut. There is no table of cuts; every 1500th frame of a match stands for one, as in ref_vetoes. No SQL."""
    t = _observed(spark, sf)
    stop = t.groupBy("match_id").agg(F.max("frame").alias("stop")).where("stop >= 1500")
    cuts = stop.select("match_id", F.explode(F.sequence(F.lit(1500).cast("long"), F.col("stop"), F.lit(1500).cast("long"))).alias("frame"))
    return K.smoothed_track(t, TRACKING, resets=K.reset_frames(cuts))


@add()
def c05_mixed_static_locks(spark, sf):
    """No SQL: greedy search. Tests hold it against a search over whole lists."""
    return K.static_locks(track(spark, sf).where(F.col("vis") & F.col("source").isin(*REAL)), "mixed")


@add()
def c06_raw_model_locks(spark, sf):
    t = track(spark, sf).where("raw_vis and raw_source = 'model' and raw_y >= 80")
    return K.static_locks(t.select("match_id", "frame", F.col("raw_x").alias("x"), F.col("raw_y").alias("y")), "raw_model")


@add()
def c07_prediction_locks(spark, sf):
    t = track(spark, sf).where("raw_vis")
    return K.static_locks(t.select("match_id", "frame", F.col("raw_x").alias("x"), F.col("raw_y").alias("y")), "prediction")


@add()
def c08_static_candidates(spark, sf):
    """C8: windows from every frame, all twelve offsets, the median test, and static centres per frame. The made-up static spot stands on every frame here, as on every third no window can
    be whole. No SQL: which window marks a frame depends on those before. Tests hold it against a search over whole lists."""
    c = candidates(spark, sf).select("match_id", "frame", "cand_id", "x", "y", "quality")
    rest = track(spark, sf).where("vis and frame % 3 <> 0").select("match_id", "frame", (F.col("frame") * 4 + 2).alias("cand_id"), F.lit(640.0).alias("x"), (F.lit(300.0) + F.col("frame") % 4).alias("y"), F.lit(1.2).alias("quality"))
    return K.static_centres(c.unionByName(rest)).select("match_id", "frame", *r6("x", "y"))


def _tracks(spark, sf):
    return K.greedy_tracks(candidates(spark, sf))


@add()
def f19_greedy_tracks(spark, sf):
    """With D16 and F17. No SQL: greedy association."""
    return _tracks(spark, sf)


_M6 = ("median_speed", "spread", "fill", "quality", "aspect", "density", "contrast", "rank", "accel_p80", "turn_p80", "bend")


@add("track", MEAS, f"SELECT match_id, run, track, start_frame, end_frame, n, {r6_sql(*_M6)} FROM meas")
def e13_track_measures(spark, sf):
    return T.measures(_points(spark, sf)).select("match_id", "run", "track", "start_frame", "end_frame", "n", *r6(*_M6))


@add("track", MEAS, "SELECT match_id, run, track, start_frame, end_frame, n, round(rank, 6) AS rank FROM good WHERE n >= 8 AND rank >= 4.45 AND quality >= 2.05 AND aspect >= 0.66 AND density >= 0.53 AND contrast >= 28 AND fill >= 0.62 AND accel_p80 <= 10 AND turn_p80 <= 36 AND bend <= 2.5")
def c21_strict_tracks(spark, sf):
    return C.strict(_measured(spark, sf)).select("match_id", "run", "track", "start_frame", "end_frame", "n", *r6("rank"))


@add("track", MEAS.replace("pts AS (", "pts AS (SELECT * REPLACE (y / 20 AS y) FROM (") .replace("frame >= run + 3)", "frame >= run + 3))"), "SELECT match_id, run, track, start_frame, end_frame, n, round(min_y, 6) AS min_y FROM good WHERE n >= 5 AND min_y <= 24 AND quality >= 3 AND aspect >= 0.5 AND density >= 0.48 AND contrast >= 35 AND fill >= 0.85 AND accel_p80 <= 10.5 AND turn_p80 <= 15 AND bend <= 1.25")
def c21_edge_tracks(spark, sf):
    """The gates of short flights that reach the top edge, on points drawn up to it (a twentieth of their y)."""
    p = _points(spark, sf).withColumn("y", F.col("y") / 20)
    return C.edge(T.plausible(T.measures(p))).select("match_id", "run", "track", "start_frame", "end_frame", "n", *r6("min_y"))


_TRIM = PTS + f""", t1 AS (SELECT *, row_number() OVER w AS k, (x - lag(x) OVER w) / (frame - lag(frame) OVER w) AS vx, (y - lag(y) OVER w) / (frame - lag(frame) OVER w) AS vy FROM pts WINDOW w AS {_TW}),
t2 AS (SELECT *, lag(vx) OVER w AS wx, lag(vy) OVER w AS wy FROM t1 WINDOW w AS {_TW}),
t3 AS (SELECT *, coalesce(k > 3 AND (sqrt(power(vx - wx, 2) + power(vy - wy, 2)) > 28 OR (sqrt(vx * vx + vy * vy) > 10 AND sqrt(wx * wx + wy * wy) > 10 AND degrees(acos(greatest(-1, least(1, (vx * wx + vy * wy) / (sqrt(vx * vx + vy * vy) * sqrt(wx * wx + wy * wy)))))) > 65)), false) AS bad FROM t2)"""


@add("track", _TRIM, f"SELECT match_id, run, track, frame, cand_id FROM t3 QUALIFY NOT bool_or(bad) OVER {_TW[:-1]} ROWS UNBOUNDED PRECEDING)")
def f19b_trimmed_points(spark, sf):
    return T.trim_abrupt(_points(spark, sf)).select("match_id", "run", "track", "frame", "cand_id")


_SPAN = MEAS + """, sl AS (SELECT match_id, list(struct_pack(k := -rank, r := run, t := CAST(track AS BIGINT), a := start_frame, z := end_frame) ORDER BY -rank, run, track) AS c FROM good GROUP BY match_id),
sk AS (SELECT match_id, unnest(list_reduce(list_prepend(CAST([] AS STRUCT(k DOUBLE, r BIGINT, t BIGINT, a BIGINT, z BIGINT)[]), list_transform(c, lambda e: [CAST(e AS STRUCT(k DOUBLE, r BIGINT, t BIGINT, a BIGINT, z BIGINT))])), lambda acc, e: CASE WHEN len(list_filter(acc, lambda q: least(q.z, e[1].z) - greatest(q.a, e[1].a) + 1 >= greatest(1, 0.42 * least(q.z - q.a + 1, e[1].z - e[1].a + 1)))) = 0 THEN list_concat(acc, e) ELSE acc END)) AS p FROM sl)"""


@add("track", _SPAN, "SELECT match_id, p.r AS run, p.t AS track, p.a AS start_frame, p.z AS end_frame, round(-p.k, 6) AS rank FROM sk")
def f20_span_suppression(spark, sf):
    return T.span_suppression(_measured(spark, sf)).withColumn("rank", F.round("rank", 6))


_CONF = lambda rank, quality: f"round(least(0.96, greatest(0.52, 0.52 + 0.24 * least(1, greatest(0, ({rank} - 4.45) / 1.35)) + 0.20 * least(1, greatest(0, ({quality} - 1.35) / 3)))), 6)"


@add("track", MEAS, f"SELECT p.match_id, p.frame, p.run, CAST(p.track AS BIGINT) AS track, round(p.x, 6) AS x, round(p.y, 6) AS y, {_CONF('g.rank', 'p.quality')} AS confidence FROM pts p JOIN good g USING (match_id, run, track) QUALIFY row_number() OVER (PARTITION BY p.match_id, p.frame ORDER BY g.rank DESC, p.run, p.track) = 1")
def k08_classical_result(spark, sf):
    """With F19e and K9: one owner per frame, its position and a confidence from rank and quality."""
    p = _points(spark, sf)
    return C.owned_points(p, T.plausible(T.measures(p))).select("match_id", "frame", "run", "track", *r6("x", "y", "confidence"))


@add("track info", MEAS + ", lp AS (SELECT *, row_number() OVER (PARTITION BY match_id, run, track ORDER BY frame DESC) AS k FROM pts)", f"SELECT z.match_id, z.run, CAST(z.track AS BIGINT) AS track, z.frame, round(z.x, 6) AS x, round(z.y, 6) AS y, {_CONF('g.rank', 'z.quality')} AS score, round(sqrt(power(z.x - p.x, 2) + power(z.y - p.y, 2)) / (z.frame - p.frame), 6) AS speed FROM lp z JOIN lp p ON p.match_id = z.match_id AND p.run = z.run AND p.track = z.track AND p.k = 2 AND z.k = 1 JOIN good g ON g.match_id = z.match_id AND g.run = z.run AND g.track = z.track JOIN info i ON i.match_id = z.match_id WHERE z.y >= least(q1, q3) AND z.x > 24 AND z.x < width - 25 AND z.y > 24 AND z.y < height - 25")
def k08_endpoint_hits(spark, sf):
    """The ends of tracks as possible contacts, not above the court's far edge nor at the picture's edge."""
    p = _points(spark, sf)
    m = with_info(T.plausible(T.measures(p)).select("match_id", "run", "track", "rank"), spark, sf)
    return C.endpoint_hits(p, m, F.least("q1", "q3"), F.col("width"), F.col("height"), 24.0).select("match_id", "run", "track", "frame", *r6("x", "y", "score", "speed"))


@add("track", CAND, f"SELECT match_id, frame, cand_id, {r6_sql('aspect', 'density', 'contrast', 'quality')} FROM cand")
def c22_shape_gates(spark, sf):
    return candidates(spark, sf).select("match_id", "frame", "cand_id", *r6("aspect", "density", "contrast", "quality"))


def _weak(spark, sf):
    """Candidates of a weaker pool: the decoys, and copies of the ball up to 19 px aside."""
    c = candidates(spark, sf).select("match_id", "frame", "cand_id", "x", "y", "quality")
    copies = c.where("cand_id = frame * 4").withColumns({"cand_id": F.col("cand_id") + 3, "x": F.col("x") + F.col("frame") % 20, "quality": F.lit(1.3)})
    return c.where("cand_id = frame * 4 + 1").unionByName(copies)


_WEAK = CAND + ", s AS (SELECT * FROM cand WHERE cand_id <> frame * 4 + 1), w AS (SELECT match_id, frame, cand_id, x, y FROM cand WHERE cand_id = frame * 4 + 1 UNION ALL SELECT match_id, frame, cand_id + 3, x + frame % 20, y FROM cand WHERE cand_id = frame * 4)"


@add("track", _WEAK, "SELECT match_id, frame, cand_id, round(x, 6) AS x, round(y, 6) AS y FROM s UNION ALL SELECT match_id, frame, cand_id, round(x, 6), round(y, 6) FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.match_id = w.match_id AND s.frame = w.frame AND (s.x - w.x) * (s.x - w.x) + (s.y - w.y) * (s.y - w.y) <= 64)")
def d17_fused_candidates(spark, sf):
    c = candidates(spark, sf)
    return T.fused_candidates(c.where("cand_id <> frame * 4 + 1"), _weak(spark, sf)).select("match_id", "frame", "cand_id", *r6("x", "y"))


@add()
def d15_candidate_clusters(spark, sf):
    """No SQL: the centres move as candidates join. Tests hold it against a fold over lists."""
    c = candidates(spark, sf).select("match_id", "frame", "cand_id", "x", "y", "quality").unionByName(_weak(spark, sf).where("cand_id = frame * 4 + 3"))
    return T.clusters(c).select("match_id", "frame", "cluster", *r6("x", "y", "weight"), "n")


@add("track", _WEAK + ", u AS (SELECT match_id, frame, cand_id, quality FROM cand UNION ALL SELECT match_id, frame, cand_id + 3, 1.3 FROM cand WHERE cand_id = frame * 4)", "SELECT match_id, frame, cand_id, rank FROM (SELECT match_id, frame, cand_id, CAST(row_number() OVER (PARTITION BY match_id, frame ORDER BY quality DESC, cand_id) AS BIGINT) AS rank FROM u) WHERE rank <= 50")
def g02_top_candidates(spark, sf):
    """The 50 best candidates of a frame: a top-k operator."""
    from pyspark.sql import Window

    c = candidates(spark, sf).select("match_id", "frame", "cand_id", "quality").unionByName(_weak(spark, sf).where("cand_id = frame * 4 + 3").select("match_id", "frame", "cand_id", "quality"))
    w = Window.partitionBy("match_id", "frame").orderBy(F.desc("quality"), "cand_id")
    return c.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 50").select("match_id", "frame", "cand_id", "rank")


@add("track", CAND + ", kc AS (SELECT c.match_id, c.frame, c.cand_id, sqrt(power(c.x - t.x - 3, 2) + power(c.y - t.y - 4, 2)) AS d FROM cand c JOIN track t ON t.match_id = c.match_id AND t.frame = c.frame AND t.vis)", "SELECT match_id, frame, arg_min(cand_id, (d, cand_id)) AS det_id FROM kc GROUP BY match_id, frame")
def k15_closest_candidates(spark, sf):
    """The candidate nearest to a point 5 px beside the ball."""
    ref = track(spark, sf).where("vis").select("match_id", "frame", (F.col("x") + 3).alias("x"), (F.col("y") + 4).alias("y"))
    return K.closest(candidates(spark, sf).select("match_id", "frame", F.col("cand_id").alias("det_id"), "x", "y"), ref)


@add("track", CAND + ", p AS (SELECT DISTINCT c.match_id, c.frame, c.cand_id FROM cand c JOIN cand o ON o.match_id = c.match_id AND o.frame BETWEEN c.frame - 3 AND c.frame - 1 AND (o.x - c.x) * (o.x - c.x) + (o.y - c.y) * (o.y - c.y) <= 3025)", "SELECT match_id, frame, cand_id FROM p")
def f34_persistent_candidates(spark, sf):
    """Candidates with one within 55 px in the last three frames."""
    c = candidates(spark, sf).select("match_id", "frame", "cand_id", "x", "y")
    o = c.select("match_id", F.explode(F.sequence(F.col("frame") + 1, F.col("frame") + 3)).alias("frame"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return c.join(o, ["match_id", "frame"]).where((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 <= 55 * 55).select("match_id", "frame", "cand_id").distinct()


@add("track", "l AS (SELECT a.match_id, a.frame, a.x + (a.x - b.x) AS px, a.y + (a.y - b.y) AS py FROM track a JOIN track b ON b.match_id = a.match_id AND b.frame = a.frame - 1 WHERE a.vis AND b.vis)", "SELECT match_id, frame + 1 AS frame, round(px, 6) AS px, round(py, 6) AS py FROM l")
def f22_prediction(spark, sf):
    """Where the ball goes next, on the line through its last two points (the parabola is B31)."""
    t = at_offsets(track(spark, sf).where("vis").select("match_id", "frame", "x", "y"), ["x", "y"], [-1]).where("x_m1 is not null")
    return t.select("match_id", (F.col("frame") + 1).alias("frame"), F.round(2 * F.col("x") - F.col("x_m1"), 6).alias("px"), F.round(2 * F.col("y") - F.col("y_m1"), 6).alias("py"))


_TOPT = """pt AS (SELECT match_id, 0 AS track, frame, x, y FROM track WHERE vis UNION ALL SELECT match_id, 1, frame, 640 + frame % 3, 150 FROM track WHERE vis),
tz AS (SELECT match_id, track, frame, count(*) OVER w AS n, avg((y <= 178)::INT) OVER w AS top, sqrt(power(max(x) OVER w - min(x) OVER w, 2) + power(max(y) OVER w - min(y) OVER w, 2)) AS spread FROM pt WINDOW w AS (PARTITION BY match_id, track ORDER BY frame ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)),
ban AS (SELECT match_id, track, min(frame) AS since FROM tz WHERE n >= 42 AND top >= 0.88 AND spread <= 30 GROUP BY match_id, track)"""


@add("track", _TOPT, "SELECT match_id, CAST(track AS BIGINT) AS track, frame FROM pt JOIN ban USING (match_id, track) WHERE frame >= since")
def c27_static_top_tracks(spark, sf):
    """Histories of 90 points, at least 42, 88 % of them in the top zone (18 px below y 160), a spread of 30 px, and the lasting ban of the track. The match's ball stands in for one track, a
    judge's chair for another."""
    t = track(spark, sf).where("vis").select("match_id", F.lit(0).cast("long").alias("track"), "frame", "x", "y")
    chair = t.select("match_id", F.lit(1).cast("long").alias("track"), "frame", (F.lit(640.0) + F.col("frame") % 3).alias("x"), F.lit(150.0).alias("y"))
    return K.banned_top_tracks(t.unionByName(chair), 178.0)


@add()
def f29_player_identity(spark, sf):
    """No SQL: who holds a side depends on who held it. Detections are the made-up players, the line the middle of the picture. Tests hold the rules."""
    p = with_info(poses(spark, sf), spark, sf).select("match_id", "frame", F.col("frame").alias("det_id"), ((F.col("b0") + F.col("b2")) / 2 + 250).alias("fx"), (F.col("b3") + 250).alias("fy"), (F.col("height") / 2).alias("line"))
    return K.player_identity(p, "fx", "fy", "line")


@add()
def f18_selected_track(spark, sf):
    """No SQL: each choice depends on the last. Persistence comes from F34."""
    c = candidates(spark, sf)
    kept = f34_persistent_candidates(spark, sf).withColumn("persistence", F.lit(1))
    c = c.join(kept, ["match_id", "frame", "cand_id"], "left").select("match_id", "frame", "cand_id", "x", "y", "quality", F.lit(1).alias("count"), F.coalesce("persistence", F.lit(0)).alias("persistence"))
    return K.selected_track(c).select("match_id", "frame", "cand_id", *r6("x", "y"))


def _extended(spark, sf, forward):
    """The visible points are written once, as finding their runs reads them twice."""
    t = staged(track(spark, sf).where("vis").select("match_id", "frame", "x", "y", "conf"), "frames")
    return K.tracked_extensions(t, lambda f: C.shape_candidates(_drawn(f), keep=("run",)), forward)


@add()
def f19c_forward_extensions(spark, sf):
    """No SQL: greedy. Tests hold it against tracks, written, and their extension by pairs."""
    return _extended(spark, sf, True)


@add()
def f19d_backward_extensions(spark, sf):
    return _extended(spark, sf, False)


_STITCH = PTS + """, e1 AS (SELECT *, row_number() OVER (PARTITION BY match_id, run, track ORDER BY frame) AS i, count(*) OVER (PARTITION BY match_id, run, track) AS n FROM pts WHERE track = 0),
e2 AS (SELECT match_id, run, track, max(frame) FILTER (i = 1) AS af, max(x) FILTER (i = 1) AS ax, max(y) FILTER (i = 1) AS ay, max(frame) FILTER (i = 3) AS bf, max(x) FILTER (i = 3) AS bx, max(y) FILTER (i = 3) AS by_, max(frame) FILTER (i = n) AS zf, max(x) FILTER (i = n) AS zx, max(y) FILTER (i = n) AS zy, max(frame) FILTER (i = n - 2) AS yf, max(x) FILTER (i = n - 2) AS yx, max(y) FILTER (i = n - 2) AS yy FROM e1 WHERE n >= 3 GROUP BY match_id, run, track),
e3 AS (SELECT *, (zx - yx) / (zf - yf) AS vx, (zy - yy) / (zf - yf) AS vy, (bx - ax) / (bf - af) AS ux, (by_ - ay) / (bf - af) AS uy FROM e2),
e4 AS (SELECT *, lead(run) OVER w AS next_run, lead(track) OVER w AS next_track, lead(af) OVER w - zf AS gap, lead(ax) OVER w AS nx, lead(ay) OVER w AS ny, lead(ux) OVER w AS nux, lead(uy) OVER w AS nuy FROM e3 WINDOW w AS (PARTITION BY match_id ORDER BY af, zf, run, track)),
e5 AS (SELECT *, sqrt(power(zx + gap * vx - nx, 2) + power(zy + gap * vy - ny, 2)) AS error, sqrt(power(nx - gap * nux - zx, 2) + power(ny - gap * nuy - zy, 2)) AS back, sqrt(vx * vx + vy * vy) * sqrt(nux * nux + nuy * nuy) AS s FROM e4)"""


@add("track", _STITCH, "SELECT match_id, run, CAST(track AS BIGINT) AS track, next_run, CAST(next_track AS BIGINT) AS next_track, gap, round(error, 6) AS error FROM e5 WHERE gap BETWEEN 1 AND 18 AND error <= greatest(45, 6 * gap) AND back <= 1.35 * greatest(45, 6 * gap) AND (s < 1e-6 OR vx * nux + vy * nuy >= cos(radians(28)) * s)")
def f21_stitched_tracks(spark, sf):
    return T.stitched(_points(spark, sf).where("track = 0")).withColumn("error", F.round("error", 6))


@add()
def k18_classical_pipeline(spark, sf):
    """All of K18 over candidates: base and wide tracks, seeds, extension both ways, one owner per frame, numbering. Not in it: the pool of weaker (conditioned) candidates and stop_frame."""
    top = F.least("q1", "q3")
    tops = info(spark, sf).select("match_id", *[F.greatest(F.lit(0.0), top - up).alias(n) for n, up in (("base_top", 120), ("wide_top", 480))])
    return C.pipeline(candidates(spark, sf), tops).select("match_id", "frame", "track_id", *r6("x", "y"), "core")


@add()
def f21_split_hits(spark, sf):
    """No SQL: three fits per frame. On the measured track."""
    return K.split_hits(track(spark, sf).where(F.col("vis") & F.col("source").isin(*REAL))).select("match_id", "frame", *r6("x", "y", "score"))
