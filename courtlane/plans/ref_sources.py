"""Reference queries: scans, sinks and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlane.functions import geometry as G
from courtlane.plans.views import Registry, ball, hits, info, phases, poses, r6, r6_sql, table, track, with_info
from courtlane.sources import readers as R

add = Registry()
Q = [f"q{k}" for k in range(8)]
SEEN = "SELECT t.match_id, t.frame, t.x, t.y, t.hitter, i.* EXCLUDE (match_id) FROM track t JOIN info i USING (match_id) WHERE t.vis"


def seen(spark, sf):
    return with_info(track(spark, sf).where("vis").select("match_id", "frame", "x", "y", "hitter"), spark, sf)


def exprs(df, keep, **cols):
    return df.select(*keep, *[F.expr(e).alias(n) for n, e in cols.items()])


@add("ball", "", "SELECT match_id, phase, frame, vis, x, y, source, conf FROM ball")
def a01_load_ball(spark, sf):
    return ball(spark, sf)


@add("ball", "", "SELECT match_id, phase, CAST(max(frame) + 1 AS BIGINT) AS frame_count, CAST(count(*) AS BIGINT) AS parsed FROM ball GROUP BY match_id, phase")
def a02_frame_count(spark, sf):
    return ball(spark, sf).groupBy("match_id", "phase").agg((F.max("frame") + 1).alias("frame_count"), F.count("*").alias("parsed"))


_CANON = """c0 AS (SELECT *, v > 0 AND x > 0 AND y > 0 AS seen FROM (SELECT * REPLACE (coalesce(v, 0) AS v) FROM ball0) WHERE match_id IS NOT NULL AND frame IS NOT NULL AND phase IN ('primary', 'secondary')),
c1 AS (SELECT match_id, phase, frame, coalesce(seen, false) AS seen, x, y FROM c0 QUALIFY row_number() OVER (PARTITION BY match_id, phase, frame ORDER BY coalesce(seen, false) DESC, row_id) = 1),
c AS (SELECT match_id, phase, frame, CAST(seen AS BIGINT) AS visibility, CASE WHEN seen THEN x ELSE 0 END AS x, CASE WHEN seen THEN y ELSE 0 END AS y FROM c1),
spine AS (SELECT match_id, phase, unnest(range(0, max(frame) + 1)) AS frame FROM c GROUP BY match_id, phase HAVING max(frame) >= 0)"""


@add("ball", _CANON, "SELECT match_id, phase, frame, CAST(coalesce(visibility, 0) AS BIGINT) AS visibility, CAST(coalesce(x, 0) AS BIGINT) AS x, CAST(coalesce(y, 0) AS BIGINT) AS y FROM spine LEFT JOIN c USING (match_id, phase, frame)")
def a03_canonical_predictions(spark, sf):
    return R.densified(R.canonical(table(spark, sf, "ball_raw")), ["match_id", "phase"], {"visibility": 0, "x": 0, "y": 0})


@add("track", "spine AS (SELECT match_id, unnest(range(0, max(frame) + 1)) AS frame FROM track GROUP BY match_id)", "SELECT match_id, frame, coalesce(vis, false) AS vis, x, y, coalesce(source, 'missing') AS source FROM spine LEFT JOIN track USING (match_id, frame)")
def a04_dense_track(spark, sf):
    return R.densified(track(spark, sf).select("match_id", "frame", "vis", "x", "y", "source"), ["match_id"], {"vis": False, "source": "missing"})


@add("track", "", "SELECT match_id, frame, vis, x, y, source, conf, raw_vis, raw_x, raw_y, raw_source, hit, hitter, rally, speed FROM track")
def a05_sidecar_reader(spark, sf):
    return track(spark, sf).select("match_id", "frame", "vis", "x", "y", "source", "conf", "raw_vis", "raw_x", "raw_y", "raw_source", "hit", "hitter", "rally", "speed")


_SIDE = """h AS (SELECT match_id, frame, score, source, hitter, track_id FROM hits QUALIFY row_number() OVER (PARTITION BY match_id, frame ORDER BY score DESC, hit_id DESC) = 1),
j AS (SELECT t.* EXCLUDE (hitter, hit), h.match_id IS NOT NULL AS hit, h.score AS hs, h.source AS hsrc, h.hitter AS hh, h.track_id AS tid, t.source = 'offscreen_bridge' AS drawn FROM track t LEFT JOIN h USING (match_id, frame))"""


@add("track hits", _SIDE, """SELECT match_id, frame, CAST(vis AS BIGINT) AS visibility, x, y, source, conf, CASE WHEN NOT drawn THEN raw_x END AS raw_x, CASE WHEN NOT drawn THEN raw_y END AS raw_y, CASE WHEN drawn THEN 'missing' ELSE raw_source END AS raw_source,
 CAST(hit AND NOT drawn AS BIGINT) AS hit, CASE WHEN NOT drawn THEN hs END AS hit_score, CASE WHEN NOT drawn THEN hsrc END AS hit_source, CASE WHEN NOT drawn THEN hh END AS hit_hitter, CASE WHEN NOT drawn THEN CAST(tid AS BIGINT) END AS track_id, CASE WHEN drawn THEN 0 ELSE rally END AS rally FROM j""")
def a06_sidecar_rows(spark, sf):
    return R.sidecar_rows(track(spark, sf), hits(spark, sf))


@add("track", "", "SELECT match_id, frame, CAST(vis AS BIGINT) AS visibility, CAST(coalesce(trunc(x), 0) AS BIGINT) AS x, CAST(coalesce(trunc(y), 0) AS BIGINT) AS y, source, printf('%.4f', conf) AS confidence FROM track")
def a07_smoothed_csv_rows(spark, sf):
    return track(spark, sf).select("match_id", "frame", F.col("vis").cast("long").alias("visibility"), F.coalesce(F.col("x").cast("long"), F.lit(0)).alias("x"), F.coalesce(F.col("y").cast("long"), F.lit(0)).alias("y"), "source", F.format_string("%.4f", "conf").alias("confidence"))


@add("track info", "", """SELECT match_id, frame, printf('{"id":%d,"file_name":"%06d.png","width":%d,"height":%d}', frame, frame, CAST(width AS BIGINT), CAST(height AS BIGINT)) AS image,
 CASE WHEN vis THEN printf('{"id":%d,"image_id":%d,"category_id":1,"bbox":[%d,%d,10,10],"area":100,"iscrowd":0}', frame, frame, CAST(trunc(x - 5) AS BIGINT), CAST(trunc(y - 5) AS BIGINT)) END AS annotation FROM track JOIN info USING (match_id)""")
def a08_coco_json(spark, sf):
    return R.coco_json(with_info(track(spark, sf), spark, sf), F.col("width"), F.col("height"))


_SEG = "s AS (SELECT DISTINCT match_id, cut_run, segment_index, rally_id, start_frame, end_frame, hit_count, quality FROM rally_segment WHERE match_id IS NOT NULL)"
_FIELD = lambda c, text=False: f"""CASE WHEN {c} IS NULL THEN NULL ELSE '"{c}":' || {f"'\"' || {c} || '\"'" if text else c} END"""


@add("", _SEG, "SELECT match_id, cut_run, CAST(count(*) AS BIGINT) AS segments, '{\"count\":' || count(*) || ',\"segments\":[' || string_agg('{' || concat_ws(',', " + ", ".join([*[_FIELD(c) for c in ("segment_index", "rally_id", "start_frame", "end_frame", "hit_count")], _FIELD("quality", True)]) + ") || '}', ',' ORDER BY segment_index NULLS FIRST, rally_id NULLS FIRST, start_frame NULLS FIRST, end_frame NULLS FIRST, hit_count NULLS FIRST, quality NULLS FIRST) || ']}' AS manifest FROM s GROUP BY match_id, cut_run")
def a09_rally_manifest(spark, sf):
    """One manifest per match and cutting run (null is a run of its own) over all rows of a match."""
    s = table(spark, sf, "rally_segment").where("match_id is not null")
    return R.rally_manifest(s.select("match_id", "cut_run", "segment_index", "rally_id", "start_frame", "end_frame", "hit_count", "quality").distinct(), "cut_run")


@add("info", "", """SELECT match_id, round(q0, 6) AS x1, round(q7, 6) AS y4, list_distinct(list_transform([0.5, 1.5, 1.5, 3.0], lambda s: CAST(floor(s * fps + 0.5) AS BIGINT))).list_sort() AS frames FROM info""")
def a10_parameter_texts(spark, sf):
    m = info(spark, sf)
    pts = R.court_points(F.concat_ws(",", *[F.format_string("%.6f", c) for c in Q]))
    return m.select("match_id", F.round(pts[0], 6).alias("x1"), F.round(pts[7], 6).alias("y4"), R.time_frames(F.lit("1.5, 0.5,x,3,1.5"), F.col("fps")).alias("frames"))


_HOMO = G.homography(Q)


@add("info", "p1 AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _HOMO[0].items()) + " FROM (SELECT match_id, " + ", ".join(Q) + " FROM info)), p2 AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _HOMO[1].items()) + " FROM p1)", "SELECT match_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _HOMO[2].items()) + " FROM p2")
def b01_homography(spark, sf):
    m = info(spark, sf).select("match_id", *Q)
    for stage in _HOMO[:2]:
        m = m.withColumns({n: F.expr(e) for n, e in stage.items()})
    return exprs(m, ["match_id"], **{n: f"round({e}, 6)" for n, e in _HOMO[2].items()})


def scalar(name, doc, **cols):
    """A query of expressions over the visible points of every match."""
    def run(spark, sf):
        return exprs(seen(spark, sf), ["match_id", "frame"], **cols)

    run.__name__, run.__doc__ = name, doc
    add("track info", f"s AS ({SEEN})", "SELECT match_id, frame, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + " FROM s")(run)


_X, _Y = G.project("x", "y")
_R = lambda e: f"round({e}, 6)"
_WIDE = G.expanded_quad(Q, 60, 20, 25)
_SCALE = f"sqrt(abs({G.shoelace(Q)}))"
_INTQ = [f"floor({v})" for v in _WIDE]
scalar("b02_project", "Court metres of every visible point.", x_m=_R(_X), y_m=_R(_Y))
scalar("b03_court_margin", "Whether a point lies within 6 m of the court.", near_court=f"({_X}) BETWEEN -6 AND {G.COURT_W + 6} AND ({_Y}) BETWEEN -6 AND {G.COURT_L + 6}")
scalar("b04_metres_per_pixel", "Local scale at or below the court's top edge.", mpp=_R(G.metres_per_pixel("x", "y", "least(q1, q3)")))
scalar("b05_expanded_quad", "Corners of the expanded court.", **{f"e{k}": _R(v) for k, v in enumerate(_WIDE)})
scalar("b06_in_quad", "Inside the expanded court; the integer variant truncates the corners first.", inside=G.in_quad("x", "y", _WIDE), inside_int=G.in_quad("x", "y", _INTQ))
scalar("b07_edge_corridor", "Near the line of the top edge.", near_edge=G.edge_corridor("x", "y", _WIDE))


_SEGS = [G.closest_on_segment("x", "y", Q[2 * i], Q[2 * i + 1], Q[(2 * i + 2) % 8], Q[(2 * i + 3) % 8]) for i in range(4)]
_ENDS = {f"{c}{i}": p for i, pair in enumerate(_SEGS) for c, p in zip(("sx", "sy"), pair)}
_DIST = {f"d{i}": G.dist("x", "y", f"sx{i}", f"sy{i}") for i in range(4)}
_PICK = {f"c{c}": _R(G.case((G.in_quad("x", "y", Q), c), *[(f"d{i} <= least(d0, d1, d2, d3)", f"s{c}{i}") for i in range(4)])) for c in "xy"}
_NAMED = lambda cols: ", ".join(f"{e} AS {n}" for n, e in cols.items())


@add("track info", f"s AS ({SEEN}), e AS (SELECT *, {_NAMED(_ENDS)} FROM s), g AS (SELECT *, {_NAMED(_DIST)} FROM e)", f"SELECT match_id, frame, {_NAMED(_PICK)} FROM g")
def b08_clamp_to_quad(spark, sf):
    """Points outside the court moved to its nearest edge, in three stages, as one expression would outgrow a generated method."""
    d = seen(spark, sf)
    for stage in (_ENDS, _DIST):
        d = d.withColumns({n: F.expr(e) for n, e in stage.items()})
    return exprs(d, ["match_id", "frame"], **_PICK)


scalar("b10_half_court", "y of a player's court position kept in the own half.", y_half=_R(G.half_court("hitter", f"({_Y})")))
scalar("b11_map_pixels", "Position on a 305 x 670 px map of the court.", mx=f"CAST(floor({G.clip(f'({_X}) / {G.COURT_W}', 0, 1)} * 304) AS BIGINT)", my=f"CAST(floor({G.clip(f'({_Y}) / {G.COURT_L}', 0, 1)} * 669) AS BIGINT)")
scalar("b14_line_call", "Signed distance to the lines and the call.", line_m=_R(G.line_distance(_X, _Y)), call=G.line_call(f"({G.line_distance(_X, _Y)})"))
scalar("b15_boundary", "The one edge a point is beyond.", edge=G.boundary(_X, _Y))


def _on_edge():
    t = {"far": (f"({_X}) / {G.COURT_W}", (0, 1, 2, 3)), "near": (f"({_X}) / {G.COURT_W}", (6, 7, 4, 5)), "left": (f"({_Y}) / {G.COURT_L}", (0, 1, 6, 7)), "right": (f"({_Y}) / {G.COURT_L}", (2, 3, 4, 5))}
    edge = G.boundary(_X, _Y)
    at = lambda a, b: G.case(*[(f"{edge} = '{n}'", f"q{i[a]} + {G.clip(r, -0.25, 1.25)} * (q{i[b]} - q{i[a]})") for n, (r, i) in t.items()])
    return at(0, 2), at(1, 3)


scalar("b16_boundary_point", "Where the crossed edge lies in the picture.", bx=_R(_on_edge()[0]), by=_R(_on_edge()[1]))
scalar("b18_target_half", "Whether a landing lies in the half that the hitter aims at.", in_target=G.target_half("hitter", f"({_Y})"))
scalar("b19_zone", "Zone by the distance to the own net.", zone=G.zone(f"abs(({_Y}) - {G.COURT_L / 2})"))
scalar("b13_detect_roi", "Detection window around the expanded court.", **{n: _R(e) for n, e in {"left_px": f"greatest(0, least(least({_WIDE[0]}, {_WIDE[2]}), least({_WIDE[4]}, {_WIDE[6]})))", "right_px": f"least(width, greatest(greatest({_WIDE[0]}, {_WIDE[2]}), greatest({_WIDE[4]}, {_WIDE[6]})))", "top_px": f"greatest(0, least(least({_WIDE[1]}, {_WIDE[3]}), least({_WIDE[5]}, {_WIDE[7]})))", "bottom_px": f"least(height, greatest(greatest({_WIDE[1]}, {_WIDE[3]}), greatest({_WIDE[5]}, {_WIDE[7]})))"}.items()})
scalar("b23_timecode", "Timecode and seconds of a frame.", seconds=_R("frame / fps"), code=G.timecode("frame / fps"))
scalar("b29_curves", "Smooth step over the first 100 frames, and where the orbit camera is on its way round (radius 36 px, roll 4 degrees, zoom 1.12).", step=_R("({0}) * ({0}) * (3 - 2 * ({0}))".format("least(1, greatest(0, frame / 1e2))")), **{n: f"{_R(e)} + 0" for n, e in G.orbit("frame / 1e2", 36, 4, 1.12).items()})


@add("info", "", f"SELECT match_id, round({G.case((f'{_SCALE} IS NULL', '800'), other=G.clip(_SCALE, 400, 1800))}, 6) AS scale FROM info")
def b17_court_scale(spark, sf):
    return exprs(info(spark, sf), ["match_id"], scale=_R(G.case((f"{_SCALE} IS NULL", "800"), other=G.clip(_SCALE, 400, 1800))))


def posed(name, doc, where="true", **cols):
    """A query of expressions over the pose samples; [k] in an expression is keypoint k."""
    spark_e = {n: __import__("re").sub(r"\[(\d+)\]", r"kp[\1]", e) for n, e in cols.items()}
    duck_e = {n: __import__("re").sub(r"\[(\d+)\]", lambda m: f"kp[{int(m[1]) + 1}]", e) for n, e in cols.items()}

    def run(spark, sf):
        return exprs(poses(spark, sf), ["match_id", "frame", "side"], **spark_e)

    run.__name__, run.__doc__ = name, doc
    add("poses", "", "SELECT match_id, frame, side, " + ", ".join(f"{e} AS {n}" for n, e in duck_e.items()) + " FROM poses")(run)


_IN = lambda x, y, m: f"(({x}) BETWEEN b0 - {m} AND b2 + {m} AND ({y}) BETWEEN b1 - {m} AND b3 + {m})"
_LA, _RA = "[15].conf >= 0.22", "[16].conf >= 0.22"
_FX = G.case((f"{_LA} AND {_RA}", "([15].x + [16].x) / 2"), (_LA, "[15].x"), (_RA, "[16].x"), other="(b0 + b2) / 2")
_FY = G.case((f"{_LA} AND {_RA}", "greatest([15].y, [16].y)"), (_LA, "[15].y"), (_RA, "[16].y"), other="b3 - 0.28 * 0.25 * (b3 - b1)")
_BOXD = f"sqrt({'{0} * {0}'.format('greatest(greatest(b0 - [9].x, [9].x - b2), 0)')} + {'{0} * {0}'.format('greatest(greatest(b1 - [9].y, [9].y - b3), 0)')})"
posed("b09_point_in_box", "Wrist against the player's box: inside with margin, distance, and whether a ball at the nose is near the wrist.", inside=_IN("[9].x", "[9].y", 8), box_px=_R(_BOXD), near_wrist=f"{G.dist('[0].x', '[0].y', '[9].x', '[9].y')} <= 45")
posed("b12_foot_point", "Foot point: the ankles seen, else the bottom of the box lifted, kept inside the box.", foot_x=_R(G.clip(_FX, "least(b0, b2)", "greatest(b0, b2)")), foot_y=_R(G.clip(_FY, "least(b1, b3)", "greatest(b1, b3)")))
_ANG = lambda a, b, c: G.angle(f"[{a}].x", f"[{a}].y", f"[{b}].x", f"[{b}].y", f"[{c}].x", f"[{c}].y")
posed("b20_joint_angles", "Elbow and knee angles in degrees.", elbow_l=_R(_ANG(5, 7, 9)), elbow_r=_R(_ANG(6, 8, 10)), knee_l=_R(_ANG(11, 13, 15)), knee_r=_R(_ANG(12, 14, 16)))
posed("b21_axis_separation", "Shoulder axis against hip axis, 0 to 90 degrees.", twist=_R(G.axis_separation("([6].x - [5].x)", "([6].y - [5].y)", "([12].x - [11].x)", "([12].y - [11].y)")))
_TORSO = G.dist("([5].x + [6].x) / 2", "([5].y + [6].y) / 2", "([11].x + [12].x) / 2", "([11].y + [12].y) / 2")
posed("b22_point_helpers", "Midpoints and distances.", mid_x=_R("([5].x + [6].x) / 2"), mid_y=_R("([5].y + [6].y) / 2"), torso_px=_R(_TORSO))
_REACH = f"greatest({G.dist('[5].x', '[5].y', '[9].x', '[9].y')}, {G.dist('[6].x', '[6].y', '[10].x', '[10].y')}) / nullif({_TORSO}, 0)"
_STANCE = f"{G.dist('[15].x', '[15].y', '[16].x', '[16].y')} / nullif({G.dist('[5].x', '[5].y', '[6].x', '[6].y')}, 0)"
posed("b24_pose_scalars", "Reach by torso, smaller knee angle, stance by shoulders, and a score mapped to 0..100.", reach=_R(_REACH), knee=_R(f"least({_ANG(11, 13, 15)}, {_ANG(12, 14, 16)})"), stance=_R(_STANCE), reach_score=_R(G.clip(f"(({_REACH}) - 0.6) / (1.8 - 0.6) * 100", 0, 100)))
_TIP = lambda w, e, c: f"[{w}].{c} + 0.35 * ([{w}].{c} - [{e}].{c})"
_TIPD = lambda w, e: f"{G.dist(_TIP(w, e, 'x'), _TIP(w, e, 'y'), '[0].x', '[0].y')}"
posed("b25_racket_tip", "Virtual racket tip of either arm, and the nearer one's distance to a ball at the nose by torso length.", tip_lx=_R(_TIP(9, 7, "x")), tip_ly=_R(_TIP(9, 7, "y")), tip_torso=_R(G.case((f"{_TORSO} >= 4", f"least({_TIPD(9, 7)}, {_TIPD(10, 8)}) / ({_TORSO})"))))
posed("k11_phase_pose_sample", "Per-sample posture: wrist height, elbow, knee, stance and twist, null for a torso under 4 px.", wrist_height=_R(G.case((f"{_TORSO} >= 4", f"(([5].y + [6].y) / 2 - least([9].y, [10].y)) / ({_TORSO})"))), elbow=_R(f"greatest({_ANG(5, 7, 9)}, {_ANG(6, 8, 10)})"), stance=_R(G.case((f"{_TORSO} >= 4", _STANCE))))

_VALID = "size(filter(kp, p -> p.conf >= 0.28)) >= 4"


@add("poses", "", """SELECT match_id, frame, side, len(list_filter(kp, lambda p: p.conf >= 0.28)) >= 4 AS usable, CAST(u.k - 1 AS BIGINT) AS joint, round((kp[u.k].x - (b0 + b2) / 2) / sqrt((b2 - b0) * (b2 - b0) + (b3 - b1) * (b3 - b1)), 6) AS nx, round((kp[u.k].y - (b1 + b3) / 2) / sqrt((b2 - b0) * (b2 - b0) + (b3 - b1) * (b3 - b1)), 6) AS ny FROM poses, (SELECT unnest(range(1, 18)) AS k) u""")
def b26_pose_normalised(spark, sf):
    p = poses(spark, sf).withColumn("usable", F.expr(_VALID)).select("*", F.posexplode("kp").alias("joint", "p"))
    diag = "sqrt((b2 - b0) * (b2 - b0) + (b3 - b1) * (b3 - b1))"
    return exprs(p, ["match_id", "frame", "side", "usable"], joint="cast(joint as bigint)", nx=f"round((p.x - (b0 + b2) / 2) / {diag}, 6)", ny=f"round((p.y - (b1 + b3) / 2) / {diag}, 6)")


#: The 19 joint pairs of the bone channels (COCO-17 numbering).
BONES = ((0, 1), (0, 2), (1, 2), (1, 3), (2, 4), (3, 5), (4, 6), (5, 6), (5, 7), (7, 9), (6, 8), (8, 10), (5, 11), (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16))
_PAIRS = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(BONES))


@add("poses", f"bone(k, a, b) AS (VALUES {_PAIRS})", "SELECT match_id, frame, side, CAST(k AS BIGINT) AS bone, round(CASE WHEN kp[a + 1].conf > 0.1 AND kp[b + 1].conf > 0.1 THEN kp[b + 1].x - kp[a + 1].x ELSE 0 END, 6) AS dx, round(CASE WHEN kp[a + 1].conf > 0.1 AND kp[b + 1].conf > 0.1 THEN kp[b + 1].y - kp[a + 1].y ELSE 0 END, 6) AS dy, round(CASE WHEN kp[a + 1].conf > 0.1 AND kp[b + 1].conf > 0.1 THEN (kp[a + 1].x + kp[b + 1].x) / 2 ELSE 0 END, 6) AS mid_x FROM poses, bone")
def b27_bone_channels(spark, sf):
    pairs = F.array(*[F.struct(F.col("kp")[a].alias("a"), F.col("kp")[b].alias("b")) for a, b in BONES])
    p = poses(spark, sf).select("match_id", "frame", "side", F.posexplode(pairs).alias("bone", "p"))
    both = (F.col("p.a.conf") > 0.1) & (F.col("p.b.conf") > 0.1)
    val = lambda e: F.round(F.when(both, e).otherwise(0.0), 6)
    return p.select("match_id", "frame", "side", F.col("bone").cast("long").alias("bone"), val(F.col("p.b.x") - F.col("p.a.x")).alias("dx"), val(F.col("p.b.y") - F.col("p.a.y")).alias("dy"), val((F.col("p.a.x") + F.col("p.b.x")) / 2).alias("mid_x"))
