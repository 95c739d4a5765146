"""Operators at their usual limits against values worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from courtlane.functions import geometry as G
from courtlane.functions import strokes as S
from courtlane.operators import classical, coaching, fusion, hits, kernels, landing, players, sequence, shots, tracklets, vetoes

FLAT = {"h11": 0.01, "h12": 0.0, "h13": 0.0, "h21": 0.0, "h22": 0.01, "h23": 0.0, "h31": 0.0, "h32": 0.0, "h33": 1.0}  # a pixel is a centimetre
QUAD = [0.0, 0.0, 610.0, 0.0, 610.0, 1340.0, 0.0, 1340.0]
TRACK = "match_id long, frame long, vis boolean, x double, y double, source string, conf double"


def value(spark, expr, **cols):
    df = spark.range(1)
    return df.withColumns({k: F.lit(v) for k, v in cols.items()}).select(F.expr(expr).alias("v")).first().v


def info(spark, fps=25.0):
    return spark.range(1).select(F.lit(1).cast("long").alias("match_id"), F.lit(fps).alias("fps"), F.lit(1280.0).alias("width"), F.lit(1400.0).alias("height"), *[F.lit(v).alias(k) for k, v in FLAT.items()], *[F.lit(v).alias(f"q{i}") for i, v in enumerate(QUAD)])


def test_geometry(spark):
    v = lambda e, **c: value(spark, e, **(FLAT | {f"q{i}": q for i, q in enumerate(QUAD)} | c))
    x, y = G.project("x", "y")
    assert (v(x, x=305.0, y=670.0), v(y, x=305.0, y=670.0)) == pytest.approx((3.05, 6.70))
    q = [f"q{i}" for i in range(8)]
    assert v(G.shoelace(q)) == pytest.approx(610 * 1340)
    assert v(G.in_quad("x", "y", q), x=0.0, y=700.0) and not v(G.in_quad("x", "y", q), x=-1.0, y=700.0)
    assert v(G.line_distance("x", "y"), x=1.0, y=5.0) == pytest.approx(1.0) and v(G.line_distance("x", "y"), x=-3.0, y=-4.0) == pytest.approx(-5.0)
    assert [v(G.line_call("d"), d=d) for d in (0.3, 0.2, -0.2, -0.3)] == ["in", "review", "review", "out"]
    assert [v(G.zone("d"), d=d) for d in (1.9, 2.2, 3.0, 4.4, 5.0)] == ["front", None, "mid", None, "back"]
    assert [v(G.boundary("x", "y"), x=x, y=y) for x, y in ((-0.1, 5.0), (6.2, 5.0), (3.0, -0.1), (3.0, 13.5), (-1.0, -1.0), (3.0, 5.0))] == ["left", "right", "far", "near", None, None]
    assert v(G.target_half("h", "y"), h="near", y=7.2) and not v(G.target_half("h", "y"), h="near", y=7.3) and v(G.target_half("h", "y"), h="unknown", y=7.3) is None
    assert v(G.angle("x", "y", "0e0", "0e0", "0e0", "1e0"), x=1.0, y=0.0) == pytest.approx(90) and v(G.angle("0e0", "0e0", "0e0", "0e0", "0e0", "1e0")) is None
    assert v(G.axis_separation("1e0", "0e0", "x", "y"), x=-1.0, y=1.0) == pytest.approx(45)
    assert v(G.timecode("s"), s=75.5) == "01:15"
    assert v(G.metres_per_pixel("x", "y", 0.0), x=5.0, y=-4.0) == pytest.approx(0.01)
    assert (v(G.half_court("s", "y"), s="near", y=5.0), v(G.half_court("s", "y"), s="far", y=6.7)) == pytest.approx((6.701, 6.7))
    assert v(f"({G.closest_on_segment('x', 'y', '0e0', '0e0', '1e1', '0e0')[0]})", x=12.0, y=3.0) == 10
    wide = G.expanded_quad(q, 60, 20, 25)
    assert [v(e) for e in wide[:4]] == pytest.approx([-25, -60, 635, -60]) and [v(e) for e in wide[4:]] == pytest.approx([635, 1360, -25, 1360])
    assert v(G.edge_corridor("x", "y", q), x=-40.0, y=18.0) and not v(G.edge_corridor("x", "y", q), x=10.0, y=19.0)


def test_homography_of_the_flat_court(spark):
    df = spark.range(1).withColumns({f"q{i}": F.lit(q) for i, q in enumerate(QUAD)})
    for stage in G.homography([f"q{i}" for i in range(8)]):
        df = df.withColumns({k: F.expr(e) for k, e in stage.items()})
    r = df.first()
    assert [r[k] for k in FLAT] == pytest.approx(list(FLAT.values()), abs=1e-12)


def test_orbit(spark):
    at = lambda t: {k: value(spark, e, t=t) for k, e in G.orbit("t", 10, 4, 1.2).items()}
    assert at(0.0) == pytest.approx({"dx": 10, "dy": 0, "roll": 0, "scale": 1.2}) and at(0.25) == pytest.approx({"dx": 0, "dy": 4.2, "roll": 4, "scale": 1.11}, abs=1e-9) and at(2.0) == pytest.approx(at(1.0))


def test_a_flight_of_ten_metres_in_a_second(spark):
    one = info(spark, 10.0).drop("h11", "h22").withColumns({"h11": F.lit(1.0), "h22": F.lit(1.0)})
    t = spark.createDataFrame([(1, f, True, f * 0.6, 5.0, "model", 1.0) for f in range(1, 11)], TRACK)
    t = t.unionByName(spark.createDataFrame([(1, 0, True, 0.0, 5.0, "model", 1.0)], TRACK))
    h = spark.createDataFrame([(1, 0), (1, 10)], "match_id long, frame long")
    r = shots.shot_speeds(t, h, one, ("model",), ("model",)).first()
    assert (r.distance_m, r.observed_seconds, r.speed_kmh) == pytest.approx((6.0, 1.0, 21.6))


# --- fusion and smoothing ------------------------------------------------------------------------------------------------


def smoothed(spark, points, resets=None, n=None, **more):
    rows = [(1, f, True, x, y, "model", 0.9) for f, (x, y) in points.items()] + ([(1, n - 1, False, None, None, "missing", 0.0)] if n and n - 1 not in points else [])
    df = spark.createDataFrame(rows, TRACK)
    r = None if resets is None else spark.createDataFrame([(1, f) for f in resets], "match_id long, frame long")
    return {x.frame: x for x in kernels.smoothed_track(df, ("model",), resets=r, **more).collect()}


def test_smoothing_interpolates_forecasts_and_takes_up_again(spark):
    got = smoothed(spark, {0: (100.0, 300.0), 1: (110.0, 300.0), 10: (700.0, 300.0)}, longest=2)
    assert sorted(got) == list(range(11)) and [got[f].source for f in (0, 1, 2, 4, 5, 9)] == ["model", "model", "kalman", "kalman", "missing", "missing"]
    assert got[10].vis and got[10].source == "model" and abs(got[10].x - 700) < 5
    got = smoothed(spark, {0: (100.0, 300.0), 4: (140.0, 300.0)})
    assert [got[f].source for f in range(5)] == ["model", "interp", "interp", "interp", "model"] and all(got[f].conf == 0.55 for f in (1, 2, 3))


def test_no_hole_over_a_reset_or_the_top_edge_is_filled(spark):
    track = {0: (100.0, 300.0), 1: (110.0, 300.0), 5: (150.0, 300.0), 6: (160.0, 300.0)}
    got = smoothed(spark, track, resets=[2])
    assert not any(got[f].vis for f in (2, 3, 4)) and got[5].source == "model" and got[5].x == 150.0
    got = smoothed(spark, {0: (100.0, 90.0), 1: (110.0, 30.0), 4: (140.0, 120.0), 5: (150.0, 160.0)})
    assert not got[2].vis and not got[3].vis and got[4].x == 140.0  # left over the top, came back: a new start
    assert smoothed(spark, {0: (100.0, 90.0), 1: (110.0, 80.0), 4: (140.0, 100.0)})[2].source == "interp"


def test_long_holes_and_the_frames_before_the_first_point_have_rows(spark):
    got = smoothed(spark, {5: (100.0, 300.0), 6: (110.0, 300.0), 100: (400.0, 500.0), 101: (410.0, 500.0)}, n=120)
    assert sorted(got) == list(range(120)) and not got[0].vis and not got[60].vis and got[100].source == "model" and abs(got[100].x - 400) < 1


def test_gaps_are_filled_from_a_supported_track_only(spark):
    t = spark.createDataFrame([(1, f, f in (0, 1, 5, 6), 100.0 + 10 * f, 300.0, "model", 0.9) for f in range(7)], TRACK)
    c = [(1, f, 100.4 + 10 * f, 303.0, 0.6, 7) for f in (1, 2, 3)] + [(1, 4, 140.0, 300.0, 0.6, 8)]
    cls = spark.createDataFrame(c, "match_id long, frame long, x double, y double, conf double, track_id long")
    got = sorted(tuple(r) for r in fusion.fill_gaps(t, cls).collect())
    assert got == [(1, 2, 120.0, 303.0, pytest.approx(0.39), 7), (1, 3, 130.0, 303.0, pytest.approx(0.39), 7)]
    assert fusion.fill_gaps(t, cls, lambda f: f == 2).count() == 0 and fusion.fill_gaps(t, cls, lambda f: f == 3).count() == 2
    far = spark.createDataFrame([(1, f, 100.0 + 10 * f, 380.0, 0.6, 7) for f in (1, 2, 3)], cls.schema)
    assert fusion.fill_gaps(t, far).count() == 0 and fusion.fill_gaps(t, cls.limit(0)).count() == 0
    middle = spark.createDataFrame([(1, f, f in (0, 13), 100.0, 300.0, "model", 0.9) for f in range(14)], TRACK)
    long = spark.createDataFrame([(1, f, 100.0, 300.0, 0.6, 7) for f in range(1, 13)], cls.schema)
    assert fusion.fill_gaps(middle, long).count() == 12  # the middle of a hole of twelve as well


def test_interpolation_stops_at_breaks(spark):
    t = spark.createDataFrame([(1, f, True, 10.0 * f, 300.0, "model", 0.9) for f in (0, 3, 6, 20)], TRACK)
    b = spark.createDataFrame([(1, 6)], "match_id long, frame long")
    assert sorted(r.frame for r in fusion.interpolate(t).collect()) == [1, 2, 4, 5] and sorted(r.frame for r in fusion.interpolate(t, breaks=b).collect()) == [1, 2]


# --- suppression ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(40))
def test_suppression_in_a_stream_equals_the_greedy_fold(seed):
    rnd = random.Random(seed)
    sep = rnd.randrange(1, 9)
    rows = [(f, f, float(rnd.randrange(6) if seed % 2 else f)) for f in sorted(rnd.sample(range(150), 60))]
    s = sequence.Suppressor(sep)
    got = [r[1] for x in rows for r in s.row((1,), x)] + [r[1] for r in s.end((1,))]
    kept = []
    for f, _, v in sorted(rows, key=lambda r: (-r[2], r[1])):
        if all(abs(f - k) >= sep for k in kept):
            kept.append(f)
    assert sorted(got) == sorted(kept)


# --- candidates and tracks ----------------------------------------------------------------------------------------------------


def test_component_gates_and_quality(spark):
    rows = [(1, 0, k, 5.0, 5.0, float(w), float(h), float(a), 40.0, 180.0, 140.0) for k, (w, h, a) in enumerate([(8, 6, 36), (1, 6, 5), (29, 6, 100), (10, 10, 21), (20, 3, 30), (2, 2, 2), (14, 14, 151)])]
    c = classical.shape_candidates(spark.createDataFrame(rows, "match_id long, frame long, cand_id long, x double, y double, width double, height double, area double, motion double, value double, background double"))
    r = c.collect()
    assert [x.cand_id for x in r] == [0]
    assert r[0].quality == pytest.approx(0.023 * 40 + 0.014 * 40 + 0.0025 * 180 + math.sqrt(0.75 * 0.75) - 0.004 * 9) and (r[0].aspect, r[0].density, r[0].contrast) == (0.75, 0.75, 40)


def points(spark, n=10, step=12.0, quality=3.2, y0=200.0, **more):
    rows = [(1, 0, 0, f, f, 100.0 + step * f, y0 + 0.0 * f, quality, more.get("aspect", 0.7), more.get("density", 0.6), more.get("contrast", 40.0)) for f in range(n)]
    return spark.createDataFrame(rows, "match_id long, run long, track long, frame long, cand_id long, x double, y double, quality double, aspect double, density double, contrast double")


def test_measures_gates_and_confidence(spark):
    m = tracklets.measures(points(spark)).first()
    assert (m.n, m.median_speed, m.spread, m.fill, m.accel_p80, m.turn_p80, m.bend) == pytest.approx((10, 12.0, 108.0, 1.0, 0.0, 0.0, 1.0)) and m.rank == pytest.approx(3.2 + 0.5 + 1.0 + 0.3)
    ok = lambda o=None, **k: classical.strict(tracklets.plausible(tracklets.measures(points(spark, **k))), o or classical.Options()).count()
    assert ok() == 1 and ok(n=7) == 0 and ok(quality=2.0) == 0 and ok(aspect=0.65) == 0 and ok(density=0.52) == 0 and ok(contrast=27.9) == 0
    assert ok(classical.options(points=5), n=7) == 1
    edge = lambda **k: classical.edge(tracklets.plausible(tracklets.measures(points(spark, **k)))).count()
    assert edge(n=5, y0=24.0) == 1 and edge(n=5, y0=25.0) == 0 and edge(n=4, y0=24.0) == 0 and edge(n=5, y0=24.0, quality=2.9) == 0 and edge(n=5, y0=24.0, contrast=34.0) == 0
    conf = lambda r, q: spark.range(1).select(classical.confidence(F.lit(r), F.lit(q)).alias("c")).first().c
    assert [conf(4.45, 1.35), conf(5.125, 2.85), conf(9.0, 9.0)] == pytest.approx([0.52, 0.74, 0.96])
    h = classical.endpoint_hits(points(spark), tracklets.measures(points(spark))).first()
    assert (h.frame, h.x, h.speed) == (9, 208.0, 12.0)


def test_options_refuse_what_they_do_not_know():
    assert classical.options(turn=20.0).turn == 20.0 and classical.options(classical.Options(rank=5.0)).rank == 5.0
    with pytest.raises(TypeError, match="unknown option"):
        classical.options(trun=20.0)
    with pytest.raises(TypeError):
        classical.options({"turn": 20.0})


def test_identity_rules(spark):
    det = "match_id long, frame long, det_id long, mx double, my double"
    who = lambda rows: {(r.frame, r.side): r.det_id for r in kernels.player_identity(spark.createDataFrame([(1, *r) for r in rows], det), line="300").collect()}
    assert who([(0, 1, 100.0, 100.0), (0, 2, 100.0, 500.0)]) == {(0, "far"): 1, (0, "near"): 2}
    # one detection in the band both pools share goes to the side that holds its identity
    assert who([(0, 1, 100.0, 100.0), (0, 2, 100.0, 500.0), (1, 1, 100.0, 305.0)]) == {(0, "far"): 1, (0, "near"): 2, (1, "far"): 1}
    # a far player of a new identity may not jump far, nor up; the old one is still held afterwards, whatever the hole
    got = who([(0, 1, 100.0, 100.0), (1, 3, 300.0, 100.0), (2, 3, 100.0, 60.0), (500, 4, 100.0, 110.0)])
    assert got == {(0, "far"): 1, (500, "far"): 4}


def test_player_filters(spark):
    rows = [(0.0, 0.0, 10.0, 20.0, 300.0, 700.0), (0.0, 0.0, 9.0, 20.0, 300.0, 700.0), (0.0, 0.0, 10.0, 20.0, 300.0, 20.0), (0.0, 0.0, 10.0, 20.0, -5.0, 700.0)]
    d = spark.createDataFrame(rows, "b0 double, b1 double, b2 double, b3 double, fx double, fy double").withColumns({f"q{i}": F.lit(q) for i, q in enumerate(QUAD)})
    q = [f"q{i}" for i in range(8)]
    assert [(r.fx, r.fy) for r in players.player_candidates(d, q).collect()] == [(300.0, 700.0)]
    assert players.player_candidates(d.withColumns({"far_x": F.lit(300.0), "far_y": F.lit(90.0)}), q).count() == 2


def test_closest_candidate(spark):
    c = spark.createDataFrame([(1, 0, 5, 10.0, 0.0), (1, 0, 4, -10.0, 0.0), (1, 0, 6, 11.0, 0.0), (1, 1, 7, 0.0, 0.0)], "match_id long, frame long, det_id long, x double, y double")
    r = spark.createDataFrame([(1, 0, 0.0, 0.0)], "match_id long, frame long, x double, y double")
    assert [tuple(x) for x in kernels.closest(c, r).collect()] == [(1, 0, 4)]


# --- vetoes ----------------------------------------------------------------------------------------------------------------------


def test_branches_split_at_turns_too(spark):
    xs = [100.0, 110.0, 120.0, 90.0, 60.0, 70.0, 80.0, 90.0, 100.0, 110.0]
    t = spark.createDataFrame([(1, f, True, x, 300.0, "model", 0.9) for f, x in enumerate(xs)], TRACK)
    assert vetoes.short_branches(t).count() == 0  # a turn by 40 px is none
    xs = [100.0, 120.0, 140.0, 110.0, 80.0, 110.0, 140.0, 170.0, 200.0, 230.0]
    t = spark.createDataFrame([(1, f, True, x, 300.0, "model", 0.9) for f, x in enumerate(xs)], TRACK)
    assert {(r.frame, r.branch) for r in vetoes.short_branches(t).collect()} == {(3, 3), (4, 3)}


def test_dual_motion_needs_support_on_both_sides(spark):
    def protected(n=9, step=20.0, wobble=0.0, gone=()):
        p = [(1, f, True, 100.0 + step * f, 300.0, True, 100.0 + step * f + wobble * (f % 2), 301.0) for f in range(n) if f not in gone]
        ph = spark.createDataFrame(p, "match_id long, frame long, a_vis boolean, a_x double, a_y double, b_vis boolean, b_x double, b_y double")
        merged = spark.createDataFrame([(1, f, True, 100.0 + step * f, 300.0, "model") for f in range(n)], "match_id long, frame long, vis boolean, x double, y double, label string")
        cand = spark.createDataFrame([(1, f) for f in (2, 3, 4, 5, 6)], "match_id long, frame long")
        return [(r.start_frame, r.end_frame) for r in vetoes.coherent_dual_motion(ph, merged, cand, F.lit(False)).collect()]

    assert protected() == [(2, 6)] and protected(step=9.0) == [] and protected(n=8) == [] and protected(wobble=20.0) == [] and protected(gone=(4,)) == []


# --- hits -------------------------------------------------------------------------------------------------------------------------

HIT = "hit_id long, match_id long, frame long, x double, y double, source string"
BOX = "match_id long, frame long, b0 double, b1 double, b2 double, b3 double, kp array<struct<x:double,y:double,conf:double>>"


def test_each_reason_of_evidence(spark):
    track = [(1, f, True, 100.0 + 10 * f, 300.0, "model", 0.9) for f in range(0, 30)] + [(1, 40, True, 500.0, 20.0, "model_edge", 0.2), (1, 60, False, None, None, "missing", 0.0), (1, 99, False, None, None, "missing", 0.0)]
    h = [(1, 1, 10, 200.0, 300.0, "curvature"), (2, 1, 10, 200.0, 300.0, "audio_pose"), (3, 1, 40, 500.0, 20.0, "curvature"), (4, 1, 20, 300.0, 300.0, "curvature"), (5, 1, 60, 300.0, 300.0, "endpoint"), (6, 1, 15, 350.0, 300.0, "curvature"), (7, 1, 29, 390.0, 300.0, "curvature"), (8, 1, 33, 390.0, 300.0, "endpoint"),
         (9, 1, 100, 1.0, 1.0, "curvature"), (10, 1, 12, None, 1.0, "curvature"), (11, 1, 14, 240.0, 300.0, "curvature"), (12, 1, 5, 150.0, 300.0, "curvature")]
    audio = [(1, f) for f in (10, 40, 60, 15, 29, 33, 14, 11)]
    kp = [(0.0, 0.0, 1.0)] * 17
    boxes = [(1, 14, 230.0, 290.0, 250.0, 310.0, kp), (1, 20, 0.0, 0.0, 1.0, 1.0, kp)]
    got = {r.hit_id: (r.reason, r.ball_observed) for r in hits.evidence(spark.createDataFrame(h, HIT), spark.createDataFrame(track, TRACK), spark.createDataFrame(audio, "match_id long, frame long"), spark.createDataFrame(boxes, BOX)).collect()}
    assert got == {
        1: ("accepted", True), 2: ("pose_only", False), 3: ("edge_or_derived_event", False), 4: ("accepted", True), 5: ("insufficient_real_points", False), 6: ("trajectory_position_mismatch", False), 7: ("missing_bidirectional_trajectory", False),
        8: ("accepted", False), 9: ("invalid_frame_or_position", False), 10: ("invalid_frame_or_position", False), 11: ("player_overlap", False), 12: ("accepted", True),
    }
    alone = spark.createDataFrame([(1, 1, 20, 300.0, 300.0, "curvature")], HIT)
    assert hits.evidence(alone, spark.createDataFrame(track, TRACK), spark.createDataFrame([(1, 27)], "match_id long, frame long"), spark.createDataFrame([], BOX)).first().reason == "missing_audio"


def test_alternation_repairs_one_hit_between_two_anchors(spark):
    cols = "hit_id long, match_id long, rally long, frame long, hitter string, hitter_confidence double, hitter_source string, source string, towards string, sure double"
    row = lambda i, rally, f, who, c=0.9, src="pose_contact", kind="curvature", to=None, s=None: (i, 1, rally, f, who, c, src, kind, to, s)
    rows = [row(1, 1, 0, "near"), row(2, 1, 50, "unknown", None), row(3, 1, 100, "near"),
            row(4, 2, 0, "near"), row(5, 2, 8, "unknown", None), row(6, 2, 100, "near"),  # collides
            row(7, 3, 0, "near", 0.8, "sidecar"), row(8, 3, 50, "unknown", None), row(9, 3, 100, "near"),  # a sidecar's label needs 0.85
            row(10, 4, 0, "far"), row(11, 4, 50, "far", 0.4, to="near", s=0.5), row(12, 4, 100, "far"),  # corrected by its direction
            row(13, 5, 0, "far"), row(14, 5, 50, "unknown", None, kind="endpoint"), row(15, 5, 100, "far"), row(16, 0, 5, "unknown")]
    got = {r.hit_id: (r.hitter, r.provenance) for r in hits.alternation(spark.createDataFrame(rows, cols), direction=("towards", "sure")).collect()}
    assert got[2] == ("far", "rally_alternation_inferred") and got[5][0] == got[8][0] == got[14][0] == "unknown" and got[11] == ("near", "rally_alternation_corrected") and 16 not in got


# --- landing -----------------------------------------------------------------------------------------------------------------------

FRAMES = "match_id long, rally long, frame long, x double, y double, conf double"
HITS = "match_id long, rally long, frame long, score double, source string, hitter string, uncertain boolean, ball_observed boolean, hitter_confidence double, hitter_source string, shot_end long"


def call(spark, tail, extra=(), hitter="far", start=100, **hit):
    """A far player's shot whose last points are ``tail`` (x, y), one a frame, after a long flight."""
    flight = [(305.0, 500.0 + 30 * k) for k in range(8)]
    rows = [(1, 1, start + 10 + k, x, y, 0.9) for k, (x, y) in enumerate([*flight, *tail])] + [(1, 1, start, 305.0, 300.0, 0.9)] + list(extra)
    h = [(1, 1, start, 0.8, "curvature", hitter, False, True, 0.9, "pose_contact", hit.get("shot_end"))] + hit.get("more", [])
    return landing.rally_calls(spark.createDataFrame(rows, FRAMES), spark.createDataFrame(h, HITS), info(spark), hit.get("review", False)).first()


REST = [(305.0, 740.0), (305.0, 765.0), (305.0, 786.0), (305.0, 787.0), (305.0, 787.0)]


def test_a_shuttle_at_rest_in_the_court(spark):
    r = call(spark, REST)
    assert r.reason is None and r.decision == "in" and r.hitter == "far" and r.y_m == pytest.approx(7.87) and r.confidence >= 80
    assert call(spark, REST, hitter="unknown").decision == "review" and call(spark, REST, review=True).decision == "review"
    assert call(spark, REST, hitter="near").reason == "wrong_target_half"
    assert call(spark, [(305.0, 760.0 + 30 * k) for k in range(6)]).reason == "no_landing_evidence"
    assert call(spark, REST, shot_end=150).reason == "shot_continues_to_next_contact"
    strong = (1, 1, 118, 0.95, "curvature", "near", True, True, 0.95, "other", None)
    assert call(spark, REST, more=[strong]).reason == "later_hit_unconfirmed"
    late = [(1, 1, 160 + k, 305.0, 900.0, 0.9) for k in range(4)]
    assert (call(spark, REST, late).decision, call(spark, REST, late).rejected_runs) == ("review", 1)


def test_rallies_without_a_call(spark):
    i, f = info(spark), [(1, 1, 5, 1.0, 1.0, 0.9)]
    reason = lambda frames, hits_: landing.rally_calls(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(hits_, HITS), i).first().reason
    hit = lambda u=False, seen=True: (1, 1, 10, 0.8, "curvature", "far", u, seen, 0.9, "x", None)
    assert reason(f, [hit(True)]) == "no_confirmed_hit" and reason(f, [hit()]) == "no_post_hit_observation"
    assert reason([(1, 1, 20 + 4 * k, 1.0, 1.0, 0.9) for k in range(5)], [hit()]) == "discontinuous_terminal_track"
    assert reason([(1, 1, 11 + k, 1.0, 1.0, 0.9) for k in range(3)], [hit()]) == "flight_too_short"


def test_flight_on_both_sides_of_a_hit(spark):
    h = spark.createDataFrame([(1, 1, 10, 900.0)], "match_id long, rally long, frame long, scale double")
    way = lambda after: [(1, 1, 7 + k, 100.0 + 12 * k, 300.0) for k in range(4)] + [(1, 1, 11 + k, 136.0 + after * (k + 1), 300.0) for k in range(4)]
    two = lambda rows: landing.two_sided(h, spark.createDataFrame(rows, "match_id long, rally long, frame long, x double, y double")).count()
    assert two(way(-12.0)) == 1 and two(way(12.0)) == 0 and two(way(20.0)) == 1 and two(way(-3.0)) == 0 and two([r for r in way(-12.0) if r[2] != 10]) == 0


# --- strokes and coaching -------------------------------------------------------------------------------------------------------------


def test_evidence_score(spark):
    s = lambda hitter, receiver: spark.range(1).select(S.evidence_score(F.lit(True), F.lit(6), F.lit(True), F.lit("front"), F.lit("back"), F.lit(3), F.lit(0.9), F.lit(hitter), F.lit(receiver)).alias("s")).first().s
    assert [s(False, False), s(True, False), s(False, True), s(True, True)] == [88, 76, 80, 68]  # the cap comes first


GOOD = {"family": "smash", "confidence": 80.0, "contact_samples": 4, "pose_confidence": 0.9, "knee": 175.0, "knee_samples": 3, "stance": 1.0, "stance_samples": 3, "elbow": 120.0, "elbow_samples": 3, "reach": 0.9, "reach_samples": 3, "contact_distance": 1.0, "contact_distance_samples": 3, "post_motion_m": 0.5,
        "arm": "right", "arm_above_share": 0.8, "arm_above_samples": 3, "prep_samples": 3, "prep_knee": 150.0, "prep_knee_samples": 3, "prep_stance": 0.5, "prep_stance_samples": 3, "prep_wrist": 0.0, "contact_wrist": 0.1, "contact_wrist_samples": 2, "peak_wrist_speed": 2.0, "flight_seconds": 0.5,
        "recovery_intervals": 3, "recovery_observed": 0.8, "recovery_stable": True, "recovery_stable_seconds": 0.3, "phase_confidence": 0.9, "real_points": 8, "event_confirmed": True}


def review(spark, reasons=(), **changed):
    row = GOOD | changed
    df = spark.range(1).withColumns({k: F.lit(v) for k, v in row.items()}).withColumn("phase_reasons", F.array(*[F.lit(r) for r in reasons]) if reasons else F.array().cast("array<string>"))
    return coaching.reviewed(df).first()


def test_signals_and_gates_of_a_stroke(spark):
    r = review(spark)
    assert r.signals == ["overhead_extension", "back_support"] and r.phase_signals == ["preparation_support"] and not r.type_reasons and not r.phase_reasons_all and r.eligible_signals == ["overhead_extension", "back_support", "preparation_support"]
    r = review(spark, family="back_unknown", confidence=70.0, contact_samples=2, pose_confidence=0.7, real_points=5, elbow=150.0, knee=150.0)
    assert r.type_reasons == ["stroke_family_unknown", "stroke_confidence_low", "contact_samples_low", "pose_confidence_low", "trajectory_points_low", "no_actionable_signal"] and not r.signals
    assert r.phase_reasons_all == ["contact_samples_low", "trajectory_points_low"] and r.eligible_signals == []
    r = review(spark, ("prep_samples_low", "recovery_samples_low"), event_confirmed=False)
    assert r.phase_reasons_all == ["event_unconfirmed", "prep_samples_low"]  # recovery isn't spoken of
    assert review(spark, contact_samples=1).signals == [] and review(spark, family="serve", knee=160.0, post_motion_m=0.1).signals == ["serve_first_step"]
    assert review(spark, family="net", contact_distance=0.7, knee=150.0).signals == ["front_contact_space"]


def test_advice_needs_three_independent_hits(spark):
    rows = [(1, 1, i, 10 * i, "smash", 80.0, ["back_support"]) for i in range(3)] + [(1, 1, 0, 0, "smash", 75.0, ["back_support", "overhead_extension"])]
    rows += [(1, 2, i, 500 + i, "clear", 80.0, ["overhead_extension"]) for i in range(2)] + [(1, 3, 0, 500, "clear", 80.0, ["overhead_extension"])]  # a frame claimed twice
    rows += [(1, 4, 0, 900, "net", 80.0, ["back_support"]), (1, None, 0, 1, "net", 80.0, ["front_support"])]
    h = coaching.independent_hits(spark.createDataFrame(rows, "match_id long, rally long, idx long, frame long, family string, confidence double, eligible_signals array<string>"))
    got = {(r.rally, r.idx): (r.confidence, r.signals) for r in h.collect()}
    assert got[(1, 0)] == (75.0, ["back_support"]) and (2, 0) not in got and (3, 0) not in got and (2, 1) in got
    assert [tuple(r) for r in coaching.recommendations(h).select("coach_group", "signal", "hits", "place", "priority").collect()] == [("backcourt", "back_support", 3, 1, "medium")]
