"""Sequence helpers and kernels against plain Python."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlane.operators import kernels, sequence, tracklets


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(sequence, "BLOCK_BITS", 3)


def series(spark, seed=1, n=120, drop=0.3):
    rnd = random.Random(seed)
    rows = [(m, f, rnd.random() < 0.5, float(rnd.randrange(100))) for m in (1, 2) for f in range(n) if rnd.random() > drop]
    return rows, spark.createDataFrame(rows, "match_id long, frame long, on boolean, v double")


def test_anchors(spark):
    rows, df = series(spark)
    got = sequence.anchors(df, before={"b": F.when(F.col("on"), F.col("v"))}, after={"a": F.when(F.col("on"), F.col("frame"))}).collect()
    for r in got:
        past = [x for x in rows if x[0] == r.match_id and x[1] < r.frame and x[2]]
        later = [x for x in rows if x[0] == r.match_id and x[1] > r.frame and x[2]]
        assert r.b == (past[-1][3] if past else None) and r.a == (later[0][1] if later else None)
    assert len(got) == len(rows)


def test_runs_and_offsets(spark):
    rows, df = series(spark, 2)
    have = {(m, f): v for m, f, _, v in rows}
    for r in sequence.at_offsets(df, ["v"], [-2, 1]).collect():
        assert r.v_m2 == have.get((r.match_id, r.frame - 2)) and r.v_p1 == have.get((r.match_id, r.frame + 1))
    on = sorted((m, f) for m, f, o, _ in rows if o)
    want, start = {}, None
    for prev, (m, f) in zip([None, *on], on):
        if prev is None or prev[0] != m or f - prev[1] > 2:
            start = f
        want[m, f] = start
    assert {(r.match_id, r.frame): r.run for r in sequence.runs(df, F.col("on"), 2).collect()} == want


def test_exact_percentiles(spark):
    rows, df = series(spark, 3, 400)
    got = sequence.percentiles_by(df, ["match_id"], F.col("v"), {"a": 0.5, "b": 0.78}, 7.0).collect()
    for r in got:
        v = [x[3] for x in rows if x[0] == r.match_id]
        assert math.isclose(r.a, np.percentile(v, 50)) and math.isclose(r.b, np.percentile(v, 78))


def test_suppression(spark):
    rows, df = series(spark, 4)
    want = []
    for m in (1, 2):
        kept = []
        for _, f, _, v in sorted((r for r in rows if r[0] == m), key=lambda r: (-r[3], r[1])):
            if all(abs(f - g) >= 4 for g in kept):
                kept.append(f)
        want += [(m, f) for f in kept]
    assert sorted((r.match_id, r.frame) for r in sequence.suppressed(df, F.col("v"), 4).collect()) == sorted(want)


def matrix_filter(obs, n):
    """The four-dimensional filter, as matrices."""
    a = np.eye(4)
    a[0, 2] = a[1, 3] = 1
    q = 700 * np.array([[0.25, 0, 0.5, 0], [0, 0.25, 0, 0.5], [0.5, 0, 1, 0], [0, 0.5, 0, 1]])
    h = np.eye(2, 4)
    s, out = None, {}
    start = lambda z: (np.array([*z, 0, 0]), np.diag([324.0, 324, 250, 250]))
    last, warm = None, True
    for f in range(n):
        z = obs.get(f)
        if s is None:
            if z is not None:
                s, p = start(z)
                last, warm = f, True
                out[f] = (*z, True)
            continue
        s, p = a @ s, a @ p @ a.T + q
        ok = rej = again = False
        if z is not None:
            d = np.array(z) - s[:2]
            if np.hypot(*d) <= max(180, 5 * math.sqrt(p[0, 0] + p[1, 1])):
                k = p @ h.T @ np.linalg.inv(h @ p @ h.T + 324 * np.eye(2))
                s, p, ok, last = s + k @ d, (np.eye(4) - k @ h) @ p, True, f
            else:
                rej = warm = True
            if not ok and f - last > 3:
                s, p = start(z)
                ok = again = True
                last = f
        if ok:
            warm = again
            out[f] = (s[0], s[1], True)
        elif f - last <= 3 and not warm and not rej:
            out[f] = (s[0], s[1], True)
        else:
            s[2:] *= 0.35
            out[f] = (None, None, False)
    return out


def test_kalman_equals_the_matrix_filter(spark):
    rnd = random.Random(5)
    obs = {f: (300 + 9.0 * f + rnd.gauss(0, 3), 300 + 80 * math.sin(f / 9)) for f in range(150) if rnd.random() > 0.25}
    obs[60] = (5000.0, 5000.0)
    rows = [(1, f, True, x, y, "model", 0.9, True) for f, (x, y) in obs.items()]
    df = spark.createDataFrame(rows, "match_id long, frame long, vis boolean, x double, y double, source string, conf double, raw_vis boolean")
    want = matrix_filter(obs, max(obs) + 1)
    got = {r.frame: r for r in kernels.smooth(df, ("model",)).collect()}
    assert set(got) == set(want)
    for f, (x, y, v) in want.items():
        assert got[f].vis == v and (not v or (math.isclose(got[f].x, x, abs_tol=1e-6) and math.isclose(got[f].y, y, abs_tol=1e-6)))


def brute_locks(pts, window, radius, path, extend, step, most=10**9, preroll=0):
    out, scan, locks = set(), 0, 0
    while scan + window <= len(pts) and locks < most:
        lock = None
        for b in range(scan, len(pts) - window + 1):
            w = pts[b : b + window]
            c = (statistics.median(p[1] for p in w), statistics.median(p[2] for p in w))
            if max(math.hypot(p[1] - c[0], p[2] - c[1]) for p in w) <= radius and sum(math.hypot(q[1] - p[1], q[2] - p[2]) for p, q in zip(w, w[1:])) <= path:
                lock = (b, b + window - 1, c)
                break
        if lock is None:
            break
        b, e, c = lock
        while e + 1 < len(pts) and math.hypot(pts[e + 1][1] - c[0], pts[e + 1][2] - c[1]) <= extend and math.hypot(pts[e + 1][1] - pts[e][1], pts[e + 1][2] - pts[e][2]) <= step:
            e += 1
        out |= {p[0] for p in pts[b : e + 1]}
        scan, locks = e + 1, locks + 1
    return out


@pytest.mark.parametrize("kind", ["mixed", "raw_model", "prediction"])
def test_static_locks(spark, kind):
    rnd = random.Random(6)
    pts, x, y = [], 400.0, 400.0
    for f in range(400):
        still = (f // 40) % 2 == 0
        x, y = x + rnd.uniform(-1.5, 1.5) * (1 if still else 20), y + rnd.uniform(-1.5, 1.5) * (1 if still else 20)
        pts.append((f if f < 250 else f + 7, x, y))
    df = spark.createDataFrame([(1, *p) for p in pts], "match_id long, frame long, x double, y double")
    want = brute_locks(pts[:250], **kernels.LOCKS[kind]) | brute_locks(pts[250:], **kernels.LOCKS[kind])
    assert {r.frame for r in kernels.static_locks(df, kind).collect()} == want and want


def test_tracker_follows_two_balls(spark):
    rows = []
    for f in range(40):
        if f not in (10, 11, 12, 13):
            rows += [(1, f, 2 * f, 100.0 + 10 * f, 200.0, 2.0, 20.0), (1, f, 2 * f + 1, 900.0 - 9 * f, 500.0 + 3 * f, 1.5, 30.0)]
    df = spark.createDataFrame(rows, "match_id long, frame long, cand_id long, x double, y double, quality double, area double")
    t = kernels.greedy_tracks(df)
    by = {}
    for r in t.collect():
        by.setdefault((r.run, r.track), []).append((r.frame, r.cand_id % 2))
    assert len(by) == 4 and all(len({k for _, k in v}) == 1 for v in by.values())
    pts = t.join(df, ["match_id", "frame", "cand_id"])
    m = tracklets.plausible(tracklets.measures(pts))
    assert m.count() == 4 and {r.n for r in m.collect()} == {10, 26}
    assert tracklets.span_suppression(m).count() == 2
    assert tracklets.trim_abrupt(pts).count() == pts.count()


def test_clusters_merge_near_candidates(spark):
    df = spark.createDataFrame([(1, 0, 1, 100.0, 100.0, 3.0), (1, 0, 2, 120.0, 100.0, 1.0), (1, 0, 3, 500.0, 100.0, 2.0)], "match_id long, frame long, cand_id long, x double, y double, quality double")
    got = sorted((round(r.x, 3), r.n) for r in tracklets.clusters(df).collect())
    assert got == [(105.0, 2), (500.0, 1)]


def test_identity_is_held(spark):
    rows = [(1, f, 1, 3.0, -4.0) for f in range(10)] + [(1, f, 2, 1.0, -6.0) for f in range(5, 10)] + [(1, f, 9, 3.0, 5.0) for f in range(10)]
    df = spark.createDataFrame(rows, "match_id long, frame long, det_id long, mx double, my double")
    got = kernels.player_identity(df).collect()
    assert {r.det_id for r in got if r.side == "far"} == {1} and {r.det_id for r in got if r.side == "near"} == {9}


def test_selector_follows_the_ball_not_the_decoy(spark):
    rows = [(1, f, 2 * f, 100.0 + 8 * f, 300.0, 1.9, 1, 0) for f in range(40) if f not in (15, 16)] + [(1, f, 2 * f + 1, 900.0, 700.0, 1.35, 1, 0) for f in range(40)]
    df = spark.createDataFrame(rows, "match_id long, frame long, cand_id long, x double, y double, quality double, count long, persistence long")
    got = {r.frame: r for r in kernels.selected_track(df).collect()}
    assert all(got[f].cand_id == 2 * f for f in range(40) if f not in (15, 16)) and abs(got[39].x - 412) < 30


def test_extension_both_ways_and_stitching(spark):
    ball = [(1, f, f, 100.0 + 8 * f, 400.0 - 6 * f + 0.1 * f * f, 1.5) for f in range(60)]
    cands = spark.createDataFrame(ball + [(1, f, 1000 + f, 900.0, 100.0, 2.0) for f in range(60)], "match_id long, frame long, cand_id long, x double, y double, quality double")
    pts = cands.where("cand_id between 20 and 30").withColumns({"run": F.lit(0).cast("long"), "track": F.lit(0).cast("long")})
    ahead = {r.frame for r in kernels.extensions(pts, cands).collect()}
    back = {r.frame for r in kernels.extensions(pts, cands, forward=False).collect()}
    assert ahead == set(range(31, 60)) and back == set(range(0, 20))
    holes = cands.where("frame not between 35 and 39")
    assert {r.frame for r in kernels.extensions(pts, holes).collect()} == set(range(31, 35))
    other = cands.where("cand_id between 36 and 50").withColumns({"run": F.lit(0).cast("long"), "track": F.lit(1).cast("long")})
    assert [(r.track, r.next_track, r.gap) for r in tracklets.stitched(pts.unionByName(other)).collect()] == [(0, 1, 6)]


def test_split_hits_find_the_turn_of_a_flight(spark):
    pts = [(1, f, 100.0 + 9 * f, 500.0 - 8 * f + 0.1 * f * f) for f in range(40)]
    x, y = pts[-1][2:]
    pts += [(1, 40 + f, x - 10 * (f + 1), y + 7 * (f + 1) - 0.05 * f * f) for f in range(40)]
    pts += [(2, f, 100.0 + 9 * f, 500.0 - 20 * f + 0.5 * f * f) for f in range(40)]  # an apex is no turn
    df = spark.createDataFrame(pts, "match_id long, frame long, x double, y double")
    got = kernels.split_hits(df).collect()
    assert len(got) == 1 and got[0].match_id == 1 and abs(got[0].frame - 39) <= 1 and 0.72 <= got[0].score <= 0.96


def test_parabola_equals_numpy():
    rnd = np.random.default_rng(2)
    p = [(float(f), float(a), float(b)) for f, a, b in zip(range(20, 33), rnd.normal(0, 9, 13), rnd.normal(0, 9, 13))]
    e, vx, vy = kernels.parabola(p, 26.0)
    t = np.array([q[0] - 26 for q in p])
    fits = [np.polyfit(t, [q[i] for q in p], 2) for i in (1, 2)]
    assert math.isclose(vx, fits[0][1], abs_tol=1e-9) and math.isclose(vy, fits[1][1], abs_tol=1e-9)
    assert math.isclose(e, sum(((np.polyval(k, t) - [q[i] for q in p]) ** 2).sum() for i, k in ((1, fits[0]), (2, fits[1]))), rel_tol=1e-9)


def test_every_segment_of_a_trail_gets_its_spline(spark, monkeypatch):
    from courtlane.plans import ref_shots

    rnd = random.Random(3)
    pts = {f: (rnd.uniform(0, 1000), rnd.uniform(0, 700)) for f in [*range(3, 60), 70, *range(80, 82)]}
    t = spark.createDataFrame([(1, f, True, *p) for f, p in pts.items()] + [(1, 65, False, None, None)], "match_id long, frame long, vis boolean, x double, y double")
    monkeypatch.setattr(ref_shots, "track", lambda *_: t)
    want = {}
    for trail in (list(range(3, 60)), [70], [80, 81]):
        ends = [trail[0], *trail, trail[-1]]
        for i in range(1, len(ends) - 2):
            p0, p1, p2, p3 = (np.array(pts[ends[k]]) for k in range(i - 1, i + 3))
            for k, s in enumerate(np.linspace(0, 1, 12, endpoint=False)):
                want[ends[i], k] = tuple(0.5 * (2 * p1 + (p2 - p0) * s + (2 * p0 - 5 * p1 + 4 * p2 - p3) * s**2 + (3 * p1 - p0 - 3 * p2 + p3) * s**3))
        want[trail[-1], 0] = pts[trail[-1]]
    got = {(r.frame, r.step): (r.x, r.y) for r in ref_shots.b30_catmull_rom(spark, "").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def brute_centres(by_frame, n, window=12, disp=36.0):
    merged = []
    for f in range(n):
        cl = []
        for x, y, s in by_frame.get(f, []):
            far = [math.hypot(x - c[0], y - c[1]) for c in cl]
            if far and min(far) < 45.0:
                c, w = cl[far.index(min(far))], max(0.01, s - 0.05)
                o = max(0.01, c[2] - 0.05)
                c[:] = [(c[0] * o + x * w) / (o + w), (c[1] * o + y * w) / (o + w), c[2] + s]
            else:
                cl.append([x, y, s])
        merged.append(cl)
    out = [[] for _ in range(n)]
    for start in range(n - window + 1):
        for bx, by, _ in merged[start]:
            pts = [(bx, by)]
            for f in range(start + 1, start + window):
                near = [(math.hypot(x - bx, y - by), x, y) for x, y, _ in merged[f] if math.hypot(x - bx, y - by) <= disp]
                pts += [min(near, key=lambda p: p[0])[1:]] if near else []
            m = np.median(np.array(pts), axis=0)
            if len(pts) == window and max(math.hypot(x - m[0], y - m[1]) for x, y in pts) <= disp:
                for f in range(start, start + window):
                    if not any(math.hypot(x - m[0], y - m[1]) <= disp * 0.5 for x, y in out[f]):
                        out[f].append((m[0], m[1]))
                break
    return sorted((f, round(float(x), 6), round(float(y), 6)) for f, o in enumerate(out) for x, y in o)


@pytest.mark.parametrize("seed", [1, 2])
def test_static_centres_start_on_every_frame(spark, seed):
    rnd = random.Random(seed)
    by_frame = {}
    for f in range(120):
        spots = [(640 + rnd.gauss(0, 9), 300 + rnd.gauss(0, 9), 1.2)] if f in range(21, 57) or f in range(66, 77) else []  # 11 frames are too few
        spots += [(200 + f * 1.5, 150 + rnd.gauss(0, 12), 1.4)] if rnd.random() < 0.95 else []
        spots += [(rnd.uniform(0, 900), rnd.uniform(0, 500), rnd.uniform(0.5, 2)) for _ in range(3)]
        by_frame[f] = spots
    df = spark.createDataFrame([(1, f, k, *p) for f, ps in by_frame.items() for k, p in enumerate(ps)], "match_id long, frame long, cand_id long, x double, y double, quality double")
    got = sorted((r.frame, round(r.x, 6), round(r.y, 6)) for r in kernels.static_centres(df).collect())
    want = brute_centres(by_frame, 120)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose(got, want, atol=2e-6)
    assert len({f for f, x, _ in got if abs(x - 640) < 20}) > 24


def test_every_cutting_run_gets_its_manifest(spark, monkeypatch):
    import json

    from courtlane.plans import ref_sources

    rows = [(1, "cut-1", 1, 5, 10, 20, 3, "ok"), (1, "cut-2", 2, 6, 40, None, 1, None), (1, "cut-2", 1, 5, 11, 20, 3, "ok"), (1, "cut-2", 1, 5, 11, 20, 3, "ok"), (2, "cut-3", 1, 1, 0, 9, 2, "ok"), (2, None, None, 1, 0, 9, 2, "ok"), (None, "cut-1", 1, 1, 0, 9, 2, "ok")]
    t = spark.createDataFrame(rows, "match_id long, cut_run string, segment_index int, rally_id int, start_frame int, end_frame int, hit_count int, quality string")
    monkeypatch.setattr(ref_sources, "table", lambda *_: t)
    got = {(r.match_id, r.cut_run): (r.segments, [s.get("segment_index") for s in json.loads(r.manifest)["segments"]]) for r in ref_sources.a09_rally_manifest(spark, "").collect()}
    assert got == {(1, "cut-1"): (1, [1]), (1, "cut-2"): (2, [1, 2]), (2, "cut-3"): (1, [1]), (2, None): (1, [None])}


def test_the_classical_pipeline_extends_its_seeds(spark):
    from courtlane.operators import classical

    flight = lambda f: (100.0 + 8 * f, 400.0 - 6 * f + 0.1 * f * f)
    # a base flight whose ends are too weak to be tracked, and a short one along the top edge, above the base region
    ball = [(1, f, f, *flight(f), 1.3 if f < 10 or f > 29 else 1.8, 20.0) for f in range(4, 40) if f not in (9, 30, 31)]
    high = [(1, f, f, 300.0 + 9 * (f - 100), 20.0 + 0.05 * (f - 103) ** 2, 1.9, 20.0) for f in range(100, 107)]
    cands = spark.createDataFrame(ball + high, "match_id long, frame long, cand_id long, x double, y double, quality double, area double")
    tops = spark.createDataFrame([(1, 120.0, 0.0)], "match_id long, base_top double, wide_top double")
    weak = classical.options(rank=3.0, quality=1.5, acceleration=40.0, turn=60.0, edge_quality=1.5)  # the made-up candidates are weaker than real ones
    out = classical.pipeline(cands, tops, weak).collect()
    assert {r.track_id for r in out} == {0, 1} and len({r.frame for r in out}) == len(out)
    assert {r.frame for r in out if r.track_id == 1} == set(range(100, 107))  # none of them is in the base region
    assert {r.frame for r in out if r.track_id == 0} == {r[1] for r in ball}
    assert any(not r.core for r in out) and all(r.core for r in out if 10 <= r.frame <= 29)


def test_a_static_top_track_is_banned_for_good(spark):
    still = [(1, 1, f, 500.0 + f % 3, 100.0) for f in range(60)] + [(1, 1, f, 900.0 - f, 600.0) for f in range(60, 200)]
    late = [(1, 2, f, 500.0 + f, 100.0) for f in range(60)] + [(1, 2, f, 560.0, 100.0) for f in range(60, 200)]
    short = [(1, 3, f, 500.0, 100.0) for f in range(41)] + [(1, 4, f, 500.0, 300.0) for f in range(100)]
    df = spark.createDataFrame(still + late + short, "match_id long, track long, frame long, x double, y double")
    got = {}
    for r in kernels.banned_top_tracks(df, 160.0).collect():
        got.setdefault(r.track, set()).add(r.frame)
    # the second track's last 90 points span 30 px once they start at frame 30
    assert got == {1: set(range(41, 200)), 2: set(range(119, 200))}


def test_the_smoother_starts_anew_around_a_cut(spark):
    rows = [(1, f, True, 100.0 + 5 * f + (300.0 if f >= 30 else 0.0), 200.0, "model", 0.9, True) for f in range(60) if f not in (25, 26, 34, 35)]
    df = spark.createDataFrame(rows, "match_id long, frame long, vis boolean, x double, y double, source string, conf double, raw_vis boolean")
    cuts = spark.createDataFrame([(1, 30)], "match_id long, frame long")
    resets = kernels.reset_frames(cuts)
    assert {r.frame for r in resets.collect()} == set(range(27, 34))
    got = {r.frame: r for r in kernels.smooth(df, ("model",), resets=resets).collect()}
    assert all(got[f].x == x for _, f, _, x, *_ in rows if 27 <= f <= 33)  # every frame by the cut is a first one
    assert got[25].source == "kalman" and not got[34].vis and not got[35].vis  # no forecast after a start
    plain = {r.frame: r for r in kernels.smooth(df, ("model",)).collect()}
    assert any(plain[f].x != got[f].x or plain[f].vis != got[f].vis for f in range(27, 36))


def exchanges(plan):
    """Names of the nodes of an executed plan made without adaptive execution, with those above each: [(name, names above)]."""
    out, todo = [], [(plan, ())]
    while todo:
        node, above = todo.pop()
        name = node.nodeName()
        out.append((name, above))
        todo += [(node.children().apply(i), (*above, name)) for i in range(node.children().size())]
    return out


@pytest.fixture()
def planned(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: exchanges(df._jdf.queryExecution().executedPlan())
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("seed", [1, 2])
def test_extensions_in_one_pass_equal_those_by_pairs(spark, seed):
    rng, rows = random.Random(seed), []
    for match in (1, 2):
        frame, ends = 0, []
        for _ in range(260):
            frame += rng.choice([1] * 14 + [2, 3, 4, 5, 6, 7])
            wild = frame % 60 < 12  # here the flights are too weak to be tracked
            cands = [(frame * 4 + k, (100.0 + (7 + 5 * k) * (frame % 120) + rng.gauss(0, 1)), 300.0 + k * 90 - 3.0 * (frame % 60) + 0.05 * (frame % 60) ** 2, 1.3 if wild else 1.3 + rng.random(), 40.0) for k in range(3) if rng.random() < 0.85]
            rows += [(match, frame, cands)] if cands else []
    df = spark.createDataFrame(rows, "match_id long, frame long, c array<struct<cand_id:long,x:double,y:double,quality:double,area:double>>")
    grow = lambda f: f.withColumn("c", F.explode("c")).select(*[k for k in f.columns if k != "c"], "c.*")
    c = grow(df)
    points = kernels.greedy_tracks(c).join(c, ["match_id", "frame", "cand_id"])
    for forward in (True, False):
        want = sorted(tuple(r) for r in kernels.extensions(points, c, forward).collect())
        assert want and sorted(tuple(r) for r in kernels.tracked_extensions(df, grow, forward).collect()) == want


@pytest.mark.parametrize("name", ["f19c_forward_extensions", "f19d_backward_extensions"])
def test_extensions_shuffle_frames_once(planned, spark, sf, name):
    """One shuffle by block, its summary's two, one by run; no pairs of a track and a frame."""
    from courtlane.plans import ref_tracks

    plan = planned(getattr(ref_tracks, name)(spark, sf))
    assert sum(n == "Exchange" for n, _ in plan) <= 5 and sum(n == "SortMergeJoin" for n, _ in plan) <= 1


def test_where_a_flight_leads_equals_numpy():
    rng = random.Random(3)
    for n in range(3, 8):
        for _ in range(50):
            frames = sorted(rng.sample(range(-500_000, -499_985), n))
            pts = [(f, rng.uniform(0, 1920), rng.uniform(0, 1080)) for f in frames]
            for dt in range(1, 6):
                t = np.array(frames, dtype=float) - frames[-1]
                want = [np.polyval(np.polyfit(t, [p[i] for p in pts], 2 if n >= 5 else 1), dt) for i in (1, 2)]
                assert np.allclose(kernels.led(pts, dt), want, rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize("name", ["c19_hit_evidence", "c19_reject_counts", "e20_outgoing_direction"])
def test_rows_spread_over_frames_are_not_broadcast(planned, spark, sf, name):
    """Many times the rows that the planner takes them for, they would be gathered by the driver."""
    from courtlane.plans import reference

    plan = planned(reference.QUERIES[name](spark, sf))
    spread = [above for n, above in plan if n == "Generate"]
    assert spread and not any("BroadcastExchange" in above for above in spread)


def test_reject_counts_broadcast_only_the_ends_of_matches(planned, spark, sf):
    """Whatever the threshold: the driver gathers one row per match, never rows per hit, per impulse or per frame."""
    from courtlane.plans import reference

    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plan = planned(reference.QUERIES["c19_reject_counts"](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    sent = [n for n, _ in plan if n in ("BroadcastExchange", "BroadcastHashJoin", "BroadcastNestedLoopJoin")]
    assert sorted(sent) == ["BroadcastExchange", "BroadcastHashJoin"]


def test_reject_counts_broadcast_nothing_more_once_sizes_are_known(spark, sf):
    """The plan that ran: what adaptive execution finds to be small isn't turned into a broadcast, either."""
    from courtlane.plans import reference

    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = reference.QUERIES["c19_reject_counts"](spark, sf)
        assert df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "== Final Plan ==" in ran
    assert [ran.count(n) for n in ("BroadcastExchange", "BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin")] == [1, 1, 0, 4]
