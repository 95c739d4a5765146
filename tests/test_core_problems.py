"""The dealt core operators on small fixtures: nulls, ties, repeated rows, empty tables, clashing names, blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlane.operators import anomalies, intervals, sessions


def brute_sessions(events):
    out = []
    for entity in sorted({e for e, _, _ in events}):
        gap = next(g for e, _, g in events if e == entity)
        ticks = sorted({t for e, t, _ in events if e == entity})
        start = prev = ticks[0]
        n = 1
        for t in ticks[1:]:
            if t - prev > gap:
                out.append((entity, start, prev, n))
                start, n = t, 0
            prev, n = t, n + 1
        out.append((entity, start, prev, n))
    return sorted(out)


@pytest.mark.parametrize("gap", [1, 2, 5, 64, 150, 1000])
def test_sessions_equal_brute_force(spark, gap):
    rnd = random.Random(gap)
    events = [(e, rnd.randrange(-3000, 140_000) if rnd.random() < 0.5 else 65_536 + rnd.randrange(-2 * gap, 2 * gap), gap) for e in range(4) for _ in range(600)]
    events += [(7, t, gap) for t in range(0, 200_000, gap)]  # one session over several blocks
    df = spark.createDataFrame(events + events[:50], "match_id long, frame long, g long")
    got = sorted(tuple(r) for r in sessions.sessions(df, "match_id", "frame", "g").select("entity", "first", "last", "events").collect())
    assert got == brute_sessions(events)


def test_closing_joins_exactly_up_to_the_gap():
    for gap in range(1, 40):
        assert sessions.close_bitmap(1 | 1 << gap, gap) == (1 << gap + 1) - 1
        assert sessions.close_bitmap(1 | 1 << gap + 1, gap) == 1 | 1 << gap + 1


def test_rally_sessions_nulls_and_clashes(spark):
    side = spark.createDataFrame([(1, 10, 1), (1, 10, 1), (1, None, 1), (None, 5, 1), (1, 160, 1), (1, 311, 1), (1, 320, None), (1, 330, 0), (2, 7, 1)], "match_id long, frame int, hit int")
    side = side.withColumns({c: F.lit(1) for c in ("block", "entity", "fps", "gap", "__salt", "first")})
    info = spark.createDataFrame([(1, 30), (2, None)], "match_id long, fps int")
    got = sorted(tuple(r) for r in sessions.rally_sessions(side.drop("fps"), info).collect())
    assert got == [(1, 10, 160, 5.0, 2), (1, 311, 311, 0.0, 1), (2, 7, 7, 0.0, 1)]
    assert sessions.rally_sessions(side.drop("fps").limit(0), info).count() == 0


def brute_cover(iv):
    out = []
    for k in sorted({k for k, _, _ in iv}):
        covered = sorted({f for q, s, e in iv if q == k for f in range(s, e + 1)})
        start = prev = covered[0]
        for f in covered[1:]:
            if f != prev + 1:
                out += [(k, "period", start, prev), (k, "gap", prev + 1, f - 1)]
                start = f
            prev = f
        out.append((k, "period", start, prev))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_intervals_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(intervals, "BLOCK_BITS", 4)
    rnd = random.Random(seed)
    iv = [(k, s, s + rnd.randrange(0, 12)) for k in range(3) for s in [rnd.randrange(-50, 400) for _ in range(40)]]
    iv += [(3, 0, 200), (3, 10, 20), (3, 201, 201), (4, 5, 5)]
    bad = [(0, None, 3), (0, 3, None), (None, 1, 2), (0, 9, 8)]
    df = spark.createDataFrame(iv + iv[:10] + bad, "match_id long, start_frame int, end_frame int").withColumns({c: F.lit(0) for c in ("at", "d", "block", "s", "kind", "origin")})
    got = sorted(tuple(r) for r in intervals.covered_and_gaps(df, ["match_id"], "start_frame", "end_frame").collect())
    assert got == brute_cover(iv)
    assert intervals.covered_and_gaps(df.where("false"), ["match_id"], "start_frame", "end_frame").count() == 0


def flight(n=3000, seed=1):
    """A smooth flight of one source with small noise over frames around a block's edge."""
    rnd = np.random.default_rng(seed)
    t = np.arange(n)
    x, y = 600 + 300 * np.sin(t / 40) + rnd.normal(0, 1.5, n), 400 + 200 * np.cos(t / 55) + rnd.normal(0, 1.5, n)
    return [[1, int(f), 1, int(round(a)), int(round(b)), "model", "model", float(round(0.9 + 0.03 * c, 4))] for f, a, b, c in zip(t + 2600, x, y, np.clip(rnd.normal(0, 1, n), -2, 2))]


SIDE = "match_id long, frame int, visibility int, x int, y int, source string, rawsource string, confidence double"


def test_spikes_stuck_and_impossible_readings(spark):
    rows = flight()
    at = {r[1]: r for r in rows}
    at[3000][3] += 160  # a spike
    for f in (3300, 3301):
        at[f][3], at[f][4] = at[f][3] - 120, at[f][4] + 120  # two frames elsewhere
    at[3500][3] = -9999
    at[3600][7] = 1.4
    at[3700][7] = 0.05
    for f in range(4090, 4102):  # over a block's edge
        at[f][3], at[f][4] = at[4090][3], at[4090][4]
    for f in range(4300, 4310):
        at[f][7] = 0.91
    for f in range(4400, 4409):
        at[f][7] = 0.92  # nine only
    rows += [list(at[3000]), [1, None, 1, 1, 1, "model", "model", 0.9], [None, 5, 1, 1, 1, None, None, None], [1, 9000, 0, -5, -5, "missing", "missing", 0.0], [1, 9100, 1, None, None, None, None, None]]
    df = spark.createDataFrame([tuple(r) for r in rows], SIDE).withColumns({c: F.lit(0) for c in ("block", "home", "unit", "pair", "width", "sides")})
    info = spark.createDataFrame([(1, 30, 1280, 720)], "match_id long, fps int, width int, height int")
    got = {(r.frame, w) for r in anomalies.implausible_readings(df, info).collect() for w in r.reasons}
    frames = {f for f, _ in got}
    assert {3000, 3300, 3301} <= {f for f, w in got if w == "spike"}
    assert {(3500, "impossible"), (3600, "impossible"), (3700, "confidence")} <= got
    assert {f for f, w in got if w == "stuck_position"} == set(range(4090, 4102))
    assert {f for f, w in got if w == "stuck_confidence"} == set(range(4300, 4310))
    assert len(frames - {3000, 3300, 3301, 3500, 3600, 3700, *range(4088, 4104), *range(4300, 4310)}) <= 3
    assert anomalies.implausible_readings(df.limit(0), info).count() == 0


def test_a_source_that_never_varies_is_not_stuck(spark):
    rows = [(1, f, 1, 500 + f % 7, 1 + f % 3, "offscreen_bridge", "missing", 0.0) for f in range(400)]
    df = spark.createDataFrame(rows, SIDE)
    info = spark.createDataFrame([(1, 30, None, None)], "match_id long, fps int, width int, height int")
    assert not [r for r in anomalies.implausible_readings(df, info).collect() if "stuck_confidence" in r.reasons]


def test_tail_cut_ignores_the_spikes_it_should_cut():
    rnd = np.random.default_rng(3)
    v = np.sort(np.concatenate([rnd.exponential(1.0, 20_000), rnd.uniform(40, 60, 200)]))
    cut = anomalies.gpd_cut(v, np.ones(len(v)), 1e-6, 0.90, 0.95, 0.1)
    assert 10 < cut < 35


def test_a_salted_join_equals_a_broadcast_one(spark):
    from courtlane.session import join_small

    big = spark.range(1000).selectExpr("id % 3 as k", "id as v")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, w string")
    a, b = (sorted((r.k, r.v, r.w or "") for r in join_small(big, small, ["k"], rows=n).collect()) for n in (100, 1))
    assert a == b and len(a) == 1000


def test_limits_of_small_sources_lean_on_all_sources_without_a_jump(spark):
    rnd = np.random.default_rng(4)
    big = [("big", 2, float(v), float(round(0.8 + c, 3))) for v, c in zip(rnd.exponential(2.0, 6000), np.clip(rnd.normal(0, 0.03, 6000), -0.09, 0.09))]
    values, confs = rnd.exponential(4.0, 700), np.clip(rnd.normal(0, 0.02, 700), -0.06, 0.06)
    cuts = {}
    for n in (20, 150, 299, 300, 301, 599, 600, 601, 700):
        small = [("small", 2, float(v), float(round(0.4 + c, 3))) for v, c in zip(values[:n], confs[:n])]
        rows = [(s, sides, r, c, False, True, False, False, False, False) for s, sides, r, c in big + small]
        df = spark.createDataFrame(rows, "source string, sides int, residual double, confidence double, impossible boolean, linked boolean, same_xy boolean, same_conf boolean, stuck_xy boolean, stuck_conf boolean")
        cuts[n] = next(r for r in anomalies.source_limits(df).collect() if r.source == "small")
    for a, b in ((299, 300), (300, 301), (599, 600), (600, 601)):
        assert cuts[a].cut_two == pytest.approx(cuts[b].cut_two, rel=0.15) and cuts[a].conf_low == pytest.approx(cuts[b].conf_low, abs=0.01)
    assert all(15 < c.cut_two < 150 and 0.05 < c.conf_low < 0.36 and 0.44 < c.conf_high < 0.75 for c in cuts.values())
