"""Fusing detectors: phases with each other, the model with the classical detector, and filling of gaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlane.operators.sequence import anchors, at_offsets, runs, segments
from courtlane.session import staged


def _dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _bridge(l: str, r: str, x: Column, y: Column) -> Column:
    """Distance of a point from the line in time between two anchors (structs of frame, x, y)."""
    t = (F.col("frame") - F.col(f"{l}.frame")) / (F.col(f"{r}.frame") - F.col(f"{l}.frame"))
    return _dist(x, y, F.col(f"{l}.x") + t * (F.col(f"{r}.x") - F.col(f"{l}.x")), F.col(f"{l}.y") + t * (F.col(f"{r}.y") - F.col(f"{l}.y")))


def merge_phases(phases: DataFrame, agree: float = 25, reach: int = 6, limit: float = 110, decisive: float = 15) -> DataFrame:
    """One observation per frame from two phases: match_id, frame, vis, x, y, label, choice (agree, primary, secondary, none).

    Where both see the ball within ``agree`` px the primary stands. Elsewhere the frames of a run decide together, by their mean distance from the
    bridge between the agreements on either side, each at most ``reach`` frames away: of two candidates the one that is better by
    ``decisive`` px and within ``limit``; a single candidate within 1.5 times the limit. Without a bridge a single candidate stays and two that
    conflict are both dropped. A single phase's points get the label single_phase_edge at confidence 0.22 or less, the others model_edge at 0.35 or less.
    """
    gap = _dist(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    p = phases.withColumn("same", F.coalesce(F.col("a_vis") & F.col("b_vis") & (gap <= agree), F.lit(False)))
    at = F.when(F.col("same"), F.struct("frame", F.col("a_x").alias("x"), F.col("a_y").alias("y")))
    open_ = anchors(p, before={"l": at}, after={"r": at}).where(~F.col("same") & (F.col("a_vis") | F.col("b_vis")))
    open_ = staged(runs(open_, F.lit(True)), "open")
    bridged = (F.col("frame") - F.col("l.frame") <= reach) & (F.col("r.frame") - F.col("frame") <= reach)
    off = lambda s: F.when(bridged & F.col(f"{s}_vis"), _bridge("l", "r", F.col(f"{s}_x"), F.col(f"{s}_y")))
    mean = open_.groupBy("match_id", "run").agg(F.avg(off("a")).alias("ra"), F.avg(off("b")).alias("rb"))
    j = open_.join(mean, ["match_id", "run"])
    both = F.col("a_vis") & F.col("b_vis")
    choice = (
        F.when(both, F.when(F.col("ra").isNull() | F.col("rb").isNull(), "none").when((F.col("ra") + decisive <= F.col("rb")) & (F.col("ra") <= limit), "primary").when((F.col("rb") + decisive <= F.col("ra")) & (F.col("rb") <= limit), "secondary").otherwise("none"))
        .when(F.col("a_vis"), F.when(F.coalesce(F.col("ra") <= 1.5 * limit, F.lit(True)), "primary").otherwise("none"))
        .otherwise(F.when(F.coalesce(F.col("rb") <= 1.5 * limit, F.lit(True)), "secondary").otherwise("none"))
    )
    rest = j.select("match_id", "frame", choice.alias("choice"))
    out = p.join(rest, ["match_id", "frame"], "left").withColumn("choice", F.when(F.col("same"), "agree").otherwise(F.coalesce("choice", F.lit("none"))))
    first, second = F.col("choice").isin("agree", "primary"), F.col("choice") == "secondary"
    conf = F.when(first, F.col("a_conf")).when(second, F.col("b_conf"))
    label = F.when(F.col("choice") == "none", "missing").when((F.col("choice") != "agree") & (conf <= 0.22), "single_phase_edge").when(conf <= 0.35, "model_edge").otherwise(F.when(first, F.col("a_source")).otherwise(F.col("b_source")))
    return out.select("match_id", "frame", (first | second).alias("vis"), F.when(first, F.col("a_x")).when(second, F.col("b_x")).alias("x"), F.when(first, F.col("a_y")).when(second, F.col("b_y")).alias("y"), label.alias("label"), "choice")


def merge_classical(both: DataFrame, agree: float = 20, good: float = 28, bad: float = 60, times: float = 4) -> DataFrame:
    """Model (a_) and classical (b_) observations side by side: the model stands unless it misses, or conflicts and is at least max(``bad``, ``times`` the classical residual)
    off the bridge between agreements where the classical point is at most ``good`` off: match_id, frame, x, y, chosen."""
    gap = _dist(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    p = both.withColumn("same", F.coalesce(F.col("a_vis") & F.col("b_vis") & (gap <= agree), F.lit(False)))
    at = F.when(F.col("same"), F.struct("frame", F.col("a_x").alias("x"), F.col("a_y").alias("y")))
    p = anchors(p, before={"l": at}, after={"r": at})
    rm, rc = _bridge("l", "r", F.col("a_x"), F.col("a_y")), _bridge("l", "r", F.col("b_x"), F.col("b_y"))
    swap = F.coalesce((rc <= good) & (rm >= F.greatest(F.lit(bad), times * rc)), F.lit(False))
    chosen = F.when(F.col("a_vis") & F.col("b_vis") & ~F.col("same") & swap, "classical").when(F.col("a_vis"), "model").when(F.col("b_vis"), "classical").otherwise("missing")
    p = p.withColumn("chosen", chosen)
    return p.select("match_id", "frame", F.when(F.col("chosen") == "model", F.col("a_x")).when(F.col("chosen") == "classical", F.col("b_x")).alias("x"), F.when(F.col("chosen") == "model", F.col("a_y")).when(F.col("chosen") == "classical", F.col("b_y")).alias("y"), "chosen")


def fill_gaps(track: DataFrame, classical: DataFrame, cut: Callable[[Column], Column] | None = None, longest: int = 12, support: int = 3, least_conf: float = 0.45, off: float = 72, step: float = 180) -> DataFrame:
    """Classical points (match_id, frame, x, y, conf, track_id) that fill holes of the track of at most ``longest`` frames: match_id, frame, x, y, conf, track_id.

    The hole's edges must come from the model and not be parted from it by a camera cut (``cut`` tells whether a frame is one). Only classical points of confidence ``least_conf`` or more
    count, of tracks with ``support`` of them; a point may be ``off`` px from the bridge over the hole, and ``step`` px a frame from either edge. Coordinates lose their fraction, the
    confidence is min(0.45, 0.65 c). A frame without a row is a hole as well; a negative or null track_id supports nothing.
    """
    at = F.when(F.col("vis"), F.struct("frame", "x", "y", "source"))
    good = classical.where((F.col("conf") >= least_conf) & (F.col("track_id") >= 0) & F.col("x").isNotNull() & F.col("y").isNotNull())
    strong = good.groupBy("match_id", "track_id").agg(F.count_distinct("frame").alias("n")).where(F.col("n") >= support)
    good = good.join(strong, ["match_id", "track_id"], "left_semi").groupBy("match_id", "frame").agg(F.max(F.struct("conf", "x", "y", "track_id")).alias("c"))
    both = track.select("match_id", "frame", "vis", "x", "y", "source").join(good, ["match_id", "frame"], "full_outer").withColumn("vis", F.coalesce("vis", F.lit(False)))
    t = anchors(both, before={"l": at}, after={"r": at}).where("not vis and c is not null")
    ok = (F.col("r.frame") - F.col("l.frame") - 1 <= longest) & (F.col("l.source") == "model") & (F.col("r.source") == "model")
    if cut is not None:
        ok = ok & ~cut(F.col("l.frame") + 1) & ~cut(F.col("r.frame"))
    reach = lambda e: _dist(F.col("c.x"), F.col("c.y"), F.col(f"{e}.x"), F.col(f"{e}.y")) / F.abs(F.col("frame") - F.col(f"{e}.frame"))
    ok = ok & (_bridge("l", "r", F.col("c.x"), F.col("c.y")) <= off) & (reach("l") <= step) & (reach("r") <= step)
    whole = lambda c: F.col(f"c.{c}").cast("long").cast("double").alias(c)
    return t.where(ok).select("match_id", "frame", whole("x"), whole("y"), F.least(F.lit(0.45), 0.65 * F.col("c.conf")).alias("conf"), F.col("c.track_id").alias("track_id"))


def interpolate(track: DataFrame, longest: int = 8, breaks: DataFrame | None = None) -> DataFrame:
    """Frames of holes of at most ``longest`` frames between visible points, with or without a row, on the line between them: match_id, frame, x, y. A hole that holds a frame of ``breaks``
    (match_id, frame), or ends at one, stays open."""
    v = anchors(track.where("vis").select("match_id", "frame", "x", "y"), before={"l": F.struct("frame", "x", "y")})
    v = v.where((F.col("frame") - F.col("l.frame") - 1).between(1, longest)).select("match_id", "l", F.struct("frame", "x", "y").alias("r"))
    if breaks is not None:
        inner = v.select("match_id", F.col("r.frame").alias("end"), F.explode(F.sequence(F.col("l.frame") + 1, F.col("r.frame"))).alias("frame"))
        broken = inner.join(breaks.select("match_id", "frame"), ["match_id", "frame"], "left_semi").select("match_id", "end").distinct()
        v = v.withColumn("end", F.col("r.frame")).join(broken, ["match_id", "end"], "left_anti").drop("end")
    t = v.withColumn("frame", F.explode(F.sequence(F.col("l.frame") + 1, F.col("r.frame") - 1)))
    s = (F.col("frame") - F.col("l.frame")) / (F.col("r.frame") - F.col("l.frame"))
    return t.select("match_id", "frame", *[(F.col(f"l.{c}") + s * (F.col(f"r.{c}") - F.col(f"l.{c}"))).alias(c) for c in "xy"])


def edge_breaks(track: DataFrame, top: float = 35, longest: int = 8) -> DataFrame:
    """Holes that end a flight instead of hiding it: match_id, start_frame, end_frame. A hole of 2 to ``longest`` frames breaks if one side is at the top and the other 70 px
    away in y, or both sides are at the top, or they are 80 px apart in y; a hole of one frame only by the last rule."""
    v = track.where("vis").select("match_id", "frame", "y")
    v = anchors(v, before={"l": F.struct("frame", "y")})
    hole, dy = F.col("frame") - F.col("l.frame") - 1, F.abs(F.col("y") - F.col("l.y"))
    a, b = F.col("l.y") <= top, F.col("y") <= top
    return v.where((hole.between(2, longest) & (((a | b) & (dy >= 70)) | (a & b) | (dy >= 80))) | ((hole == 1) & (dy >= 80))).select("match_id", (F.col("l.frame") + 1).alias("start_frame"), (F.col("frame") - 1).alias("end_frame"))


def longest_gap(track: DataFrame, cut: Column) -> DataFrame:
    """Longest hole between visible points of one camera segment: match_id, longest_gap."""
    t = segments(track.select("match_id", "frame", "vis"), cut)
    v = anchors(t.where("vis"), before={"l": F.struct("frame", "segment")})
    hole = F.when(F.col("l.segment") == F.col("segment"), F.col("frame") - F.col("l.frame") - 1).otherwise(0)
    return v.groupBy("match_id").agg(F.max(hole).alias("longest_gap"))


def derivatives(track: DataFrame, cut: Column, sources: tuple[str, ...]) -> DataFrame:
    """Speed, curvature |v1 - v0| and reversal max(0, -cos) per frame of measured points whose two neighbours lie in the same camera segment; a hole of one
    frame is filled with the middle. match_id, frame, segment, x, y, measured, speed, curvature, reversal; zeros where they aren't defined."""
    t = segments(track.select("match_id", "frame", "vis", "x", "y", "source"), cut)
    ok = F.col("vis") & F.col("source").isin(*sources)
    t = t.select("match_id", "frame", "segment", ok.alias("measured"), *[F.when(ok, F.col(c)).alias(c) for c in "xy"])
    t = at_offsets(t, ["x", "y", "segment"], [-1, 1])
    inner = (F.col("segment_m1") == F.col("segment")) & (F.col("segment_p1") == F.col("segment"))
    t = t.select("match_id", "frame", "segment", "measured", *[F.coalesce(F.col(c), F.when(inner, (F.col(f"{c}_m1") + F.col(f"{c}_p1")) / 2)).alias(c) for c in "xy"])
    t = at_offsets(t, ["x", "y", "segment"], [-1, 1])
    inner = (F.col("segment_m1") == F.col("segment")) & (F.col("segment_p1") == F.col("segment"))
    v = {f"{n}{c}": (F.col(c) - F.col(f"{c}_m1")) if n == "a" else (F.col(f"{c}_p1") - F.col(c)) for n in "ab" for c in "xy"}
    t = t.withColumns(v)
    s0, s1 = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2), F.sqrt(F.col("bx") ** 2 + F.col("by") ** 2)
    or0 = lambda e: F.coalesce(F.when(inner, e), F.lit(0.0))
    turn = F.when((s0 > 1e-3) & (s1 > 1e-3), F.greatest(F.lit(0.0), -(F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")) / (s0 * s1))).otherwise(0.0)
    known = F.col("ax").isNotNull() & F.col("bx").isNotNull()
    return t.select("match_id", "frame", "segment", "measured", "x", "y", or0((s0 + s1) / 2).alias("speed"), or0(F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)).alias("curvature"), or0(F.when(known, turn)).alias("reversal"))
