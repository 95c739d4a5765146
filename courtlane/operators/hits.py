"""Hit candidates, their evidence, rallies, and who hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlane.operators.sequence import anchors, at_offsets, percentiles_by
from courtlane.session import join_small, staged

#: What a hit's source adds to its score where hits of several sources meet.
SOURCE_BONUS = {"top_edge_exit": 0.25, "piecewise": 0.18, "curvature": 0.12, "endpoint": 0.04}


def hit_candidates(deriv: DataFrame, least_speed: float = 7.0, least_curvature: float = 10.0) -> DataFrame:
    """Sharp turns of the measured flight: match_id, frame, segment, x, y, speed, score.

    Thresholds per match: curvature max(10, P78 of the turns at ``least_speed`` or more), speed max(``least_speed``, 0.7 P35). A turn must reach 72 % of the largest
    one within two frames of its segment.
    """
    deriv = staged(deriv, "derivatives")
    curv = percentiles_by(deriv, ["match_id"], F.when((F.col("curvature") > 0) & (F.col("speed") >= least_speed), F.col("curvature")), {"c78": 0.78}, 4.0)
    slow = percentiles_by(deriv, ["match_id"], F.when(F.col("speed") > 0, F.col("speed")), {"s35": 0.35}, 4.0)
    d = at_offsets(deriv, ["curvature", "segment", "speed"], [-2, -1, 1, 2])
    d = join_small(join_small(d, curv, ["match_id"], "inner"), slow, ["match_id"], "left")
    local = F.greatest("curvature", *[F.when(F.col(f"segment_{k}") == F.col("segment"), F.col(f"curvature_{k}")) for k in ("m2", "m1", "p1", "p2")])
    c, s = F.greatest(F.lit(least_curvature), F.col("c78")), F.greatest(F.lit(least_speed), 0.7 * F.coalesce("s35", F.lit(0.0)))
    ok = F.col("measured") & (F.col("speed") >= s) & (F.col("curvature") >= F.greatest(c, 0.72 * local)) & F.col("segment_m2").isNotNull() & F.col("segment_p2").isNotNull()
    change = F.abs(F.coalesce("speed_p1", F.lit(0.0)) - F.coalesce("speed_m1", F.lit(0.0))) / F.greatest("speed", F.lit(1.0))
    score = 0.55 * F.least(F.lit(1.0), F.col("curvature") / F.greatest(c, F.lit(1.0))) + 0.30 * F.col("reversal") + 0.15 * F.least(F.lit(1.0), change)
    return d.where(ok).select("match_id", "frame", "segment", "x", "y", "speed", score.alias("score"))


def edge_exits(track: DataFrame, real: tuple[str, ...], edge: tuple[str, ...], incoming: float = 4.0, outgoing: float = 10.0) -> DataFrame:
    """Contacts after which the ball leaves over the top: three real points that fall by ``incoming`` px a frame, then two edge points that rise by ``outgoing``: match_id, frame, x, y, score, speed."""
    t = track.select("match_id", "frame", F.when(F.col("vis") & F.col("source").isin(*real), F.col("y")).alias("ry"), F.when(F.col("vis") & F.col("source").isin(*edge), F.col("y")).alias("ey"), "x")
    t = at_offsets(t, ["ry", "ey"], [-2, -1, 1, 2])
    i1, i2, o1, o2 = F.col("ry") - F.col("ry_m1"), F.col("ry_m1") - F.col("ry_m2"), F.col("ey_p1") - F.col("ry"), F.col("ey_p2") - F.col("ey_p1")
    vin, vout = (i1 + i2) / 2, -(o1 + o2) / 2
    score = F.least(F.lit(0.96), F.greatest(F.lit(0.72), 0.72 + 0.012 * F.least(F.lit(15.0), vin) + 0.010 * F.least(F.lit(18.0), vout)))
    return t.where((i1 >= incoming) & (i2 >= incoming) & (o1 <= -outgoing) & (o2 <= -outgoing)).select("match_id", "frame", "x", F.col("ry").alias("y"), score.alias("score"), F.greatest(vin, vout).alias("speed"))


def evidence(hits: DataFrame, track: DataFrame, impulses: DataFrame, boxes: DataFrame, audio: int = 6, reach: int = 10, near: float = 45, margin: float = 8, most_off: float = 90, least: int = 2) -> DataFrame:
    """Each hit with its first reason to be rejected (accepted where none) and whether the ball was seen on its very frame: hit_id, match_id, frame, reason, ball_observed.

    The limits are those of the function; the command line takes 8 frames of audio and 18 of track. Only the track's rows within ``reach`` frames of a hit are met, by an equi join on the
    frames that each hit can see, whose rows the planner takes for as few as the hits, hence the hints: none of these sides may be broadcast. A frame beyond the match's last, or a hit without
    a position, is invalid.
    """
    real = F.col("vis") & F.col("source").isin("model", "classical")
    at = F.struct("frame", "x", "y")
    t = track.select("match_id", "frame", "x", "y", "source", real.alias("real"))
    stop = track.groupBy("match_id").agg(F.max("frame").alias("stop"))
    asked = hits.select("hit_id", "match_id", F.col("frame").alias("hf"), F.explode(F.sequence(F.col("frame") - reach, F.col("frame") + reach)).alias("frame"))
    seen = asked.hint("merge").join(t, ["match_id", "frame"]).groupBy("hit_id").agg(
        F.count_if("real").alias("n"), F.max(F.when(F.col("real") & (F.col("frame") < F.col("hf")), at)).alias("l"), F.min(F.when(F.col("real") & (F.col("frame") > F.col("hf")), at)).alias("r"),
        F.max(F.when(F.col("real") & (F.col("frame") == F.col("hf")), at)).alias("o"), F.max(F.when(F.col("frame") == F.col("hf"), F.col("source"))).alias("tsource"),
    )
    heard = impulses.select("match_id", F.explode(F.sequence(F.col("frame") - audio, F.col("frame") + audio)).alias("frame")).distinct().withColumn("heard", F.lit(True))
    box = boxes.groupBy("match_id", "frame").agg(F.collect_list(F.struct("b0", "b1", "b2", "b3", F.col("kp")[9].alias("w1"), F.col("kp")[10].alias("w2"))).alias("boxes"))
    h = join_small(hits, stop, ["match_id"]).join(seen.hint("merge"), "hit_id", "left").join(heard.hint("merge"), ["match_id", "frame"], "left").join(box.hint("merge"), ["match_id", "frame"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    inside = F.exists("boxes", lambda b: F.col("x").between(b["b0"] - margin, b["b2"] + margin) & F.col("y").between(b["b1"] - margin, b["b3"] + margin))
    touch = F.exists("boxes", lambda b: F.least(*[F.sqrt((F.col("x") - b[w]["x"]) ** 2 + (F.col("y") - b[w]["y"]) ** 2) for w in ("w1", "w2")]) <= near)
    a = (F.col("frame") - F.col("l.frame")) / (F.col("r.frame") - F.col("l.frame"))
    two = F.col("l").isNotNull() & F.col("r").isNotNull()
    est = lambda c: F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).when(two, F.col(f"l.{c}") * (1 - a) + F.col(f"r.{c}") * a).otherwise(F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")))
    off = F.sqrt((F.col("x") - est("x")) ** 2 + (F.col("y") - est("y")) ** 2)
    reason = (
        F.when(F.col("source") == "audio_pose", "pose_only")
        .when((F.col("frame") < 0) | F.coalesce(F.col("frame") > F.col("stop"), F.lit(True)) | F.col("x").isNull() | F.col("y").isNull(), "invalid_frame_or_position")
        .when(F.col("tsource").isin("model_edge", "single_phase_edge", "classical_gap", "offscreen_bridge"), "edge_or_derived_event")
        .when(F.coalesce(inside & ~touch, F.lit(False)), "player_overlap")
        .when(F.col("heard").isNull(), "missing_audio")
        .when(F.col("n") < least, "insufficient_real_points")
        .when(F.col("source").isin("curvature", "piecewise", "classical_piecewise") & (~two | (F.col("n") < max(3, least))), "missing_bidirectional_trajectory")
        .when(off > most_off, "trajectory_position_mismatch")
        .otherwise("accepted")
    )
    return h.select("hit_id", "match_id", "frame", reason.alias("reason"), ((reason == "accepted") & F.col("o").isNotNull()).alias("ball_observed"))


def uncertainty(hits: DataFrame, track: DataFrame, impulses: DataFrame, tolerance: int = 3, least_score: float = 0.72) -> DataFrame:
    """hit_id and uncertain: set before, from audio alone, an endpoint, off the model, or of a low score without an impulse within ``tolerance`` frames of a model point."""
    t = track.select("match_id", "frame", F.col("source").alias("tsource"), "vis")
    heard = impulses.select("match_id", F.explode(F.sequence(F.col("frame") - tolerance, F.col("frame") + tolerance)).alias("frame")).distinct().withColumn("heard", F.lit(True))
    h = hits.join(t, ["match_id", "frame"], "left").join(heard, ["match_id", "frame"], "left")
    confirmed = F.coalesce(F.col("vis") & (F.col("tsource") == "model") & F.col("heard"), F.lit(False))
    u = F.coalesce(F.col("uncertain"), F.lit(False)) | F.col("source").startswith("audio_") | F.coalesce(F.col("tsource") != "model", F.lit(True)) | (F.col("source") == "endpoint") | (F.coalesce(F.col("score"), F.lit(0.0)) < least_score) & ~confirmed
    return h.select("hit_id", u.alias("uncertain"))


def ball_at_hits(hits: DataFrame, track: DataFrame, reach: int = 18) -> DataFrame:
    """The ball where it was at a hit: on the frame if measured, else on the line between the nearest measured points on both sides, else the nearest: hit_id, bx, by, observed."""
    ok = F.col("vis") & F.col("source").isin("model", "classical", "interp")
    at = F.when(ok, F.struct("frame", "x", "y"))
    t = track.select("match_id", "frame", "x", "y", "vis", "source", "raw_vis").join(hits.select("match_id", "frame").distinct().withColumn("asked", F.lit(True)), ["match_id", "frame"], "full_outer")
    t = anchors(t, before={"l": at}, after={"r": at}).where("asked").withColumn("on", F.coalesce(ok, F.lit(False)))
    t = t.withColumns({"l": F.when(F.col("frame") - F.col("l.frame") <= reach, F.col("l")), "r": F.when(F.col("r.frame") - F.col("frame") <= reach, F.col("r"))})
    a = (F.col("frame") - F.col("l.frame")) / (F.col("r.frame") - F.col("l.frame"))
    pick = lambda c: F.when(F.col("on"), F.col(c)).when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.col(f"l.{c}") * (1 - a) + F.col(f"r.{c}") * a).otherwise(F.coalesce(f"l.{c}", f"r.{c}"))
    t = t.select("match_id", "frame", pick("x").alias("bx"), pick("y").alias("by"), (F.col("on") & F.coalesce("raw_vis", F.lit(False))).alias("observed"))
    return hits.select("hit_id", "match_id", "frame").join(t, ["match_id", "frame"]).where("bx is not null").select("hit_id", "bx", "by", "observed")


def lone_supplements(visual: DataFrame, audio: DataFrame, reach: int = 3, least: float = 0.63) -> DataFrame:
    """Sides that a pose contact hands to a visual hit of unknown hitter, if exactly one visual hit lies within ``reach`` frames of it: hit_id, hitter, hitter_confidence.

    A range join by (match, frame): each supplement is spread over the frames it can reach.
    """
    a = audio.where(F.col("hitter").isin("near", "far") & (F.col("hitter_source") == "pose_contact") & (F.col("hitter_confidence") >= least)).select("match_id", F.col("hit_id").alias("aid"), F.col("frame").alias("af"), F.col("hitter").alias("side"), F.col("hitter_confidence").alias("conf"))
    a = a.withColumn("frame", F.explode(F.sequence(F.col("af") - reach, F.col("af") + reach)))
    j = a.join(visual.select("match_id", "frame", "hit_id", "hitter"), ["match_id", "frame"])
    one = j.groupBy("match_id", "aid").agg(F.count("*").alias("n"), F.first("hit_id").alias("hit_id"), F.first("hitter").alias("was"), F.first("side").alias("hitter"), F.first("conf").alias("hitter_confidence"), F.first("af").alias("af")).where("n = 1 and was = 'unknown'")
    w = Window.partitionBy("hit_id").orderBy("af", "aid")
    return one.withColumn("k", F.row_number().over(w)).where("k = 1").select("hit_id", "hitter", "hitter_confidence")


def rally_spans(track: DataFrame, hits: DataFrame, info: DataFrame, cut: Column, measured: tuple[str, ...], seconds: float = 5.0, least: int = 3) -> DataFrame:
    """Rallies from activity: match_id, rally, start_frame, end_frame. Measured points and hits more than 5 s apart, or with a cut in between, part;
    clusters of fewer than ``least`` frames are noise; numbers follow the time."""
    act = track.where(F.col("vis") & F.col("source").isin(*measured)).select("match_id", "frame").unionByName(hits.select("match_id", "frame")).distinct().withColumn("active", F.lit(True))
    cuts = track.where(cut).select("match_id", "frame").withColumn("cut", F.lit(True))
    s = act.join(cuts, ["match_id", "frame"], "full_outer")
    s = anchors(s, before={"cut_at": F.when(F.col("cut"), F.col("frame"))}, own=True).where("active")
    s = join_small(anchors(s, before={"prev": F.col("frame")}), info.select("match_id", F.greatest(F.lit(1), F.floor(F.lit(seconds) * F.greatest("fps", F.lit(1.0)) + 0.5)).alias("gap")), ["match_id"], "inner")
    opens = F.col("prev").isNull() | (F.col("frame") - F.col("prev") > F.col("gap")) | F.coalesce(F.col("cut_at") > F.col("prev"), F.lit(False))
    s = anchors(s.withColumn("o", F.when(opens, F.col("frame"))), before={"start_frame": F.col("o")}, own=True)
    g = s.groupBy("match_id", "start_frame").agg(F.max("frame").alias("end_frame"), F.count("*").alias("n")).where(F.col("n") >= least)
    return g.select("match_id", F.row_number().over(Window.partitionBy("match_id").orderBy("start_frame")).cast("long").alias("rally"), "start_frame", "end_frame")


def label_frames(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Frames with the rally whose span holds them, 0 outside: an interval join on one side's order, without comparing all pairs."""
    starts = spans.select("match_id", F.col("start_frame").alias("frame"), F.struct("rally", "end_frame").alias("s"))
    j = anchors(frames.join(starts, ["match_id", "frame"], "full_outer").withColumn("here", F.lit(True)), before={"span": F.col("s")}, own=True)
    return j.select("match_id", "frame", F.when(F.col("frame") <= F.col("span.end_frame"), F.col("span.rally")).otherwise(0).alias("rally"))


def infer_single_unknown(hits: DataFrame, least: float = 0.75, gap: int = 10) -> DataFrame:
    """Hits of unknown hitter between two strong pose contacts of one side in their rally, each more than ``gap`` frames away and none an endpoint: hit_id, hitter."""
    w = Window.partitionBy("match_id", "rally").orderBy("frame", "hit_id")
    strong = F.col("hitter").isin("near", "far") & (F.col("hitter_source") == "pose_contact") & (F.coalesce("hitter_confidence", F.lit(0.0)) >= least)
    row = F.struct("frame", "hitter", strong.alias("strong"), F.col("source").isin("top_edge_exit", "endpoint").alias("loose"))
    h = hits.where("rally > 0").withColumn("row", row).withColumns({"p": F.lag("row").over(w), "n": F.lead("row").over(w)})
    ok = (F.col("hitter") == "unknown") & F.col("p.strong") & F.col("n.strong") & ~F.col("p.loose") & ~F.col("n.loose") & ~F.col("row.loose") & (F.col("frame") - F.col("p.frame") > gap) & (F.col("n.frame") - F.col("frame") > gap) & (F.col("p.hitter") == F.col("n.hitter"))
    return h.where(ok).select("hit_id", F.when(F.col("p.hitter") == "near", "far").otherwise("near").alias("hitter"))


def side_confidence(hitter: Column, confidence: Column) -> Column:
    """K6: how sure a side is, 0 for none, a percentage read as such, 0.48 where nothing (or a negative number) is given."""
    c = F.when(confidence > 1, confidence / 100).otherwise(confidence)
    return F.when(~F.coalesce(hitter.isin("near", "far"), F.lit(False)), 0.0).when(c.isNull() | (c < 0), 0.48).otherwise(F.least(F.lit(1.0), c))


def alternation(hits: DataFrame, threshold: float = 0.60, collision: int = 10, direction: tuple[str, str] | None = None) -> DataFrame:
    """Sides repaired within rallies: hit_id, hitter, hitter_confidence, provenance.

    Anchors are sides of confidence ``threshold`` or more, or 0.85 where the side is the sidecar's own (``hitter_source`` null or sidecar). Exactly one hit between two anchors of one side is
    the other side's: if unknown it is inferred at 0.55; if it is weak, says otherwise and its direction (columns of side and confidence named by ``direction``, 0.45 or more) supports it, it
    is corrected at 0.45 to 0.58. Not where the three collide: an edge exit or endpoint among them, or two at most ``collision`` frames apart.
    """
    w = Window.partitionBy("match_id", "rally").orderBy("frame", "hit_id")
    conf = side_confidence(F.col("hitter"), F.col("hitter_confidence"))
    source = F.lower(F.trim(F.coalesce("hitter_source", F.lit("sidecar"))))
    h = hits.where("rally > 0").withColumns({"conf": conf, "own": source == "sidecar"})
    anchor = F.col("hitter").isin("near", "far") & (F.col("conf") >= threshold) & (~F.col("own") | (F.col("conf") >= 0.85))
    h = h.withColumn("row", F.struct("frame", "hitter", anchor.alias("anchor"), F.col("source").isin("edge_exit", "top_edge_exit", "endpoint", "classical_endpoint").alias("loose")))
    h = h.withColumns({"p": F.lag("row").over(w), "n": F.lead("row").over(w)})
    close = lambda a, b: (b - a).between(1, collision)
    free = ~F.col("p.loose") & ~F.col("row.loose") & ~F.col("n.loose") & ~close(F.col("p.frame"), F.col("frame")) & ~close(F.col("frame"), F.col("n.frame"))
    gap = F.coalesce(~F.col("row.anchor") & F.col("p.anchor") & F.col("n.anchor") & free & (F.col("p.hitter") == F.col("n.hitter")), F.lit(False))
    other = F.when(F.col("p.hitter") == "near", "far").otherwise("near")
    inferred = gap & (F.col("hitter") == "unknown")
    says = F.lit(False)
    if direction:
        sure = F.when(F.col(direction[1]) > 1, F.col(direction[1]) / 100).otherwise(F.col(direction[1]))
        says = F.coalesce((F.lower(F.trim(direction[0])) == other) & (sure >= 0.45), F.lit(False))
    corrected = gap & (F.col("hitter") != "unknown") & (F.col("hitter") != other) & (F.col("conf") < threshold) & says
    return h.select(
        "hit_id", F.when(inferred | corrected, other).otherwise(F.col("hitter")).alias("hitter"), F.when(inferred, 0.55).when(corrected, F.least(F.lit(0.58), F.greatest(F.lit(0.45), F.col("conf")))).otherwise(F.col("conf")).alias("hitter_confidence"),
        F.when(inferred, "rally_alternation_inferred").when(corrected, "rally_alternation_corrected").when(F.col("hitter") == "unknown", "unknown").otherwise(source).alias("provenance"),
    )


def receivers(hits: DataFrame) -> DataFrame:
    """The next hit of the rally and who receives: hit_id, end_frame, receiver (a different identified side)."""
    w = Window.partitionBy("match_id", "rally").orderBy("frame", "hit_id")
    h = hits.where("rally > 0").withColumns({"nf": F.lead("frame").over(w), "nh": F.lead("hitter").over(w)})
    return h.select("hit_id", F.col("nf").alias("end_frame"), F.when(F.col("nh").isin("near", "far") & (F.col("nh") != F.col("hitter")) & (F.col("nf") > F.col("frame")), F.col("nh")).alias("receiver"))
