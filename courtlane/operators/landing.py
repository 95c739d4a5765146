"""Landings: evidence that the ball came to rest, and the call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlane.functions import geometry as G
from courtlane.operators.sequence import runs
from courtlane.session import join_small, staged

#: Share of the court's size in pixels (held within 400 to 1800): settled, motion, approach, and resumed motion.
SETTLE, MOTION, APPROACH_LEAST, APPROACH_MOST = 0.012, 0.012, 0.012, 0.050


def observation_runs(track: DataFrame, most_gap: int = 2) -> DataFrame:
    """Visible measured points with run, the first frame of their run of gaps up to ``most_gap``."""
    return runs(track.where(F.col("vis") & F.col("source").isin("model", "classical")).select("match_id", "frame", "x", "y", "conf"), F.lit(True), most_gap)


def rest_evidence(obs: DataFrame, info: DataFrame, span_seconds: float = 0.16, turn: float = 0.25, ratio: float = 3.5, ease: float = 1.0) -> DataFrame:
    """Runs that end at rest: match_id, run, event_frame, x, y, approach, settle_px.

    Only the last five points of a run matter: three in a row that hardly move, confident (0.35 each, 0.55 on average), after two steps that are fast enough, keep their direction, and don't jump.
    ``ease`` above 1 widens the limits of rest and lowers those of motion by that factor.
    """
    # a ranked window with a limit sends five rows of a run from a task, however long the run is
    w = Window.partitionBy("match_id", "run").orderBy(F.desc("frame"))
    last = obs.withColumn("__k", F.row_number().over(w)).where("__k <= 5").groupBy("match_id", "run").agg(F.reverse(F.array_sort(F.collect_list(F.struct("frame", "x", "y", "conf")))).alias("t"))
    g = obs.groupBy("match_id", "run").agg(F.count("*").alias("n"), F.min("frame").alias("f0"), F.max("frame").alias("f1")).where("n >= 5").join(last, ["match_id", "run"])
    g = join_small(g, info, ["match_id"], "inner").withColumn("scale", F.least(F.lit(1800.0), F.greatest(F.lit(400.0), F.sqrt(F.abs(F.expr(G.shoelace([f"q{k}" for k in range(8)])))))))
    p = lambda i, c: F.get("t", F.lit(i))[c]
    step = lambda i: F.sqrt((p(i, "x") - p(i + 1, "x")) ** 2 + (p(i, "y") - p(i + 1, "y")) ** 2) / F.greatest(F.lit(1), p(i, "frame") - p(i + 1, "frame"))
    far = lambda i, j: F.sqrt((p(i, "x") - p(j, "x")) ** 2 + (p(i, "y") - p(j, "y")) ** 2)
    settle = ease * F.least(F.lit(12.0), F.greatest(F.lit(4.0), SETTLE * F.col("scale")))
    approach, before = step(2), step(3)
    least, most = F.greatest(F.lit(7.0), APPROACH_LEAST * F.col("scale")) / ease, F.greatest(F.lit(28.0), APPROACH_MOST * F.col("scale"))
    dot = (p(2, "x") - p(3, "x")) * (p(3, "x") - p(4, "x")) + (p(2, "y") - p(3, "y")) * (p(3, "y") - p(4, "y"))
    mid = lambda c: p(0, c) + p(1, c) + p(2, c) - F.greatest(p(0, c), p(1, c), p(2, c)) - F.least(p(0, c), p(1, c), p(2, c))
    spread = F.greatest(far(0, 1), far(0, 2), far(1, 2))
    moved = F.sqrt((p(3, "x") - mid("x")) ** 2 + (p(3, "y") - mid("y")) ** 2)
    ok = (
        (F.col("f1") - F.col("f0") >= F.greatest(F.lit(4), F.floor(F.greatest("fps", F.lit(1.0)) * span_seconds + 0.5))) & (p(0, "frame") - p(1, "frame") == 1) & (p(1, "frame") - p(2, "frame") == 1) & (spread <= settle)
        & (F.least(p(0, "conf"), p(1, "conf"), p(2, "conf")) >= 0.35) & ((p(0, "conf") + p(1, "conf") + p(2, "conf")) / 3 >= 0.55)
        & (approach >= least) & (before >= 0.55 * least) & (approach <= F.greatest(most, before * ratio)) & (dot >= turn * far(2, 3) * far(3, 4)) & (far(2, 3) > 1e-6) & (far(3, 4) > 1e-6)
        & (moved >= F.least(F.lit(18.0), F.greatest(F.lit(8.0), MOTION * F.col("scale"))) / ease) & (F.greatest(step(0), step(1)) <= settle)
    )
    return g.where(ok).select("match_id", "run", p(2, "frame").alias("event_frame"), mid("x").alias("x"), mid("y").alias("y"), approach.alias("approach"), spread.alias("settle_px"))


#: Where a hitter's side comes from only a repair, so that it may not decide a call.
REVIEW_ONLY = ("rally_alternation_inferred", "rally_alternation_corrected")
#: Reasons for which a rally gets no call, in their order of weight.
REASONS = (
    "no_confirmed_hit", "no_post_hit_observation", "shot_continues_to_next_contact", "later_hit_unconfirmed", "discontinuous_terminal_track", "flight_too_short", "no_landing_evidence", "projection_failed",
    "landing_out_of_bounds", "wrong_target_half", "low_confidence",
)


def confirmed_hit(uncertain: Column, ball_observed: Column) -> Column:
    """A hit that isn't uncertain and on whose frame the ball was seen; what isn't known speaks for it."""
    return ~F.coalesce(uncertain, F.lit(False)) & F.coalesce(ball_observed, F.lit(True))


def strong_unconfirmed(uncertain: Column, ball_observed: Column, score: Column, source: Column, confidence: Column, hitter_source: Column) -> Column:
    """A hit that isn't confirmed but likely: the ball was seen, and a sure pose contact, a sharp turn or exit, or a high score with a sure side speaks for it."""
    score, sure = F.coalesce(score, F.lit(0.0)), F.coalesce(confidence, F.lit(0.0))
    pose = F.coalesce(F.lower(F.trim(hitter_source)) == "pose_contact", F.lit(False)) & (sure >= 0.85) & (score >= 0.70)
    turn = F.coalesce(F.lower(F.trim(source)).isin("curvature", "edge_exit"), F.lit(False)) & (score >= 0.88)
    return ~confirmed_hit(uncertain, ball_observed) & F.coalesce(ball_observed, F.lit(False)) & (pose | turn | (score >= 0.90) & (sure >= 0.90))


def court_scale(q: list[str]) -> Column:
    """Size of the court in the picture, in pixels: the root of its area, 400 to 1800, 800 where it is unknown."""
    return F.coalesce(F.least(F.lit(1800.0), F.greatest(F.lit(400.0), F.sqrt(F.abs(F.expr(G.shoelace(q)))))), F.lit(800.0))


def two_sided(hits: DataFrame, obs: DataFrame, reach: int = 6, most_gap: int = 2) -> DataFrame:
    """Of hits (match_id, rally, frame, scale) those with flight on both sides: match_id, rally, frame. ``obs`` has match_id, rally, frame, x, y.

    There are two or three observations before, three or four after and one on the frame, at most ``most_gap`` frames apart, fast enough on both sides, the ball gets away, and it turns or
    changes its speed. A hit meets only the frames within ``reach``.
    """
    near = hits.select("match_id", "rally", F.col("frame").alias("hf"), "scale", F.explode(F.sequence(F.col("frame") - reach, F.col("frame") + reach)).alias("frame"))
    j = near.join(obs.select("match_id", "rally", "frame", "x", "y"), ["match_id", "rally", "frame"])
    g = j.groupBy("match_id", "rally", F.col("hf").alias("frame")).agg(F.max("scale").alias("scale"), F.sort_array(F.collect_list(F.struct(F.col("frame").alias("f"), "x", "y"))).alias("p"))
    g = g.withColumns({"b": F.expr("filter(p, q -> q.f < frame)"), "e": F.expr("get(filter(p, q -> q.f = frame), 0)"), "a": F.expr("slice(filter(p, q -> q.f > frame), 1, 4)")})
    apart = lambda df: df.repartition("match_id", "rally")  # noqa: E731  # few rows; keeps the optimiser from writing the arrays out in all that use them
    g = apart(g.where("size(b) >= 2 and size(a) >= 3 and e is not null")).withColumn("b", F.expr("slice(b, greatest(1, size(b) - 2), 3)"))
    g = apart(g.withColumn("way", F.expr("concat(b, array(e), a)"))).where(f"forall(sequence(1, size(way) - 1), i -> get(way, i).f - get(way, i - 1).f <= {most_gap})")
    g = g.withColumn("v", F.expr("transform(sequence(1, size(way) - 1), i -> sqrt(power(get(way, i).x - get(way, i - 1).x, 2) + power(get(way, i).y - get(way, i - 1).y, 2)) / greatest(1, get(way, i).f - get(way, i - 1).f))"))
    g = apart(g)
    n = F.size("b")
    at = lambda i: F.get("v", i - 1)
    before = (at(n - 1) + at(n)) / 2
    after = at(n + 1) + at(n + 2) + at(n + 3) - F.greatest(at(n + 1), at(n + 2), at(n + 3)) - F.least(at(n + 1), at(n + 2), at(n + 3))
    away = F.expr("sqrt(power(get(a, 2).x - e.x, 2) + power(get(a, 2).y - e.y, 2))")
    dot = F.expr("(e.x - get(b, size(b) - 1).x) * (get(a, 0).x - e.x) + (e.y - get(b, size(b) - 1).y) * (get(a, 0).y - e.y)")
    size = F.expr("sqrt(power(e.x - get(b, size(b) - 1).x, 2) + power(e.y - get(b, size(b) - 1).y, 2)) * sqrt(power(get(a, 0).x - e.x, 2) + power(get(a, 0).y - e.y, 2))")
    least = F.greatest(F.lit(4.0), 0.008 * F.col("scale"))
    ok = (before >= least) & (after >= least) & (away >= F.greatest(F.lit(8.0), 0.018 * F.col("scale"))) & (size > 1e-12) & ((dot <= 0.65 * size) | (after >= 1.35 * before) | (after <= 0.55 * before))
    return g.where(ok).select("match_id", "rally", "frame")


def rally_calls(frames: DataFrame, hits: DataFrame, info: DataFrame, review: bool = False, span_seconds: float = 0.16) -> DataFrame:
    """Where each rally's last shuttle landed: match_id, rally, reason (null for a call), hit_frame, frame, hitter, x_m, y_m, line_m, decision (in, out, review), confidence, rejected_runs.

    ``frames`` has match_id, rally, frame, x, y, conf of the rows of positive rallies, x null where no detector saw the ball; ``hits`` match_id, rally, frame, score, source, hitter, uncertain,
    ball_observed, hitter_confidence, hitter_source, shot_end. ``review`` (an uncertain calibration) makes every call a review.

    The last confirmed hit ends the rally unless its shot goes on to a real contact, or a strong unconfirmed hit follows (without the picture both mean that play went on). After it the
    first unbroken run of three observations or more must last long enough, come to rest, and lie in or near the court, in the half that the hitter aims at; runs after a hole prove
    nothing, but make the call a review. One rally is a bounded number of rows; its runs are found block by block like any other.
    """
    q = [f"q{k}" for k in range(8)]
    h = join_small(hits, info, ["match_id"], "inner").withColumn("scale", court_scale(q))
    h = h.withColumns({"sure": confirmed_hit(F.col("uncertain"), F.col("ball_observed")), "strong": strong_unconfirmed(*[F.col(c) for c in ("uncertain", "ball_observed", "score", "source", "hitter_confidence", "hitter_source")])})
    h = staged(h.select("match_id", "rally", "frame", "scale", "hitter", "hitter_source", "shot_end", "sure", "strong"), "hits")
    obs = frames.where("x is not null and y is not null")
    rallies = h.groupBy("match_id", "rally").agg(F.max(F.when(F.col("sure"), F.struct("frame", "hitter", "hitter_source", "shot_end"))).alias("last"), F.max(F.when(F.col("strong"), F.col("frame"))).alias("strong_at"))
    r = rallies.select("match_id", "rally", "strong_at", F.col("last.frame").alias("hit_frame"), F.lower(F.trim(F.coalesce("last.hitter", F.lit("unknown")))).alias("hitter"), F.lower(F.trim(F.coalesce("last.hitter_source", F.lit("")))).alias("from"), F.col("last.shot_end").alias("shot_end"))
    row = frames.select("match_id", "rally", F.col("frame").alias("shot_end"), F.lit(True).alias("end_row")).distinct()
    real = two_sided(h.where("strong"), obs).select("match_id", "rally", F.col("frame").alias("shot_end"), F.lit(True).alias("end_real"))
    sure = h.where("sure").select("match_id", "rally", F.col("frame").alias("shot_end"), F.lit(True).alias("end_sure")).distinct()
    for side in (row, real, sure):
        r = r.join(side, ["match_id", "rally", "shot_end"], "left")
    goes_on = F.coalesce(F.col("shot_end") > F.col("hit_frame"), F.lit(False))
    r = r.withColumns({"continues": goes_on & (F.col("end_row").isNull() | F.coalesce("end_real", F.lit(False)) | F.coalesce("end_sure", F.lit(False))), "bound": F.when(goes_on, F.col("shot_end")), "later": F.coalesce(F.col("strong_at") > F.col("hit_frame"), F.lit(False))})
    known = F.col("hitter").isin("near", "far") & ~F.col("from").isin(*REVIEW_ONLY)
    r = r.select("match_id", "rally", "hit_frame", "continues", "bound", "later", F.when(known, F.col("hitter")).otherwise("unknown").alias("hitter"))
    r = staged(r, "rallies")
    after = obs.join(r.where("hit_frame is not null and not continues and not later").select("match_id", "rally", "hit_frame", "bound"), ["match_id", "rally"]).where("frame > hit_frame and (bound is null or frame <= bound)")
    run = staged(runs(after.select("match_id", "rally", "frame", "x", "y", "conf"), F.lit(True), 2, by="rally"), "tails")
    g = run.groupBy("match_id", "rally", "run").agg(F.count("*").alias("n"), F.max("frame").alias("end"), F.avg("conf").alias("mean"))
    tail = g.groupBy("match_id", "rally").agg(F.count("*").alias("all"), F.count_if(F.col("n") >= 3).alias("coherent"), F.min(F.when(F.col("n") >= 3, F.struct("run", "n", "end", "mean"))).alias("t"))
    rest = rest_evidence(run.drop("rally"), info, span_seconds).select("match_id", F.col("run").alias("rest_run"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    k = join_small(r.join(tail, ["match_id", "rally"], "left"), info, ["match_id"], "inner").withColumn("rest_run", F.col("t.run"))
    k = staged(k.join(rest, ["match_id", "rest_run"], "left"), "landings")
    x, y = G.project("rx", "ry")
    k = k.withColumns({"x_m": F.expr(x), "y_m": F.expr(y), "flight": F.col("t.end") - F.col("hit_frame"), "fps": F.greatest("fps", F.lit(1.0)), "rejected": F.coalesce(F.col("coherent") - 1, F.lit(0))})
    # one row per rally; a shuffle of these keeps the optimiser from writing each expression out in all that use it
    apart = lambda df: df.repartition("match_id", "rally")
    k = apart(apart(k).withColumns({"line_m": F.expr(G.line_distance("x_m", "y_m")), "target": F.expr(G.target_half("hitter", "y_m"))}))
    fallback = F.col("rejected") > 0
    score = 100.0 * (0.38 * F.least(F.lit(1.0), F.col("t.n") / 5) + 0.25 * F.col("t.mean") + 0.22 * F.least(F.lit(1.0), F.col("flight") / F.greatest(F.lit(1.0), F.col("fps") * 0.70)) + 0.15 * F.when(F.coalesce("target", F.lit(False)), 1.0).otherwise(0.68))
    held = F.lit(review) | (F.col("hitter") == "unknown") | fallback
    k = k.withColumn("confidence", F.when(held, F.least(F.lit(79.0), F.bround(score))).otherwise(F.bround(score)))
    reason = (
        F.when(F.col("hit_frame").isNull(), "no_confirmed_hit").when(F.col("continues"), "shot_continues_to_next_contact").when(F.col("later"), "later_hit_unconfirmed").when(F.col("all").isNull(), "no_post_hit_observation")
        .when(F.col("coherent") == 0, "discontinuous_terminal_track").when(F.col("flight") < F.greatest(F.lit(3), F.bround(F.col("fps") * 0.18)), "flight_too_short").when(F.col("rx").isNull(), "no_landing_evidence")
        .when(F.col("line_m").isNull(), "projection_failed").when(F.col("line_m") < -1.0, "landing_out_of_bounds").when(~F.coalesce("target", F.lit(True)), "wrong_target_half").when(F.col("confidence") < 66, "low_confidence")
    )
    k = apart(k.withColumn("reason", reason))
    call = F.when(held, "review").otherwise(F.expr(G.line_call("line_m")))
    of = lambda c: F.when(F.col("reason").isNull(), c)
    return k.select("match_id", "rally", "reason", "hit_frame", of(F.col("t.end")).alias("frame"), "hitter", of(F.col("x_m")).alias("x_m"), of(F.col("y_m")).alias("y_m"), of(F.col("line_m")).alias("line_m"), of(call).alias("decision"), of(F.col("confidence")).alias("confidence"), F.col("rejected").alias("rejected_runs"))
