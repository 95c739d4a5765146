"""Coaching of strokes: signals of posture and of phases, what keeps them from counting, and advice from repeated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlane.functions.strokes import AREAS

#: Least stroke confidence, contact samples, pose confidence and measured points of a stroke that may count, and hits that must repeat a signal.
STROKE_CONFIDENCE, CONTACT_SAMPLES, POSE_CONFIDENCE, REAL_POINTS, REPEATED_HITS = 72, 3, 0.80, 6, 3
UNKNOWN = ("unknown", "front_unknown", "back_unknown")
OVERHEAD = ("clear", "drive_clear", "drop", "smash")
#: Signals, in the order in which a stroke shows them, and the group of coaching that each belongs to.
GROUPS = {
    "serve_preparation": "serve", "serve_first_step": "serve", "front_support": "frontcourt", "front_contact_space": "frontcourt", "overhead_extension": "overhead", "back_support": "backcourt",
    "preparation_support": "preparation", "overhead_preparation": "overhead", "recovery_stability": "recovery",
}
PHASE_SIGNALS = ("preparation_support", "overhead_preparation", "recovery_stability")


def _said(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order; a rule over nulls doesn't."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def _enough(value: str, samples: str) -> Column:
    return F.col(value).isNotNull() & (F.col(samples) >= CONTACT_SAMPLES)


def stroke_signals() -> Column:
    """Signals of a stroke's family from the columns family, contact_samples, pose_confidence, knee, knee_samples, stance, stance_samples, elbow, elbow_samples, reach, reach_samples,
    contact_distance, contact_distance_samples, post_motion_m, arm, arm_above_share, arm_above_samples. None unless two samples at 0.45 show the pose."""
    family = F.col("family")
    front, back = family.isin(*AREAS["front"], "front_unknown"), family.isin(*OVERHEAD, "defensive_drive", "back_unknown")
    low = lambda knee, stance: _enough("knee", "knee_samples") & (F.col("knee") >= knee) | _enough("stance", "stance_samples") & (F.col("stance") < stance)
    raised = F.col("arm").isin("left", "right") & (F.col("arm_above_share") >= 0.67) & (F.col("arm_above_samples") >= CONTACT_SAMPLES)
    short = _enough("elbow", "elbow_samples") & (F.col("elbow") < 145) & _enough("reach", "reach_samples") & (F.col("reach") < 1.05)
    found = _said({
        "serve_preparation": (family == "serve") & low(165, 0.52), "serve_first_step": (family == "serve") & (F.col("post_motion_m") < 0.18), "front_support": front & low(168, 0.48),
        "front_contact_space": front & _enough("contact_distance", "contact_distance_samples") & (F.col("contact_distance") < 0.78), "overhead_extension": family.isin(*OVERHEAD) & raised & short,
        "back_support": back & _enough("knee", "knee_samples") & (F.col("knee") >= 170),
    })
    return F.when(visible_pose(), found).otherwise(F.array().cast("array<string>"))


def visible_pose() -> Column:
    return F.coalesce((F.col("contact_samples") >= 2) & (F.col("pose_confidence") >= 0.45), F.lit(False))


def phase_signals() -> Column:
    """Signals of any stroke's phases from prep_samples, prep_knee, prep_knee_samples, prep_stance, prep_stance_samples, prep_wrist, contact_wrist, contact_wrist_samples, peak_wrist_speed,
    flight_seconds, recovery_intervals, recovery_observed, recovery_stable and recovery_stable_seconds."""
    bent = _enough("prep_knee", "prep_knee_samples") & (F.col("prep_knee") >= 165) | _enough("prep_stance", "prep_stance_samples") & (F.col("prep_stance") < 0.52)
    late = (F.col("prep_samples") >= 3) & (F.col("prep_wrist") < -0.08) & (F.col("contact_wrist") >= 0.05) & (F.col("contact_wrist_samples") >= 2) & (F.col("peak_wrist_speed") >= 1.0)
    restless = ~F.coalesce("recovery_stable", F.lit(False)) | F.col("recovery_stable_seconds").isNull() | (F.col("recovery_stable_seconds") > 0.65)
    slow = (F.col("flight_seconds") >= 0.75) & (F.col("recovery_intervals") >= 3) & (F.col("recovery_observed") >= 0.70) & restless
    found = _said({"preparation_support": (F.col("prep_samples") >= 3) & bent, "overhead_preparation": late, "recovery_stability": slow})
    return F.when(visible_pose(), found).otherwise(F.array().cast("array<string>"))


def type_gate(signals: Column) -> Column:
    """C25: what keeps a stroke's own signals from counting (none: they count), from family, confidence, contact_samples, pose_confidence and real_points; nulls count as 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    known = F.col("family").isin(*[f for fs in AREAS.values() for f in fs])
    return _said({
        "stroke_family_unknown": ~F.coalesce(known, F.lit(False)), "stroke_confidence_low": n("confidence") < STROKE_CONFIDENCE, "contact_samples_low": n("contact_samples") < CONTACT_SAMPLES,
        "pose_confidence_low": n("pose_confidence") < POSE_CONFIDENCE, "trajectory_points_low": n("real_points") < REAL_POINTS, "no_actionable_signal": F.size(signals) == 0,
    })


def phase_gate(signals: Column) -> Column:
    """What keeps the phases' signals from counting, from event_confirmed, contact_samples, phase_confidence, real_points and phase_reasons (the reasons found while measuring: those that
    hold for every signal, and those of the phases that the signals speak of)."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    has = lambda *s: F.arrays_overlap(signals, F.array(*[F.lit(x) for x in s]))
    own = _said({
        "event_unconfirmed": ~F.col("event_confirmed"), "contact_samples_low": n("contact_samples") < CONTACT_SAMPLES, "phase_pose_confidence_low": n("phase_confidence") < POSE_CONFIDENCE,
        "trajectory_points_low": n("real_points") < REAL_POINTS,
    })
    matter = F.concat(F.array(*[F.lit(x) for x in ("arm_unresolved", "configured_hand_motion_conflict", "phase_pose_confidence_low")]), _said({"prep_samples_low": has("preparation_support", "overhead_preparation"), "contact_phase_samples_low": has("overhead_preparation"), "recovery_samples_low": has("recovery_stability")}))
    measured = F.filter(F.coalesce("phase_reasons", F.array().cast("array<string>")), lambda c: F.array_contains(matter, c))
    return F.concat(F.array_distinct(F.concat(own, measured)), _said({"no_actionable_phase_signal": F.size(signals) == 0}))


def reviewed(strokes: DataFrame) -> DataFrame:
    """Strokes (columns as above) with signals, phase_signals, type_reasons, phase_reasons_all and eligible_signals: the signals that may count towards advice."""
    none = F.array().cast("array<string>")
    r = strokes.withColumns({"signals": stroke_signals(), "phase_signals": phase_signals()})
    r = r.withColumns({"type_reasons": type_gate(F.col("signals")), "phase_reasons_all": phase_gate(F.col("phase_signals"))})
    return r.withColumn("eligible_signals", F.concat(F.when(F.size("type_reasons") == 0, F.col("signals")).otherwise(none), F.when(F.size("phase_reasons_all") == 0, F.col("phase_signals")).otherwise(none)))


def matches_family(signal: Column, family: Column) -> Column:
    front, over = family.isin(*AREAS["front"]), family.isin(*OVERHEAD)
    return F.when(signal.isin(*PHASE_SIGNALS), F.lit(True)).when(signal.startswith("serve_"), family == "serve").when(signal.startswith("front_"), front).when(signal == "overhead_extension", over).when(signal == "back_support", over | (family == "defensive_drive")).otherwise(F.lit(False))


def independent_hits(reviews: DataFrame) -> DataFrame:
    """E15: one row per (match_id, rally, idx) of reviews (with frame, family, confidence, eligible_signals): its first frame, least confidence, and the signals that all its reviews share.

    A frame that several identities claim drops them all, and so does an identity with several families. Reviews without rally, idx or frame are left out.
    """
    rv = reviews.where("rally is not null and idx is not null and frame is not null")
    twice = rv.groupBy("match_id", "frame").agg(F.count_distinct("rally", "idx").alias("n")).where("n > 1").select("match_id", "frame")
    torn = rv.join(twice, ["match_id", "frame"], "left_semi").select("match_id", "rally", "idx").distinct()
    one = rv.join(torn, ["match_id", "rally", "idx"], "left_anti")
    g = one.groupBy("match_id", "rally", "idx").agg(F.min("frame").alias("frame"), F.max("family").alias("family"), F.min("confidence").alias("confidence"), F.count_distinct("family").alias("families"), F.count("*").alias("n")).where("families = 1")
    s = one.select("match_id", "rally", "idx", F.explode(F.array_distinct("eligible_signals")).alias("signal")).groupBy("match_id", "rally", "idx", "signal").agg(F.count("*").alias("k"))
    shared = s.join(g.select("match_id", "rally", "idx", "n"), ["match_id", "rally", "idx"]).where("k = n").groupBy("match_id", "rally", "idx").agg(F.sort_array(F.collect_list("signal")).alias("signals"))
    return g.drop("families", "n").join(shared, ["match_id", "rally", "idx"], "left").withColumn("signals", F.coalesce("signals", F.array().cast("array<string>")))


def recommendations(hits: DataFrame, most: int = 3) -> DataFrame:
    """Per match the ``most`` commonest signals that REPEATED_HITS independent hits or more show: match_id, coach_group, signal, hits, priority, place; ties by group and name. A top-k report."""
    group = F.coalesce(*[F.when(F.col("signal") == s, F.lit(g)) for s, g in GROUPS.items()])
    s = hits.withColumn("signal", F.explode("signals")).where(matches_family(F.col("signal"), F.col("family"))).groupBy("match_id", group.alias("coach_group"), "signal").agg(F.count("*").alias("hits")).where(F.col("hits") >= REPEATED_HITS)
    w = Window.partitionBy("match_id").orderBy(F.desc("hits"), "coach_group", "signal")
    return s.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).withColumn("priority", F.when(F.col("hits") >= 5, "high").otherwise("medium"))
