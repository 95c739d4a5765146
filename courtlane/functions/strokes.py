"""Stroke labels, scores and decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes of the 18-class model in the order of its outputs, and the names of the twelve-class and seventeen-class models.
CLASSES_18 = (
    "Bottom-Block", "Bottom-Clear", "Bottom-Drive", "Bottom-Dropshot", "Bottom-Net-Kill", "Bottom-Net-Lift", "Bottom-Net-Shot", "Bottom-Serve", "Bottom-Smash",
    "Top-Block", "Top-Clear", "Top-Drive", "Top-Dropshot", "Top-Net-Kill", "Top-Net-Lift", "Top-Net-Shot", "Top-Serve", "Top-Smash",
)
CLASSES_12 = ("放小球", "擋小球", "殺球", "挑球", "長球", "平球", "切球", "推球", "撲球", "勾球", "發短球", "發長球")
CLASSES_17 = ("放小球", "擋小球", "殺球", "點扣", "挑球", "防守回挑", "長球", "平球", "後場抽平球", "切球", "過渡切球", "推球", "撲球", "防守回抽", "勾球", "發短球", "發長球")
#: Which family a label means, without its side, in lower case.
FAMILIES = {
    "net": ("放小球", "搓放网", "net-shot", "net shot", "网前球"),
    "smash": ("殺球", "杀球", "smash"),
    "lift": ("挑球", "防守回挑", "net-lift", "net lift"),
    "clear": ("長球", "高远球", "clear"),
    "drop": ("切球", "過渡切球", "吊球", "dropshot", "drop-shot", "drop shot"),
    "push": ("推球", "push"),
    "net_kill": ("撲球", "扑球", "net-kill", "net kill"),
    "cross_net": ("勾球", "勾对角", "cross-net", "cross net"),
    "serve": ("發短球", "發長球", "短发球", "长发球", "发球", "serve"),
    "defensive_drive": ("後場抽平球", "后场平抽", "防守回抽"),
}
AREAS = {"serve": ("serve",), "front": ("net", "lift", "push", "cross_net", "net_kill"), "back": ("clear", "drive_clear", "drop", "smash", "defensive_drive")}


def normalised(label: Column) -> Column:
    return F.lower(F.trim(F.coalesce(label, F.lit(""))))


def without_side(label: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(label, F.lit(""))), "^(Top|Bottom)[_-]", "")


def family_of(label: Column) -> Column:
    """Family of a label, null where it is unknown."""
    bare = F.lower(without_side(label))
    return F.coalesce(*[F.when(bare.isin(*names), F.lit(f)) for f, names in FAMILIES.items()])


def side_of(label: Column) -> Column:
    return F.when(label.rlike("^Top[_-]"), "far").when(label.rlike("^Bottom[_-]"), "near")


def area_of(family: Column) -> Column:
    return F.coalesce(*[F.when(family.isin(*fs), F.lit(a)) for a, fs in AREAS.items()], F.lit("unknown"))


def probability(value: Column) -> Column:
    """0..1 from a share or a percentage."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(value > 1, value / 100).otherwise(value)))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def top_classes(logits: Column, k: int = 3) -> Column:
    """The k likeliest classes as (class_id, raw_label, probability), ties to the smaller id."""
    labels = F.array(*[F.lit(c) for c in CLASSES_18])
    rows = F.transform(softmax(logits), lambda p, i: F.struct((-p).alias("key"), i.alias("class_id"), F.element_at(labels, i + 1).alias("raw_label"), p.alias("probability")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda r: F.struct(r["class_id"], r["raw_label"], r["probability"]))


def type_gate(top1: Column, confirmed: Column, pose: Column, ball: Column) -> Column:
    """First reason that keeps a stroke type from being shown, or ready."""
    return F.when(top1 < 0.60, "low_confidence").when(~confirmed, "event_unconfirmed").when(pose < 0.08, "low_pose_coverage").when(ball < 0.08, "low_ball_coverage").otherwise("ready")


def coach_gate(top1: Column, margin: Column, confirmed: Column, pose: Column, ball: Column) -> Column:
    """First reason that keeps a stroke from being coached, or ready; a null margin is missing."""
    return F.when(top1 < 0.85, "low_confidence").when(margin.isNull(), "margin_unavailable").when(margin < 0.25, "low_margin").when(~confirmed, "event_unconfirmed").when(pose < 0.85, "low_pose_coverage").when(ball < 0.55, "low_ball_coverage").otherwise("ready")


def route_family(origin: Column, receiver: Column, arc: Column, flight: Column, fast: dict[float, Column], lateral: Column, first: Column, points: Column, candidate: Column) -> Column:
    """Family by where a stroke starts, who takes it where, and how it flies. ``fast[q]``: reliable speed at or above the video's quantile q with a high arm."""
    front = (
        F.when(receiver == "back", F.when((arc >= 0.12) | (flight >= 1.10), "lift").otherwise("push"))
        .when(receiver == "front", F.when(lateral >= 1.15, "cross_net").otherwise("net"))
        .when(receiver == "mid", F.when(fast[0.82], "net_kill").otherwise("push"))
        .otherwise("front_unknown")
    )
    back = (
        F.when(receiver == "front", F.when(fast[0.85], "smash").otherwise("drop"))
        .when(receiver == "back", F.when((arc >= 0.14) & (flight >= 1.10), "clear").when(arc < 0.14, "drive_clear").otherwise("back_unknown"))
        .when(receiver == "mid", F.when(fast[0.85], "smash").when(arc < 0.12, "defensive_drive").otherwise("drive_clear"))
        .otherwise("back_unknown")
    )
    return F.when(~candidate | (points < 4), "unknown").when(first, "serve").when(origin == "front", front).when(origin == "back", back).otherwise("unknown")


def evidence_score(confirmed: Column, points: Column, reliable: Column, origin: Column, receiver: Column, samples: Column, pose: Column, inferred: Column, receiver_inferred: Column) -> Column:
    """Sum of what speaks for a stroke, a whole number from 20 to 88; the cap comes before the penalties for an inferred hitter (12) and an inferred receiver's side (8)."""
    add = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), float(n)).otherwise(0.0)
    zones = ("front", "mid", "back")
    raw = 22.0 + add(confirmed, 20) + add(points >= 4, 17) + add(reliable, 10) + add(origin.isin(*zones), 13) + add(receiver.isin(*zones), 13) + add((samples >= 2) & (pose >= 0.45), 8)
    capped = F.least(F.lit(88.0), F.greatest(F.lit(20.0), raw)) - add(inferred, 12) - add(receiver_inferred, 8)
    return F.bround(F.least(F.lit(88.0), F.greatest(F.lit(20.0), capped)))


def capped_confidence(score: Column, family: Column, candidate: Column, confirmed: Column, reliable: Column) -> Column:
    """A score held down where a type stays a guess: unknown or unconfirmed 58, short net play and drives 74, fast strokes without a reliable speed 65."""
    cap = F.least(
        F.when((candidate & ~confirmed) | family.isin("unknown", "front_unknown", "back_unknown"), 58.0).otherwise(100.0),
        F.when(family.isin("cross_net", "net", "defensive_drive"), 74.0).otherwise(100.0),
        F.when(~reliable & family.isin("smash", "net_kill", "drive_clear"), 65.0).otherwise(100.0),
    )
    return F.least(score, cap)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 72, "medium").otherwise("low")


def hand_variant(hand: Column, arm: Column, side: Column, consistent: Column) -> Column:
    """forehand or backhand by the side of the contact, null where the evidence is short."""
    ok = hand.isin("left", "right") & (arm == hand) & (F.abs(side) >= 0.25) & consistent
    return F.when(ok, F.when(((hand == "right") & (side > 0)) | ((hand == "left") & (side < 0)), "forehand").otherwise("backhand"))


def redacted(text: Column) -> Column:
    """File paths replaced by a mark."""
    return F.regexp_replace(text, r"(/[A-Za-z0-9_.-]+){2,}", "[path]")


def type_choice(rule: Column, model: Column, carded: Column, side_ok: Column, confidence: Column, confirmed: Column, pose: Column, ball: Column, margin: Column) -> tuple[Column, Column]:
    """Status and family where a route's type meets a model's: the route stands unless the model's card passes its gates and either agrees, or fills in an unknown
    route without contradicting its area. Agreement counts as the model's only at 0.85 confidence, 0.25 margin and full coverage."""
    open_ = rule.isin("unknown", "front_unknown", "back_unknown")
    area = F.when(rule == "front_unknown", "front").when(rule == "back_unknown", "back").otherwise(area_of(rule))
    conflict = F.when(open_, (area != "unknown") & (area != area_of(model))).otherwise(rule != model)
    strict = coach_gate(confidence, margin, confirmed, pose, ball) == "ready"
    status = (
        F.when(~carded, "unavailable").when(~side_ok, "side_mismatch").when(confidence < 0.60, "low_confidence").when(~confirmed | (pose < 0.08) | (ball < 0.08), "insufficient_evidence")
        .when(model.isNull(), "unsupported").when(conflict, "conflict").when(rule == model, F.when(strict, "agreement").otherwise("rule_fallback")).otherwise("adopted")
    )
    return status, F.when(status.isin("agreement", "adopted"), model).otherwise(rule)


def posture_signals(family: Column, samples: Column, pose: Column, knee: Column, stance: Column, elbow: Column, reach: Column, high_share: Column, least: Column | int = 3) -> Column:
    """Posture signals of a stroke from at least ``least`` samples, in a fixed order; none where fewer than two samples or a confidence under 0.4 show the pose.

    Straight knees or a narrow stance by family, and an arm that stays short overhead.
    """
    enough = samples >= least
    front, back = family.isin(*AREAS["front"], "front_unknown"), family.isin(*AREAS["back"], "back_unknown")
    rules = {
        "serve_preparation": (family == "serve") & enough & ((knee >= 165) | (stance < 0.52)),
        "front_support": front & enough & ((knee >= 168) | (stance < 0.48)),
        "overhead_extension": back & enough & (high_share >= 0.67) & (elbow < 145) & (reach < 1.05),
        "back_support": back & enough & (knee >= 170),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]))
    return F.when((samples >= 2) & (pose >= 0.4), found).otherwise(F.array().cast("array<string>"))
