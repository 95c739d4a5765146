"""Vetoes: they never drop a frame, they say which points to hide, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlane.functions import geometry as G
from courtlane.operators.sequence import anchors, around, at_offsets, runs, segments


def hidden(track: DataFrame, veto: str, when) -> DataFrame:
    """The track with the points hidden where ``when`` holds: visible off, position null, confidence 0, source ``veto``."""
    gone = F.col("vis") & F.coalesce(when, F.lit(False))
    return track.withColumns({"__g": gone}).withColumns({
        "source": F.when(F.col("__g"), F.lit(veto)).otherwise(F.col("source")), "conf": F.when(F.col("__g"), 0.0).otherwise(F.col("conf")), "x": F.when(~F.col("__g"), F.col("x")), "y": F.when(~F.col("__g"), F.col("y")), "vis": F.col("vis") & ~F.col("__g"),
    }).drop("__g")


def court_gate(track: DataFrame, quad: list[str], edge_sources: tuple[str, ...]) -> DataFrame:
    """Hides points outside the quadrilateral, unless an edge label in the corridor of the top edge explains them."""
    inside, corridor = F.expr(G.in_quad("x", "y", quad)), F.expr(G.edge_corridor("x", "y", quad))
    return hidden(track, "court_gate", ~inside & ~(F.col("source").isin(*edge_sources) & corridor))


def near_cuts(track: DataFrame, cut, reach: int) -> DataFrame:
    """Hides the points at most ``reach`` frames from a camera cut."""
    t = around(track.withColumn("__cut", F.coalesce(cut, F.lit(False)).cast("int")), {"__near": (F.max("__cut"), -reach, reach)})
    return hidden(t, "scene_cut", F.col("__near") == 1).drop("__cut", "__near")


def static_windows(track: DataFrame, frames: int = 20, slack: int = 2, radius: float = 8.0) -> DataFrame:
    """Frames of a window of ``frames`` with at least ``frames`` - ``slack`` raw model points, none classical, all within ``radius`` of their median."""
    model = F.col("raw_vis") & (F.col("raw_source") == "model")
    t = track.select("match_id", "frame", F.when(model, F.struct(F.col("raw_x").alias("x"), F.col("raw_y").alias("y"))).alias("p"), (F.col("raw_vis") & (F.col("raw_source") == "classical")).cast("int").alias("c"))
    t = around(t, {"ps": (F.collect_list("p"), 0, frames - 1), "cs": (F.max("c"), 0, frames - 1)})
    middle = lambda c: F.expr(f"(sort_array(transform(ps, p -> p.{c}))[cast(floor((size(ps) - 1) / 2) as int)] + sort_array(transform(ps, p -> p.{c}))[cast(floor(size(ps) / 2) as int)]) / 2")
    enough = (F.size("ps") >= frames - slack) & (F.col("cs") == 0)
    t = t.withColumns({"mx": F.when(enough, middle("x")), "my": F.when(enough, middle("y"))})
    still = F.expr(f"forall(ps, p -> (p.x - mx) * (p.x - mx) + (p.y - my) * (p.y - my) <= {radius * radius})")
    t = t.withColumn("still", F.coalesce(F.when(enough, still), F.lit(False)).cast("int")).drop("ps", "mx", "my")
    t = around(t, {"locked": (F.max("still"), 1 - frames, 0)})
    return t.where(F.col("p").isNotNull() & (F.col("locked") == 1)).select("match_id", "frame")


def edge_reentry(track: DataFrame, quad: list[str], top: float = 35.0) -> DataFrame:
    """Frames of two or more model points outside the quadrilateral that go on downward or upward after an edge anchor (2 < |dy| <= 80, |dx| <= 70 per frame), where an inside
    point follows within six frames: match_id, frame."""
    t = track.withColumn("inside", F.coalesce(F.expr(G.in_quad("x", "y", quad)), F.lit(False)))
    t = at_offsets(t, ["x", "y"], [-1])
    t = anchors(t, before={"edge_at": F.when(F.col("vis") & (F.col("y") <= top), F.col("frame"))}, after={"inside_at": F.when(F.col("vis") & F.col("inside"), F.col("frame"))})
    step = (F.col("y") - F.col("y_m1") > 2) & (F.col("y") - F.col("y_m1") <= 80) & (F.abs(F.col("x") - F.col("x_m1")) <= 70)
    ok = F.col("vis") & (F.col("source") == "model") & ~F.col("inside") & step & (F.col("frame") - F.col("edge_at") <= 6) & (F.col("inside_at") - F.col("frame") <= 6)
    r = runs(t, F.coalesce(ok, F.lit(False)))
    long = r.groupBy("match_id", "run").agg(F.count("*").alias("n")).where("n >= 2")
    return r.join(long, ["match_id", "run"], "left_semi").select("match_id", "frame")


def in_player_box(track: DataFrame, boxes: DataFrame, margin: float = 8, protect: float = 38, edge_y: float = 35) -> DataFrame:
    """Frames whose model point lies in a player's box with ``margin``, further than ``protect`` px from a wrist, and below the edge zone."""
    wrist = lambda k: F.expr(G.dist("x", "y", f"kp[{k}].x", f"kp[{k}].y"))
    j = track.where(F.col("vis") & (F.col("source") == "model") & (F.col("y") > edge_y)).select("match_id", "frame", "x", "y").join(boxes, ["match_id", "frame"])
    hit = F.col("x").between(F.col("b0") - margin, F.col("b2") + margin) & F.col("y").between(F.col("b1") - margin, F.col("b3") + margin)
    return j.where(hit & (wrist(9) > protect) & (wrist(10) > protect)).select("match_id", "frame").distinct()


def top_exit_branch(track: DataFrame, cut, top: float = 35, low: float = 300, within: int = 8) -> DataFrame:
    """Model points at y >= ``low`` at most ``within`` frames after an anchor at y <= ``top`` of the same camera segment."""
    t = segments(track, cut)
    t = anchors(t, before={"top_at": F.when(F.col("vis") & (F.col("y") <= top), F.col("frame"))})
    return t.where(F.col("vis") & (F.col("source") == "model") & (F.col("y") >= low) & (F.col("frame") - F.col("top_at") <= within) & (F.col("top_at") >= F.col("segment"))).select("match_id", "frame")


def top_entry_lead(track: DataFrame, top: float = 35, rise: float = 8, step: float = 220) -> DataFrame:
    """Runs of three or more frames that rise by at least ``rise`` px a frame, by steps up to ``step``, and end in an anchor at y <= ``top``: match_id, frame."""
    t = at_offsets(track.where("vis").select("match_id", "frame", "x", "y"), ["x", "y"], [1])
    rises = (F.col("y") - F.col("y_p1") >= rise) & (F.sqrt((F.col("x") - F.col("x_p1")) ** 2 + (F.col("y") - F.col("y_p1")) ** 2) <= step)
    r = runs(t, F.coalesce(rises, F.lit(False)))
    ends = r.groupBy("match_id", "run").agg(F.count("*").alias("n"), F.max_by("y_p1", "frame").alias("last_y")).where((F.col("n") >= 3) & (F.col("last_y") <= top))
    return r.join(ends, ["match_id", "run"], "left_semi").select("match_id", "frame")


def isolated_phase(phases: DataFrame, edge_y: float = 35, bridge: float = 110, reach: int = 5) -> DataFrame:
    """Frames where exactly one phase sees the ball and neither the edge nor a bridge between frames seen by both phases explains it."""
    both = F.col("a_vis") & F.col("b_vis")
    p = phases.withColumns({"one": F.col("a_vis") != F.col("b_vis"), "x": F.when(F.col("a_vis"), F.col("a_x")).otherwise(F.col("b_x")), "y": F.when(F.col("a_vis"), F.col("a_y")).otherwise(F.col("b_y"))})
    at = F.when(both, F.struct("frame", F.col("a_x").alias("x"), F.col("a_y").alias("y")))
    p = anchors(p, before={"l": at}, after={"r": at}).where("one")
    t = (F.col("frame") - F.col("l.frame")) / (F.col("r.frame") - F.col("l.frame"))
    off = F.sqrt((F.col("x") - F.col("l.x") - t * (F.col("r.x") - F.col("l.x"))) ** 2 + (F.col("y") - F.col("l.y") - t * (F.col("r.y") - F.col("l.y"))) ** 2)
    near = (F.col("frame") - F.col("l.frame") <= reach) & (F.col("r.frame") - F.col("frame") <= reach)
    kept = (F.col("y") <= edge_y) | F.coalesce(near & (off <= bridge), F.lit(False))
    return p.where(~kept).select("match_id", "frame")


def short_branches(track: DataFrame, jump: float = 240, longest: int = 3, acceleration: float = 45) -> DataFrame:
    """Branches of at most ``longest`` frames that a split cuts off inside a run of visible frames: match_id, frame, branch (its first frame). A run splits at a step of ``jump`` px or more,
    and where the velocity changes by ``acceleration`` px or more and turns back."""
    t = at_offsets(track.where("vis").select("match_id", "frame", "x", "y"), ["x", "y"], [-2, -1])
    vx, vy, ux, uy = F.col("x") - F.col("x_m1"), F.col("y") - F.col("y_m1"), F.col("x_m1") - F.col("x_m2"), F.col("y_m1") - F.col("y_m2")
    turned = F.coalesce((F.sqrt((vx - ux) ** 2 + (vy - uy) ** 2) >= acceleration) & (vx * ux + vy * uy < 0), F.lit(False))
    cut = F.coalesce((F.sqrt(vx**2 + vy**2) >= jump) | turned & F.col("x_m1").isNotNull(), F.lit(False))
    t = t.withColumn("cut", cut)
    t = anchors(t, before={"branch": F.when(F.col("x_m1").isNull() | F.col("cut"), F.col("frame"))}, own=True)
    small = t.groupBy("match_id", "branch").agg(F.count("*").alias("n"), F.max(F.col("cut").cast("int")).alias("cut")).where((F.col("n") <= longest) & (F.col("cut") == 1))
    return t.join(small, ["match_id", "branch"], "left_semi").select("match_id", "frame", "branch")


def unsupported_branches(branches: DataFrame, track: DataFrame, players: DataFrame, wrong: float = 8, box: float = 42, contact: float = 90) -> DataFrame:
    """Frames of branches (match_id, frame, branch) that no player explains: match_id, frame. A branch goes if its first point lies more than ``box`` px from every box and ``contact`` px
    from every wrist of its nearest player (match_id, frame, side, b0..b3, kp), or there is none, or if it moves by more than ``wrong`` px a frame towards that player's own side."""
    p = track.where("vis").select("match_id", "frame", "x", "y")
    v = at_offsets(p, ["y"], [-1, 1])
    size = branches.groupBy("match_id", "branch").agg(F.count("*").alias("n"))
    first = size.withColumnRenamed("branch", "frame").join(v, ["match_id", "frame"])
    first = first.withColumn("vy", F.when(F.col("n") >= 2, F.col("y_p1") - F.col("y")).otherwise(F.coalesce(F.col("y") - F.col("y_m1"), F.lit(0.0))))
    out = lambda c, a, b: F.greatest(F.col(a) - F.col(c), F.lit(0.0), F.col(c) - F.col(b))
    to_box = F.sqrt(out("x", "b0", "b2") ** 2 + out("y", "b1", "b3") ** 2)
    wrist = F.least(*[F.expr(G.dist("x", "y", f"kp[{k}].x", f"kp[{k}].y")) for k in (9, 10)])
    near = first.join(players.select("match_id", "frame", "side", "b0", "b1", "b2", "b3", "kp"), ["match_id", "frame"]).groupBy("match_id", "frame").agg(F.min(F.struct(F.least(to_box, wrist).alias("m"), "side", to_box.alias("box"), wrist.alias("wrist"))).alias("p"))
    j = first.join(near, ["match_id", "frame"], "left")
    back = F.coalesce((F.col("p.side") == "far") & (F.col("vy") < -wrong) | (F.col("p.side") == "near") & (F.col("vy") > wrong), F.lit(False))
    gone = j.where(F.col("p").isNull() | (F.col("p.box") > box) & (F.col("p.wrist") > contact) | back).select("match_id", F.col("frame").alias("branch"))
    return branches.join(gone, ["match_id", "branch"], "left_semi").select("match_id", "frame")


def coherent_dual_motion(phases: DataFrame, merged: DataFrame, candidates: DataFrame, cut, excluded: DataFrame | None = None, agree: float = 25, least: int = 2, most: int = 8, median_step: float = 12, path: float = 80, spread: float = 35, support: float = 10, delta: float = 18, edge_y: float = 35) -> DataFrame:
    """Short, fast flights that both phases saw by themselves, to be kept from vetoes: match_id, start_frame, end_frame, path_px, step_px, spread_px, delta_px.

    ``phases`` has a_ and b_ columns, ``merged`` (match_id, frame, vis, x, y, label) their union, ``candidates`` (match_id, frame) the frames in question, ``cut`` is true on camera cuts and
    ``excluded`` lists frames that may not take part. A run holds ``least`` to ``most`` neighbouring candidates of label model below the edge zone on which both phases agree, and the two frames
    on either side agree too, in the same camera segment. Over all of them the median step, the path and the spread from the median point are large enough, the two frames of either side move by
    ``support`` px, and the phases' steps differ by ``delta`` px at most (median).
    """
    both = F.col("a_vis") & F.col("b_vis") & (F.sqrt((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2) <= agree)
    seg = segments(phases.select("match_id", "frame", both.alias("both"), "a_x", "a_y", "b_x", "b_y"), cut).where("both").drop("both")
    d = seg.join(merged.where("vis").select("match_id", "frame", "x", "y", "label"), ["match_id", "frame"])
    if excluded is not None:
        d = d.join(excluded.select("match_id", "frame").distinct(), ["match_id", "frame"], "left_anti")
    on = d.join(candidates.select("match_id", "frame").distinct(), ["match_id", "frame"], "left_semi").where((F.col("label") == "model") & (F.col("y") > edge_y)).select("match_id", "frame", "segment")
    r = runs(on, F.lit(True), by="segment").groupBy("match_id", "segment", "run").agg(F.max("frame").alias("end"), F.count("*").alias("n")).where(F.col("n").between(least, most))
    local = r.withColumn("frame", F.explode(F.sequence(F.col("run") - 2, F.col("end") + 2))).join(d.drop("label"), ["match_id", "segment", "frame"])
    g = local.groupBy("match_id", "run", "end", "n").agg(F.sort_array(F.collect_list(F.struct("frame", "x", "y", "a_x", "a_y", "b_x", "b_y"))).alias("p")).where("size(p) = n + 4")
    step = lambda x, y: f"transform(sequence(0, size(p) - 2), i -> sqrt(power(get(p, i + 1).{x} - get(p, i).{x}, 2) + power(get(p, i + 1).{y} - get(p, i).{y}, 2)))"
    middle = lambda a: f"(get(sort_array({a}), cast(floor((size({a}) - 1) / 2) as int)) + get(sort_array({a}), cast(floor(size({a}) / 2) as int))) / 2"
    g = g.withColumns({"v": F.expr(step("x", "y")), "dv": F.expr("transform(sequence(0, size(p) - 2), i -> sqrt(power((get(p, i + 1).a_x - get(p, i).a_x) - (get(p, i + 1).b_x - get(p, i).b_x), 2) + power((get(p, i + 1).a_y - get(p, i).a_y) - (get(p, i + 1).b_y - get(p, i).b_y), 2)))"), "xs": F.expr("transform(p, q -> q.x)"), "ys": F.expr("transform(p, q -> q.y)")})
    g = g.withColumns({"step_px": F.expr(middle("v")), "delta_px": F.expr(middle("dv")), "mx": F.expr(middle("xs")), "my": F.expr(middle("ys")), "path_px": F.expr("aggregate(v, 0D, (a, e) -> a + e)")})
    g = g.withColumn("spread_px", F.expr("array_max(transform(p, q -> sqrt(power(q.x - mx, 2) + power(q.y - my, 2))))"))
    ok = (F.col("step_px") >= median_step) & (F.col("path_px") >= path) & (F.col("spread_px") >= spread) & (F.get("v", F.lit(0)) >= support) & (F.get("v", F.size("v") - 1) >= support) & (F.col("delta_px") <= delta)
    return g.where(ok).select("match_id", F.col("run").alias("start_frame"), F.col("end").alias("end_frame"), "path_px", "step_px", "spread_px", "delta_px")


def interstitial_branches(track: DataFrame, cut, top: float = 80, core: float = 35, most: int = 40, off: float = 110, span: float = 6) -> DataFrame:
    """Model points between a flight that leaves over the top and one that comes back, further than ``off`` px from the line between both: match_id, frame, residual (the largest).

    Leaving and returning runs stand at y <= ``top``, hold their direction (3 px of tolerance) over ``span`` px, and end or begin at y <= ``core``. They are paired by
    equality, each leaving run spread over the ``most`` frames in which a return may begin.
    """
    t = segments(track.select("match_id", "frame", "vis", "x", "y", "source"), cut)
    r = runs(t.where(F.col("vis") & F.col("source").isin("model", "model_edge", "single_phase_edge") & (F.col("y") <= top)), F.lit(True))
    r = at_offsets(r, ["y", "segment"], [-1])
    step = F.when((F.col("frame") > F.col("run")) & (F.col("segment") == F.col("segment_m1")), F.col("y") - F.col("y_m1"))
    at = F.struct("frame", "x", "y", "segment")
    g = r.groupBy("match_id", "run").agg(F.count("*").alias("n"), F.min(step).alias("lo"), F.max(step).alias("hi"), F.min_by(at, "frame").alias("a"), F.max_by(at, "frame").alias("z"), F.count_distinct("segment").alias("k")).where("n >= 2 and k = 1")
    up = g.where((F.col("hi") <= 3) & (F.col("a.y") - F.col("z.y") >= span) & (F.col("z.y") <= core)).select("match_id", F.col("z").alias("l"), F.explode(F.sequence(F.col("z.frame") + 2, F.col("z.frame") + 1 + most)).alias("at"))
    down = g.where((F.col("lo") >= -3) & (F.col("z.y") - F.col("a.y") >= span) & (F.col("a.y") <= core)).select("match_id", F.col("a").alias("r"), F.col("a.frame").alias("at"))
    b = up.join(down, ["match_id", "at"]).where(F.col("l.segment") == F.col("r.segment")).withColumn("frame", F.explode(F.sequence(F.col("l.frame") + 1, F.col("r.frame") - 1)))
    j = b.join(track.where(F.col("vis") & (F.col("source") == "model")).select("match_id", "frame", "x", "y"), ["match_id", "frame"])
    s = (F.col("frame") - F.col("l.frame")) / (F.col("r.frame") - F.col("l.frame"))
    res = F.sqrt((F.col("x") - F.col("l.x") - s * (F.col("r.x") - F.col("l.x"))) ** 2 + (F.col("y") - F.col("l.y") - s * (F.col("r.y") - F.col("l.y"))) ** 2)
    return j.select("match_id", "frame", res.alias("residual")).where(F.col("residual") > off).groupBy("match_id", "frame").agg(F.max("residual").alias("residual"))


def without_contacts(frames: DataFrame, track: DataFrame, boxes: DataFrame, reach: float = 38) -> DataFrame:
    """The frames whose point isn't within ``reach`` px of a player's wrist: match_id, frame."""
    wrist = lambda k: F.expr(G.dist("x", "y", f"kp[{k}].x", f"kp[{k}].y"))
    j = frames.select("match_id", "frame").distinct()
    near = j.join(track.select("match_id", "frame", "x", "y"), ["match_id", "frame"]).join(boxes, ["match_id", "frame"]).where(F.least(wrist(9), wrist(10)) <= reach).select("match_id", "frame")
    return j.join(near, ["match_id", "frame"], "left_anti")


def offscreen_bridges(track: DataFrame, cut, tracked: tuple[str, ...], least: int = 4, most: int = 40, top: float = 30, speed: float = 5, rise: float = 4, across: float = 8) -> DataFrame:
    """Drawing points for flights that leave over the top and come back: match_id, frame, x, y, on the line between the last and the next tracked point.

    The hole has ``least`` to ``most`` frames in one camera segment, one side is at y <= ``top``, the fitted velocity over up to four tracked points of eight frames goes up before and down
    after by ``rise`` px a frame at ``speed`` or more, and doesn't turn round at ``across`` px a frame.
    """
    t = segments(track.select("match_id", "frame", "vis", "x", "y", "source"), cut).where(F.col("vis") & F.col("source").isin(*tracked))
    p = F.struct("frame", "x", "y", "segment")
    t = around(t.withColumn("p", p), {"past": (F.collect_list("p"), -8, 0), "next": (F.collect_list("p"), 0, 8)})
    t = t.withColumns({"past": F.slice(F.array_sort(F.filter("past", lambda q: q["segment"] == F.col("segment"))), F.greatest(F.lit(1), F.size(F.filter("past", lambda q: q["segment"] == F.col("segment"))) - 3), 4), "next": F.slice(F.array_sort(F.filter("next", lambda q: q["segment"] == F.col("segment"))), 1, 4)})
    def slope(a: str, c: str):
        n = F.size(a)
        s = lambda e: F.expr(f"aggregate({a}, 0.0D, (z, q) -> z + {e})")
        f = "(q.frame - frame)"
        return F.try_divide(n * s(f"{f} * q.{c}") - s(f) * s(f"q.{c}"), n * s(f"{f} * {f}") - s(f) * s(f))
    t = t.select("match_id", "frame", "segment", "x", "y", *[slope(a, c).alias(f"{a}_{c}") for a in ("past", "next") for c in "xy"])
    side = F.struct("frame", "x", "y", "segment", F.col("past_x").alias("vx"), F.col("past_y").alias("vy"))
    j = anchors(t, before={"l": side})
    hole = F.col("frame") - F.col("l.frame") - 1
    ux, uy, wx, wy = F.col("l.vx"), F.col("l.vy"), F.col("next_x"), F.col("next_y")
    ok = hole.between(least, most) & (F.col("segment") == F.col("l.segment")) & (F.least(F.col("y"), F.col("l.y")) <= top) & (uy <= -rise) & (wy >= rise) & (F.sqrt(ux * ux + uy * uy) >= speed) & (F.sqrt(wx * wx + wy * wy) >= speed) & ~((ux * wx < 0) & (F.abs(ux) >= across) & (F.abs(wx) >= across))
    b = j.where(ok).select("match_id", "l", F.struct("frame", "x", "y").alias("r"), F.explode(F.sequence(F.col("l.frame") + 1, F.col("frame") - 1)).alias("frame"))
    s = (F.col("frame") - F.col("l.frame")) / (F.col("r.frame") - F.col("l.frame"))
    return b.select("match_id", "frame", *[(F.col(f"l.{c}") + s * (F.col(f"r.{c}") - F.col(f"l.{c}"))).alias(c) for c in "xy"])
