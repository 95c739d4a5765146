"""Shots, movement and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlane.functions import geometry as G
from courtlane.operators.sequence import anchors, around, at_offsets, runs
from courtlane.session import join_small, staged


def summary(track: DataFrame, info: DataFrame) -> DataFrame:
    """Per match: frames, seconds, hits, rallies, visible and real share (the real share ignores visibility), largest and mean shot speed of hit rows."""
    hit_speed = F.when(F.col("hit") & (F.col("speed") >= 0), F.col("speed"))
    g = track.groupBy("match_id").agg(
        F.count("*").alias("frame_count"), F.count_if("hit").alias("hit_count"), F.count_distinct(F.when(F.col("rally") > 0, F.col("rally"))).alias("rally_count"),
        F.avg(F.col("vis").cast("int")).alias("visible_coverage"), F.avg(F.col("source").isin("model", "classical").cast("int")).alias("real_coverage"), F.max(hit_speed).alias("max_speed_kmh"), F.avg(hit_speed).alias("avg_speed_kmh"),
    )
    return join_small(g, info.select("match_id", "fps"), ["match_id"], "inner").withColumn("duration_seconds", F.col("frame_count") / F.greatest(F.lit(1.0), "fps")).drop("fps")


def coverage(track: DataFrame, real: tuple[str, ...], derived: tuple[str, ...]) -> DataFrame:
    """Shares of visible, measured and derived frames; each asks for visibility."""
    share = lambda e: F.avg(e.cast("int"))
    return track.groupBy("match_id").agg(share(F.col("vis")).alias("total"), share(F.col("vis") & F.col("source").isin(*real)).alias("real"), share(F.col("vis") & F.col("source").isin(*derived)).alias("derived"))


def rally_segments(track: DataFrame, info: DataFrame, before: float = 0.8, after: float = 1.0, least: float = 1.5) -> DataFrame:
    """Padded clips per positive rally id: from its first hit (else its first frame) to its last frame, clips under ``least`` seconds dropped, overlapping neighbours
    parted in the middle. A window over the clips of a match: few, whatever its length."""
    g = track.where("rally > 0").groupBy("match_id", "rally").agg(F.min("frame").alias("t0"), F.max("frame").alias("end_frame"), F.min(F.when(F.col("hit"), F.col("frame"))).alias("h0"), F.count_if("hit").alias("hit_count"))
    g = join_small(g, info.select("match_id", "fps"), ["match_id"], "inner").withColumns({"rate": F.greatest(F.lit(1.0), "fps"), "start_frame": F.coalesce("h0", "t0")})
    g = g.withColumns({"s": F.greatest(F.lit(0.0), F.col("start_frame") / F.col("rate") - before), "e": (F.col("end_frame") + 1) / F.col("rate") + after}).where(F.col("e") - F.col("s") >= least)
    w = Window.partitionBy("match_id").orderBy("t0", "rally")
    part = lambda a, b: F.when(a > b, (a + b) / 2)
    start = F.coalesce(part(F.lag("e").over(w), F.col("s")), F.col("s"))
    end = F.coalesce(part(F.col("e"), F.lead("s").over(w)), F.col("e"))
    quality = F.when(F.col("hit_count") >= 2, "hit_anchored").when(F.col("hit_count") == 1, "single_hit").otherwise("trajectory_fallback")
    return g.select("match_id", F.row_number().over(w).cast("long").alias("segment_index"), "rally", "start_frame", "end_frame", start.alias("start_seconds"), end.alias("end_seconds"), "hit_count", quality.alias("quality"), F.when(F.col("h0").isNotNull(), "first_hit").otherwise("first_trajectory").alias("start_reason"))


def hitter_balance(hits: DataFrame) -> DataFrame:
    """Hits of either side per rally, and whether they differ by more than one."""
    side = lambda s: F.count_if(F.col("hitter") == s)
    g = hits.where("rally > 0").groupBy("match_id", "rally").agg(side("near").alias("near_count"), side("far").alias("far_count"), F.count("*").alias("n"))
    return g.select("match_id", "rally", "near_count", "far_count", (F.col("n") - F.col("near_count") - F.col("far_count")).alias("unknown_count"), F.abs(F.col("near_count") - F.col("far_count")).alias("difference"), (F.abs(F.col("near_count") - F.col("far_count")) <= 1).alias("within_one"), (F.col("n") == F.col("near_count") + F.col("far_count")).alias("complete"))


def shot_speeds(track: DataFrame, hits: DataFrame, info: DataFrame, measured: tuple[str, ...], real: tuple[str, ...], margin: float = 6.0, least_cover: float = 0.55, most_step: float = 160.0, most_avg: float = 55.0) -> DataFrame:
    """Average speed of the flight between neighbouring hits of a match: match_id, start_frame, end_frame, distance_m, observed_seconds, coverage, real_points, segments, speed_kmh, quality.

    Only steps between measured points on neighbouring frames count, projected to the court and within its margin. A step faster than ``most_step`` is not counted and
    hides its point from the next step; so of a run of such steps every second one is judged afresh.
    """
    x, y = G.project("x", "y")
    shots = anchors(hits.select("match_id", "frame").distinct(), after={"end_frame": F.col("frame")}).where("end_frame is not null")
    t = join_small(track.select("match_id", "frame", "vis", "x", "y", "source"), info, ["match_id"], "inner")
    mx, my = F.expr(x), F.expr(y)
    ok = F.col("vis") & F.col("source").isin(*measured) & mx.between(-margin, G.COURT_W + margin) & my.between(-margin, G.COURT_L + margin)
    t = t.select("match_id", "frame", F.when(ok, mx).alias("mx"), F.when(ok, my).alias("my"), (ok & F.col("source").isin(*real)).alias("real"), F.greatest("fps", F.lit(1e-6)).alias("fps"))
    t = staged(at_offsets(t, ["mx", "my"], [-1]), "steps")
    marks = shots.select("match_id", "frame", F.struct(F.col("frame").alias("a"), F.col("end_frame").alias("b")).alias("shot"))
    j = anchors(t.join(marks, ["match_id", "frame"], "left"), before={"s": F.col("shot")}).where(F.col("s").isNotNull() & (F.col("frame") <= F.col("s.b")))
    step = F.sqrt((F.col("mx") - F.col("mx_m1")) ** 2 + (F.col("my") - F.col("my_m1")) ** 2)
    j = j.select("match_id", "frame", "fps", F.coalesce("real", F.lit(False)).alias("real"), F.col("s.a").alias("start_frame"), F.col("s.b").alias("end_frame"), step.alias("step"), F.coalesce(step * F.col("fps") > most_step, F.lit(False)).alias("fast"))
    j = staged(j, "shots")
    fast = runs(j.select("match_id", "frame", "start_frame", "fast").where("fast"), F.lit(True)).select("match_id", "frame", ((F.col("frame") - F.greatest(F.col("run"), F.col("start_frame") + 1)) % 2 == 0).alias("rejected"))
    j = j.join(fast, ["match_id", "frame"], "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))
    j = at_offsets(j.withColumn("rej", F.when(F.col("rejected"), F.col("start_frame"))), ["rej"], [-1])
    counted = F.col("step").isNotNull() & ~F.col("fast") & ~F.coalesce(F.col("rej_m1") == F.col("start_frame"), F.lit(False))
    g = j.groupBy("match_id", "start_frame", "end_frame").agg(F.max("fps").alias("fps"), F.coalesce(F.sum(F.when(counted, F.col("step"))), F.lit(0.0)).alias("distance_m"), F.count(F.when(counted, 1)).alias("segments"), F.count(F.when(F.col("real"), 1)).alias("rp"))
    first = t.where("real").select("match_id", F.col("frame").alias("start_frame"), F.lit(1).alias("r0"))
    g = g.join(first, ["match_id", "start_frame"], "left").withColumns({"real_points": F.col("rp") + F.coalesce("r0", F.lit(0)), "observed_seconds": F.col("segments") / F.col("fps")})
    g = g.withColumn("coverage", F.col("observed_seconds") / F.greatest((F.col("end_frame") - F.col("start_frame")) / F.col("fps"), F.lit(1e-6)))
    speed = F.when(F.col("segments") > 0, F.col("distance_m") / F.col("observed_seconds"))
    quality = F.when(F.col("real_points") < 2, "insufficient_real_points").when(F.col("segments") < 3, "insufficient_segments").when(F.col("coverage") < least_cover, "insufficient_coverage").when(speed <= most_avg, "ok").otherwise("average_speed_outlier")
    return g.select("match_id", "start_frame", "end_frame", "distance_m", "observed_seconds", "coverage", "real_points", "segments", F.when(quality == "ok", speed * 3.6).alias("speed_kmh"), quality.alias("quality"))


def motion(points: DataFrame, fps: Column) -> DataFrame:
    """Movement of a player: match_id, side, distance_m, seconds, max_speed. Steps of more than 8 m/s (and 5 cm) are not counted, but their point is the next start.

    ``points`` has match_id, side, frame, mx, my (null where unseen) and what ``fps`` needs.
    """
    p = points.where("mx is not null and my is not null").withColumn("fps", F.greatest(fps, F.lit(1e-6)))
    p = anchors(p, before={"p": F.struct("frame", "mx", "my")}, by="side")
    dt = (F.col("frame") - F.col("p.frame")) / F.col("fps")
    d = F.sqrt((F.col("mx") - F.col("p.mx")) ** 2 + (F.col("my") - F.col("p.my")) ** 2)
    ok = d <= 8 * dt + 0.05
    return p.groupBy("match_id", "side").agg(F.coalesce(F.sum(F.when(ok, d)), F.lit(0.0)).alias("distance_m"), F.coalesce(F.sum(F.when(ok, dt)), F.lit(0.0)).alias("seconds"), F.coalesce(F.max(F.when(ok, d / F.greatest(dt, F.lit(1e-6)))), F.lit(0.0)).alias("max_speed"))


def heatmap(points: DataFrame, cell: float = 0.20, most: float = 12.0) -> DataFrame:
    """Occupancy of court cells by time: match_id, side, row, col, weight; a sample weighs the frames since the last one, at most ``most``."""
    cols, rows_ = -int(-G.COURT_W // cell), -int(-G.COURT_L // cell)
    p = anchors(points.where("mx is not null and my is not null"), before={"pf": F.col("frame")}, by="side")
    at = lambda v, size, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.col(v) / size * n)))
    return p.select("match_id", "side", at("my", G.COURT_L, rows_).cast("long").alias("row"), at("mx", G.COURT_W, cols).cast("long").alias("col"), F.least(F.lit(most), F.coalesce((F.col("frame") - F.col("pf")).cast("double"), F.lit(1.0))).alias("w")).groupBy("match_id", "side", "row", "col").agg(F.sum("w").alias("weight"))


def trajectory_metrics(track: DataFrame, shots: DataFrame, info: DataFrame) -> DataFrame:
    """Per shot: real_points, flight_seconds, and arc, the largest distance in y from the chord by the court's height in pixels: match_id, start_frame, end_frame."""
    m = track.where(F.col("vis") & F.col("source").isin("model", "classical")).select("match_id", "frame", F.col("y"))
    marks = shots.select("match_id", F.col("start_frame").alias("frame"), F.struct(F.col("start_frame").alias("a"), F.col("end_frame").alias("b")).alias("shot"))
    j = anchors(m.join(marks, ["match_id", "frame"], "full_outer"), before={"s": F.col("shot")}, own=True).where(F.col("y").isNotNull() & (F.col("frame") < F.col("s.b")))
    ends = m.join(shots.select("match_id", F.col("end_frame").alias("frame"), F.struct(F.col("start_frame").alias("a"), F.col("end_frame").alias("b")).alias("s")), ["match_id", "frame"])
    j = j.select("match_id", "frame", "y", "s").unionByName(ends.select("match_id", "frame", "y", "s"))
    w = F.struct("frame", "y")
    g = j.groupBy("match_id", "s").agg(F.count("*").alias("real_points"), F.min_by(w, "frame").alias("p0"), F.max_by(w, "frame").alias("p1"))
    k = join_small(j.join(g, ["match_id", "s"]), info.select("match_id", "fps", (F.greatest(F.col("q5"), F.col("q7")) - F.least(F.col("q1"), F.col("q3"))).alias("tall")), ["match_id"], "inner")
    off = F.abs(F.col("y") - F.col("p0.y") - (F.col("frame") - F.col("p0.frame")) / (F.col("p1.frame") - F.col("p0.frame")) * (F.col("p1.y") - F.col("p0.y"))) / F.col("tall")
    inner = (F.col("frame") > F.col("p0.frame")) & (F.col("frame") < F.col("p1.frame")) & (F.col("real_points") >= 4) & (F.col("tall") > 1)
    return k.groupBy("match_id", F.col("s.a").alias("start_frame"), F.col("s.b").alias("end_frame")).agg(F.max("real_points").alias("real_points"), F.max((F.col("p1.frame") - F.col("p0.frame")) / F.greatest("fps", F.lit(1.0))).alias("flight_seconds"), F.coalesce(F.max(F.when(inner, off)), F.lit(0.0)).alias("arc"))


def centre_shift(track: DataFrame, info: DataFrame, least: int = 50) -> DataFrame:
    """How far the median of the ball's court x lies off the middle, held within a quarter of the width; 0 for fewer than ``least`` points: match_id, shift_m.

    Points are every k-th frame so that a match gives about 2000. The sample is bounded, so an exact median of it is cheap.
    """
    n = track.groupBy("match_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 2000)).alias("step"))
    t = join_small(join_small(track.where("vis"), n, ["match_id"], "inner"), info, ["match_id"], "inner").where("frame % step = 0")
    x, y = G.project("x", "y")
    cx, cy = F.expr(G.clip(x, 0, G.COURT_W)), F.expr(G.clip(y, 0, G.COURT_L))
    g = t.select("match_id", cx.alias("cx"), cy.alias("cy")).where(f"cy between 0.05 and {G.COURT_L - 0.05}").groupBy("match_id").agg(F.count("*").alias("n"), F.percentile("cx", F.lit(0.5)).alias("med"))
    return g.select("match_id", F.when(F.col("n") >= least, F.least(F.lit(G.COURT_W / 4), F.greatest(F.lit(-G.COURT_W / 4), G.COURT_W / 2 - F.col("med")))).otherwise(0.0).alias("shift_m"))


def stable_windows(track: DataFrame, spread: float = 12.0) -> DataFrame:
    """Three frames in a row whose points lie within ``spread`` px of each other, confident (0.35 each, 0.55 on average): match_id, frame, x, y, spread_px, conf."""
    t = track.where("vis").select("match_id", "frame", "x", "y", "conf")
    t = at_offsets(t, ["x", "y", "conf"], [1, 2])
    d = lambda a, b: F.sqrt((F.col(f"x{a}") - F.col(f"x{b}")) ** 2 + (F.col(f"y{a}") - F.col(f"y{b}")) ** 2)
    far = F.greatest(d("", "_p1"), d("", "_p2"), d("_p1", "_p2"))
    mean = (F.col("conf") + F.col("conf_p1") + F.col("conf_p2")) / 3
    mid = lambda c: F.col(c) + F.col(f"{c}_p1") + F.col(f"{c}_p2") - F.greatest(c, f"{c}_p1", f"{c}_p2") - F.least(c, f"{c}_p1", f"{c}_p2")
    return t.where(F.col("x_p1").isNotNull() & F.col("x_p2").isNotNull() & (far <= spread) & (F.least("conf", "conf_p1", "conf_p2") >= 0.35) & (mean >= 0.55)).select("match_id", "frame", mid("x").alias("x"), mid("y").alias("y"), far.alias("spread_px"), mean.alias("conf"))


def robust_z(series: DataFrame, value: str, radius: int = 100, guard: int = 5, floor: float = 0.04) -> DataFrame:
    """Local z of ``value`` by the median and MAD of the rows ``guard`` + 1 to ``radius`` frames away on either side: match_id, frame, z. At the ends the context is what there is."""
    far = F.struct("frame", value)
    t = around(series.select("match_id", "frame", F.col(value)), {"ctx": (F.collect_list(far), -radius, radius)})
    ctx = F.transform(F.filter("ctx", lambda s: F.abs(s["frame"] - F.col("frame")) > guard), lambda s: s[value])
    t = t.withColumn("ctx", F.array_sort(ctx))
    t = t.withColumn("med", F.expr("(ctx[cast(floor((size(ctx) - 1) / 2) as int)] + ctx[cast(floor(size(ctx) / 2) as int)]) / 2")).withColumn("dev", F.array_sort(F.transform("ctx", lambda v: F.abs(v - F.col("med")))))
    mad = F.expr("(dev[cast(floor((size(dev) - 1) / 2) as int)] + dev[cast(floor(size(dev) / 2) as int)]) / 2")
    return t.where("size(ctx) > 0").select("match_id", "frame", ((F.col(value) - F.col("med")) / (1.4826 * mad + floor)).alias("z"))


def spline(track: DataFrame, steps: int = 12) -> DataFrame:
    """Catmull-Rom points of every trail (consecutive visible frames): match_id, frame, step, x, y; ``steps`` for each segment and one for a trail's last point."""
    t = at_offsets(track.where("vis").select("match_id", "frame", "x", "y"), ["x", "y"], [-1, 1, 2])
    t = t.withColumn("step", F.explode(F.sequence(F.lit(0), F.when(F.col("x_p1").isNull(), 0).otherwise(steps - 1)))).withColumn("t", F.col("step") / steps)
    for c in "xy":
        p0, p1, p2 = F.coalesce(f"{c}_m1", c), F.col(c), F.coalesce(f"{c}_p1", c)
        p3 = F.coalesce(F.when(F.col(f"{c}_p1").isNotNull(), F.col(f"{c}_p2")), f"{c}_p1", c)
        t = t.withColumn(f"{c}_t", 0.5 * (2 * p1 + (p2 - p0) * F.col("t") + (2 * p0 - 5 * p1 + 4 * p2 - p3) * F.col("t") ** 2 + (3 * p1 - p0 - 3 * p2 + p3) * F.col("t") ** 3))
    return t.select("match_id", "frame", F.col("step").cast("long").alias("step"), F.col("x_t").alias("x"), F.col("y_t").alias("y"))
