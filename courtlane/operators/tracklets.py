"""Measures, gates and selection of candidate tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRACK = ["match_id", "run", "track"]


APPEARANCE = ("aspect", "density", "contrast")


def with_appearance(df: DataFrame) -> DataFrame:
    """``df`` with those of aspect, density and contrast that it lacks as nulls."""
    return df.withColumns({c: F.lit(None).cast("double") for c in APPEARANCE if c not in df.columns})


def measures(points: DataFrame) -> DataFrame:
    """Per track of three points or more: start_frame, end_frame, n, median_speed, spread, fill, quality, aspect, density, contrast (means), rank, accel_p80, turn_p80, bend (summed
    speeds by displacement), min_y. Points need match_id, run, track, frame, x, y, quality, aspect, density, contrast.

    A track is as long as an unbroken flight, so windows and exact percentiles over it are small.
    """
    w = Window.partitionBy(*TRACK).orderBy("frame")
    p = with_appearance(points).withColumns({"pf": F.lag("frame").over(w), "px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    p = p.withColumns({"vx": (F.col("x") - F.col("px")) / (F.col("frame") - F.col("pf")), "vy": (F.col("y") - F.col("py")) / (F.col("frame") - F.col("pf"))})
    p = p.withColumns({"wx": F.lag("vx").over(w), "wy": F.lag("vy").over(w), "v": F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)})
    pv = F.sqrt(F.col("wx") ** 2 + F.col("wy") ** 2)
    turn = F.when((F.col("v") > 1) & (pv > 1), F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col("vx") * F.col("wx") + F.col("vy") * F.col("wy")) / (F.col("v") * pv))))))
    accel = F.sqrt((F.col("vx") - F.col("wx")) ** 2 + (F.col("vy") - F.col("wy")) ** 2)
    end = lambda f, c: f(F.col(c), F.col("frame"))
    g = p.groupBy(*TRACK).agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n"), F.percentile("v", F.lit(0.5)).alias("median_speed"), (F.max("x") - F.min("x") + F.max("y") - F.min("y")).alias("spread"), F.min("y").alias("min_y"), *[F.avg(c).alias(c) for c in ("quality", *APPEARANCE)],
        F.coalesce(F.percentile(accel, F.lit(0.8)), F.lit(0.0)).alias("accel_p80"), F.coalesce(F.percentile(turn, F.lit(0.8)), F.lit(0.0)).alias("turn_p80"), F.sum("v").alias("path"), end(F.min_by, "x").alias("x0"), end(F.min_by, "y").alias("y0"), end(F.max_by, "x").alias("x1"), end(F.max_by, "y").alias("y1"),
    ).where("n >= 3")
    g = g.withColumn("fill", F.col("n") / F.greatest(F.lit(1), F.col("end_frame") - F.col("start_frame") + 1))
    rank = F.col("quality") + 0.05 * F.least(F.col("n"), F.lit(20)) + 0.01 * F.least(F.col("spread"), F.lit(100.0)) - 0.03 * F.abs(F.col("median_speed") - 12.0) + 0.3 * F.col("fill")
    bend = F.col("path") / F.greatest(F.lit(1.0), F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2))
    return g.select(*TRACK, "start_frame", "end_frame", "n", "median_speed", "spread", "fill", "quality", "aspect", "density", "contrast", rank.alias("rank"), "accel_p80", "turn_p80", bend.alias("bend"), "min_y")


def plausible(m: DataFrame) -> DataFrame:
    return m.where("median_speed between 2.5 and 90 and spread >= 25 and fill >= 0.55")


def trim_abrupt(points: DataFrame, most: float = 28.0, keep: int = 3) -> DataFrame:
    """Each track up to its first abrupt step after ``keep`` points: acceleration over ``most`` px, or a turn over 65 degrees at speeds over 10."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    p = points.withColumns({"k": F.row_number().over(w), "pf": F.lag("frame").over(w), "px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    p = p.withColumns({"vx": (F.col("x") - F.col("px")) / (F.col("frame") - F.col("pf")), "vy": (F.col("y") - F.col("py")) / (F.col("frame") - F.col("pf"))}).withColumns({"wx": F.lag("vx").over(w), "wy": F.lag("vy").over(w)})
    v, pv = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2), F.sqrt(F.col("wx") ** 2 + F.col("wy") ** 2)
    bad = (F.col("k") > keep) & ((F.sqrt((F.col("vx") - F.col("wx")) ** 2 + (F.col("vy") - F.col("wy")) ** 2) > most) | ((v > 10) & (pv > 10) & ((F.col("vx") * F.col("wx") + F.col("vy") * F.col("wy")) < F.cos(F.radians(F.lit(65.0))) * v * pv)))
    stop = F.min(F.when(bad, F.col("frame"))).over(Window.partitionBy(*TRACK))
    return p.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("frame") < F.col("stop"))).select(*points.columns)


def one_owner(points: DataFrame, ranks: DataFrame) -> DataFrame:
    """Of points of one match and frame the one whose track ranks highest (ties: earlier run, smaller track)."""
    w = Window.partitionBy("match_id", "frame").orderBy(F.desc("rank"), "run", "track")
    return points.join(ranks.select(*TRACK, "rank"), TRACK).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def span_suppression(m: DataFrame, overlap: float = 0.42) -> DataFrame:
    """Tracks by falling rank, each kept unless a kept one covers ``overlap`` of the shorter span. Groups of overlapping spans are folded one by one; as many tracks can overlap as
    a frame has candidates, and a group ends where no track goes on. The window runs over tracks, not frames."""
    w = Window.partitionBy("match_id").orderBy("start_frame", "end_frame", "run", "track")
    reach = F.max("end_frame").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = m.withColumn("o", F.when(reach.isNull() | (F.col("start_frame") > reach), 1).otherwise(0)).withColumn("g", F.sum("o").over(w))
    row = F.struct((-F.col("rank")).alias("k"), "run", "track", "start_frame", "end_frame")
    span = lambda a: a["end_frame"] - a["start_frame"] + 1
    hit = lambda a, x: F.least(a["end_frame"], x["end_frame"]) - F.greatest(a["start_frame"], x["start_frame"]) + 1 >= F.greatest(F.lit(1.0), overlap * F.least(span(a), span(x)))
    kept = F.aggregate(F.array_sort(F.collect_list(row)), F.slice(F.collect_list(row), 1, 0), lambda acc, x: F.when(F.exists(acc, lambda a: hit(a, x)), acc).otherwise(F.array_append(acc, x)))
    return g.groupBy("match_id", "g").agg(kept.alias("kept")).select("match_id", F.explode("kept").alias("x")).select("match_id", "x.run", "x.track", "x.start_frame", "x.end_frame", (-F.col("x.k")).alias("rank"))


def fused_candidates(strong: DataFrame, weak: DataFrame, radius: float = 8.0) -> DataFrame:
    """Strong candidates and those weak ones that lie further than ``radius`` px from every strong one of their frame: match_id, frame, cand_id, x, y."""
    cols = ("match_id", "frame", "cand_id", "x", "y")
    s = strong.select("match_id", "frame", F.col("x").alias("sx"), F.col("y").alias("sy"))
    w = weak.select(*cols)
    close = w.join(s, ["match_id", "frame"]).where((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2 <= radius * radius).select("match_id", "frame", "cand_id").distinct()
    return strong.select(*cols).unionByName(w.join(close, ["match_id", "frame", "cand_id"], "left_anti"))


def clusters(candidates: DataFrame, radius: float = 45.0) -> DataFrame:
    """Candidates of a frame merged greedily by falling quality: each joins the first cluster whose weighted centre is within ``radius`` px: match_id, frame, cluster, x, y, weight, n.

    A frame has a bounded number of candidates, so it is one small fold.
    """
    row = F.struct((-F.col("quality")).alias("k"), "cand_id", F.col("x").alias("x"), F.col("y").alias("y"))
    empty = F.array().cast("array<struct<x:double,y:double,w:double,n:int>>")
    near = lambda c, p: (c["x"] - p["x"]) ** 2 + (c["y"] - p["y"]) ** 2 <= radius * radius

    def add(acc, p):
        w = -p["k"]
        first = F.array_position(F.transform(acc, lambda c: near(c, p)), True)
        new = F.struct(p["x"].alias("x"), p["y"].alias("y"), w.alias("w"), F.lit(1).alias("n"))
        merged = F.transform(acc, lambda c, i: F.when(i + 1 == first, F.struct(((c["x"] * c["w"] + p["x"] * w) / (c["w"] + w)).alias("x"), ((c["y"] * c["w"] + p["y"] * w) / (c["w"] + w)).alias("y"), (c["w"] + w).alias("w"), (c["n"] + 1).alias("n"))).otherwise(c))
        return F.when(first > 0, merged).otherwise(F.array_append(acc, new))

    g = candidates.groupBy("match_id", "frame").agg(F.aggregate(F.array_sort(F.collect_list(row)), empty, add).alias("c"))
    return g.select("match_id", "frame", F.posexplode("c").alias("cluster", "r")).select("match_id", "frame", F.col("cluster").cast("long").alias("cluster"), "r.x", "r.y", F.col("r.w").alias("weight"), F.col("r.n").cast("long").alias("n"))


def stitched(points: DataFrame, most_gap: int = 18, bend: float = 28.0) -> DataFrame:
    """Pairs of neighbouring tracks of a match that are one flight: match_id, run, track, next_run, next_track, gap, error.

    Each end is a line through its last (first) three points; both lines must meet the other end within max(45, 6 gap) px (1.35 times that backwards), and their
    directions differ by ``bend`` degrees at most. The window runs over tracks.
    """
    w = Window.partitionBy(*TRACK).orderBy("frame")
    p = points.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(*TRACK))}).where("n >= 3")
    pick = lambda k: F.max(F.when(k, F.struct("frame", "x", "y")))
    g = p.groupBy(*TRACK).agg(pick(F.col("i") == 1).alias("a"), pick(F.col("i") == 3).alias("a2"), pick(F.col("i") == F.col("n")).alias("z"), pick(F.col("i") == F.col("n") - 2).alias("z2"))
    v = lambda p, q, c: (F.col(f"{p}.{c}") - F.col(f"{q}.{c}")) / (F.col(f"{p}.frame") - F.col(f"{q}.frame"))
    g = g.withColumns({"vx": v("z", "z2", "x"), "vy": v("z", "z2", "y"), "ux": v("a2", "a", "x"), "uy": v("a2", "a", "y")})
    m = Window.partitionBy("match_id").orderBy("a.frame", "z.frame", "run", "track")
    g = g.withColumn("b", F.lead(F.struct("run", "track", "a", "ux", "uy")).over(m))
    gap = F.col("b.a.frame") - F.col("z.frame")
    d = lambda c, own, vel, sign: F.col(f"{own}.{c}") + sign * gap * F.col(vel)
    ahead = F.sqrt((d("x", "z", "vx", 1) - F.col("b.a.x")) ** 2 + (d("y", "z", "vy", 1) - F.col("b.a.y")) ** 2)
    back = F.sqrt((d("x", "b.a", "b.ux", -1) - F.col("z.x")) ** 2 + (d("y", "b.a", "b.uy", -1) - F.col("z.y")) ** 2)
    gate = F.greatest(F.lit(45.0), 6.0 * gap)
    s = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2) * F.sqrt(F.col("b.ux") ** 2 + F.col("b.uy") ** 2)
    straight = (s < 1e-6) | ((F.col("vx") * F.col("b.ux") + F.col("vy") * F.col("b.uy")) >= F.cos(F.radians(F.lit(bend))) * s)
    ok = gap.between(1, most_gap) & (ahead <= gate) & (back <= 1.35 * gate) & straight
    return g.where(ok).select(*TRACK, F.col("b.run").alias("next_run"), F.col("b.track").alias("next_track"), gap.alias("gap"), ahead.alias("error"))
