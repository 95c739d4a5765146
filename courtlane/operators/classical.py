"""The classical ball pipeline over candidates: gates of components, which tracks are seeds, their extension, and one owner per frame (C21, C22, K8, K9, K18)."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlane.operators import kernels as K
from courtlane.operators import tracklets as T
from courtlane.session import staged

TRACK = T.TRACK


@dataclass(frozen=True)
class Options:
    """Limits of the pipeline, at their usual values: components (area, width, height, density, aspect), tracks through the strict gates (points, rank, quality, aspect,
    density, contrast, fill, p80 of acceleration and of turn, path by displacement), and short tracks that reach the top edge (edge_)."""

    area_least: int = 3
    area_most: int = 150
    side_least: int = 2
    side_most: int = 28
    density_least: float = 0.22
    aspect_least: float = 0.18
    points: int = 8
    rank: float = 4.45
    quality: float = 2.05
    aspect: float = 0.66
    density: float = 0.53
    contrast: float = 28.0
    fill: float = 0.62
    acceleration: float = 10.0
    turn: float = 36.0
    bend: float = 2.5
    edge_margin: float = 24.0
    edge_points: int = 5
    edge_quality: float = 3.0
    edge_aspect: float = 0.50
    edge_density: float = 0.48
    edge_contrast: float = 35.0
    edge_fill: float = 0.85
    edge_acceleration: float = 10.5
    edge_turn: float = 15.0
    edge_bend: float = 1.25
    overlap: float = 0.42


def options(base: Options | None = None, **changed: object) -> Options:
    """``base`` (the usual values) with some changed; an unknown name is a TypeError, and so is a base of another type (J3)."""
    base = base or Options()
    if not isinstance(base, Options):
        raise TypeError("base must be Options")
    unknown = sorted(set(changed) - {f.name for f in fields(Options)})
    if unknown:
        raise TypeError(f"unknown option(s): {', '.join(unknown)}")
    return replace(base, **changed)


def shape_candidates(components: DataFrame, o: Options = Options(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Components (match_id, frame, cand_id, x, y, width, height, area, motion, value, background) through the shape gates, with aspect, density, contrast and quality.

    motion and value are means over the component's pixels, background the median around it. A null measure fails its gate. ``keep`` names further columns to hand on.
    """
    short, long = F.least("width", "height"), F.greatest("width", "height")
    c = components.withColumns({"density": F.col("area") / (F.col("width") * F.col("height")), "aspect": short / long, "contrast": F.col("value") - F.col("background")})
    c = c.where(F.col("area").between(o.area_least, o.area_most) & (short >= o.side_least) & (long <= o.side_most) & (F.col("density") >= o.density_least) & (F.col("aspect") >= o.aspect_least))
    quality = 0.023 * F.col("motion") + 0.014 * F.greatest(F.lit(0.0), F.col("contrast")) + 0.0025 * F.col("value") + F.sqrt(F.greatest(F.lit(0.0), F.col("aspect") * F.col("density"))) - 0.004 * F.abs(F.col("area") - 45)
    return c.select("match_id", "frame", "cand_id", "x", "y", "area", "aspect", "density", "contrast", quality.alias("quality"), *keep)


def _seen(measure: str, least: float) -> Column:
    """An appearance measure that a detector doesn't give (null) isn't judged."""
    return F.coalesce(F.col(measure) >= least, F.lit(True))


def strict(m: DataFrame, o: Options = Options(), stop: Column | None = None) -> DataFrame:
    """Tracks through the strict gates; with ``stop`` those that end before it."""
    ok = (F.col("n") >= o.points) & (F.col("rank") >= o.rank) & (F.col("quality") >= o.quality) & _seen("aspect", o.aspect) & _seen("density", o.density) & _seen("contrast", o.contrast)
    ok = ok & (F.col("fill") >= o.fill) & (F.col("accel_p80") <= o.acceleration) & (F.col("turn_p80") <= o.turn) & (F.col("bend") <= o.bend)
    return m.where(ok if stop is None else ok & F.coalesce(F.col("end_frame") < stop, F.lit(True)))


def edge(m: DataFrame, o: Options = Options(), stop: Column | None = None) -> DataFrame:
    """Short, smooth tracks that reach the top edge of the picture (min_y); with ``stop`` those that end before it."""
    ok = (F.col("n") >= o.edge_points) & (F.col("min_y") <= o.edge_margin) & (F.col("quality") >= o.edge_quality) & _seen("aspect", o.edge_aspect) & _seen("density", o.edge_density) & _seen("contrast", o.edge_contrast)
    ok = ok & (F.col("fill") >= o.edge_fill) & (F.col("accel_p80") <= o.edge_acceleration) & (F.col("turn_p80") <= o.edge_turn) & (F.col("bend") <= o.edge_bend)
    return m.where(ok if stop is None else ok & F.coalesce(F.col("end_frame") < stop, F.lit(True)))


def confidence(rank: Column, quality: Column) -> Column:
    """K9: 0.52 to 0.96 from a track's rank and a point's quality."""
    share = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return F.least(F.lit(0.96), F.greatest(F.lit(0.52), 0.52 + 0.24 * share((rank - 4.45) / 1.35) + 0.20 * share((quality - 1.35) / 3.0)))


def owned_points(points: DataFrame, m: DataFrame) -> DataFrame:
    """K8: one point per frame, that of the highest ranked track (``m``: measures): match_id, frame, run, track, x, y, confidence."""
    owned = T.one_owner(points, m)
    return owned.select("match_id", "frame", "run", "track", "x", "y", confidence(F.col("rank"), F.col("quality")).alias("confidence"))


def endpoint_hits(points: DataFrame, m: DataFrame, least_y: Column | None = None, width: Column | None = None, height: Column | None = None, margin: float = 0.0) -> DataFrame:
    """K8: the last point of each track as a possible contact: match_id, run, track, frame, x, y, score, speed (of its last step). Not above ``least_y``, and with ``width`` and ``height``
    not within ``margin`` px of the picture's edge, where the flight merely leaves. ``m`` may carry what these need."""
    p = F.struct("frame", "x", "y", "quality")
    w = Window.partitionBy(*TRACK).orderBy(F.desc("frame"))
    last = points.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy(*TRACK).agg(F.max(F.when(F.col("k") == 1, p)).alias("z"), F.max(F.when(F.col("k") == 2, p)).alias("p")).where("p is not null")
    j = last.join(m, TRACK)
    ok = F.lit(True) if least_y is None else F.coalesce(F.col("z.y") >= least_y, F.lit(True))
    if width is not None and height is not None:
        ok = ok & (F.col("z.x") > margin) & (F.col("z.x") < width - 1.0 - margin) & (F.col("z.y") > margin) & (F.col("z.y") < height - 1.0 - margin)
    speed = F.sqrt((F.col("z.x") - F.col("p.x")) ** 2 + (F.col("z.y") - F.col("p.y")) ** 2) / F.greatest(F.lit(1), F.col("z.frame") - F.col("p.frame"))
    return j.where(ok).select(*TRACK, F.col("z.frame").alias("frame"), F.col("z.x").alias("x"), F.col("z.y").alias("y"), confidence(F.col("rank"), F.col("z.quality")).alias("score"), speed.alias("speed"))


def added_seeds(spans: DataFrame, overlap: float = 0.42) -> DataFrame:
    """Tracks kept in the order of pass and falling rank: each unless its span (start_frame, end_frame) overlaps a kept one's kept_start to kept_end by ``overlap`` of the shorter.
    Groups of overlapping spans are folded one by one; the window runs over tracks."""
    w = Window.partitionBy("match_id").orderBy("start_frame", "end_frame", "pass", "run", "track")
    reach = F.max("end_frame").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = spans.withColumn("o", F.when(reach.isNull() | (F.col("start_frame") > reach), 1).otherwise(0)).withColumn("g", F.sum("o").over(w))
    row = F.struct("pass", (-F.col("rank")).alias("k"), "run", "track", "start_frame", "end_frame", "kept_start", "kept_end")
    span = lambda a, z: z - a + 1
    hit = lambda a, x: F.least(a["kept_end"], x["end_frame"]) - F.greatest(a["kept_start"], x["start_frame"]) + 1 >= F.greatest(F.lit(1.0), overlap * F.least(span(a["kept_start"], a["kept_end"]), span(x["start_frame"], x["end_frame"])))
    kept = F.aggregate(F.array_sort(F.collect_list(row)), F.slice(F.collect_list(row), 1, 0), lambda acc, x: F.when(F.exists(acc, lambda a: hit(a, x)), acc).otherwise(F.array_append(acc, x)))
    return g.groupBy("match_id", "g").agg(kept.alias("kept")).select("match_id", F.explode("kept").alias("x")).select("match_id", "x.run", "x.track", "x.pass")


def _tracked(candidates: DataFrame, odd: int) -> DataFrame:
    """Points of greedy tracks; the tracks of the two passes have even and odd numbers."""
    t = K.greedy_tracks(candidates).withColumn("track", F.col("track") * 2 + odd)
    return staged(t.join(candidates, ["match_id", "frame", "cand_id"]).select(*TRACK, "frame", "cand_id", "x", "y", "quality", "aspect", "density", "contrast"), "points")


def pipeline(candidates: DataFrame, tops: DataFrame, o: Options = Options()) -> DataFrame:
    """match_id, frame, track_id, x, y, core: the ball by candidates (match_id, frame, cand_id, x, y, quality, area, aspect, density, contrast) and the upper edges of both regions per match (match_id, base_top, wide_top).

    Base and wide region are tracked apart. Seeds are the base tracks through the strict gates and span suppression, then wide ones that rise above the base region, then ones at the
    picture's edge, each trimmed and only if it overlaps no seed. Seeds are extended both ways over the wide region; a point of any seed beats a neighbour's extension. Each frame goes
    to one track by (core, rank, quality); tracks left with three points or more are measured again and numbered by start.
    """
    c = T.with_appearance(candidates).join(tops, ["match_id"])
    cols = ["match_id", "frame", "cand_id", "x", "y", "quality", "area", "aspect", "density", "contrast"]
    wide = staged(c.where("y >= wide_top").select(*cols, (F.col("y") >= F.col("base_top")).alias("low"), "base_top"), "candidates")
    tops = wide.groupBy("match_id").agg(F.max("base_top").alias("base_top"))
    pb, pw = _tracked(wide.where("low").select(*cols), 0), _tracked(wide.select(*cols), 1)
    base = T.span_suppression(strict(T.plausible(T.measures(pb)), o), o.overlap)
    mw = staged(T.plausible(T.measures(pw)).join(tops, ["match_id"]), "measures")
    high = T.span_suppression(strict(mw, o), o.overlap).join(mw.where("min_y < base_top").select(*TRACK), TRACK, "left_semi")
    trimmed = staged(T.trim_abrupt(pw.join(high.select(*TRACK).unionByName(edge(mw, o).select(*TRACK)).distinct(), TRACK, "left_semi")), "trimmed")
    mt = staged(T.plausible(T.measures(trimmed)).select(*TRACK, F.col("start_frame").alias("kept_start"), F.col("end_frame").alias("kept_end")), "measures")
    own = [*TRACK, "rank", "start_frame", "end_frame", "kept_start", "kept_end"]
    spans = base.withColumns({"kept_start": F.col("start_frame"), "kept_end": F.col("end_frame")}).select(*own, F.lit(0).alias("pass"))
    spans = spans.unionByName(high.join(mt, TRACK).withColumns({"start_frame": F.col("kept_start"), "end_frame": F.col("kept_end")}).select(*own, F.lit(1).alias("pass")))
    spans = spans.unionByName(edge(mw, o).join(mt, TRACK).select(*own, F.lit(2).alias("pass")))
    seeds = staged(added_seeds(spans, o.overlap).select(*TRACK), "seeds")
    core = staged(pb.unionByName(trimmed).join(seeds, TRACK, "left_semi"), "core")
    place = wide.select("match_id", "frame", "cand_id", "x", "y", "quality", "aspect", "density", "contrast")
    back = K.extensions(core, wide, forward=False).join(place, ["match_id", "frame", "cand_id"]).select(*core.columns)
    grown = staged(core.unionByName(back), "grown")
    ahead = K.extensions(grown, wide).join(place, ["match_id", "frame", "cand_id"]).select(*core.columns)
    free = back.unionByName(ahead).join(core.select("match_id", "frame").distinct(), ["match_id", "frame"], "left_anti").select(*core.columns)
    points = staged(core.withColumn("core", F.lit(True)).unionByName(free.withColumn("core", F.lit(False))), "expanded")
    w = Window.partitionBy("match_id", "frame").orderBy(F.desc("core"), F.desc("rank"), F.desc("quality"), "run", "track")
    owned = points.join(T.plausible(T.measures(points)).select(*TRACK, "rank"), TRACK).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "rank")
    owned = staged(owned, "owned")
    last = T.plausible(T.measures(owned))
    number = F.row_number().over(Window.partitionBy("match_id").orderBy("start_frame", "end_frame", F.desc("rank"), "run", "track")) - 1
    return owned.join(last.select(*TRACK, number.cast("long").alias("track_id")), TRACK).select("match_id", "frame", "track_id", "x", "y", "core")
