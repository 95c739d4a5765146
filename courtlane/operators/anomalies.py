"""Implausible spikes, stuck values and impossible readings in frame-indexed measurements (problem 1).

Each reading is judged against its own source: the residual to what the flight around it lets expect (the season of this series is the
flight itself) and the distance of its confidence from the source's median. Above a high quantile the residuals of a source get a
generalised Pareto tail (peaks over threshold), and the cutoff is where that tail leaves a fixed risk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlane.session import join_small, staged


@dataclass(frozen=True)
class SpikeParams:
    """risk: share of a source's sound readings that the tail cutoff may flag. tail_from, tail_to: quantiles between which the tail is
    fitted; what lies above tail_to counts as censored, so that the spikes themselves don't shape it. shape_most: bound of the tail's
    shape, as the fit looks far beyond its data. min_rows: a source leans on its own fit by n / (2 min_rows), from twice as many residuals on alone; the rest of the
    weight is the usual cut of all sources in upper quartiles (plain_factor of them where no source has enough), so nothing jumps at a number of rows. stuck: frames of an unchanged reading. unit_width: residuals are in
    pixels of a picture of that width. block_bits, halo: frames of one task's block (a power of two) and of the overlap of blocks."""

    risk: float = 1e-6
    tail_from: float = 0.90
    tail_to: float = 0.95
    shape_most: float = 0.1
    min_rows: int = 300
    plain_factor: float = 10.0
    one_sided_factor: float = 3.0
    stuck: int = 10
    unit_width: float = 1280.0
    block_bits: int = 12
    halo: int = 16


#: Log bins of residuals and linear bins of confidences in the histograms that the tails are fitted to.
_LOG_STEP, _LOG_ZERO, _CONF_STEP = 0.06, 0.05, 0.001


def gpd_cut(values: np.ndarray, counts: np.ndarray, risk: float, q_from: float, q_to: float, shape_most: float) -> float:
    """The value that a generalised Pareto tail over quantile ``q_from`` exceeds with probability ``risk``.

    ``values`` ascending with their ``counts``. The fit is repeated without the values beyond its own cut until the cut rests, so that a
    source with many spikes isn't judged by them.
    """
    cut = np.inf
    for _ in range(8):
        keep = values <= cut
        now = min(cut, _tail_cut(values[keep], counts[keep], risk, q_from, q_to, shape_most))
        if now == cut:
            break
        cut = now
    return cut


def _tail_cut(values: np.ndarray, counts: np.ndarray, risk: float, q_from: float, q_to: float, shape_most: float) -> float:
    """One fit: the likelihood is over the excesses between the two quantiles, and each value above ``q_to`` adds only that it lies above.
    Shapes from 0 (exponential) to ``shape_most`` are tried, scales from a third to three times the mean excess."""
    total = counts.sum()
    share = np.cumsum(counts) / total
    u, c = values[np.searchsorted(share, q_from)], values[min(np.searchsorted(share, q_to), len(values) - 1)]
    inside = (values > u) & (values <= c)
    y, n, above = values[inside] - u, counts[inside], counts[values > c].sum()
    if not n.sum():
        return float(c)
    shape = np.maximum(np.linspace(0, shape_most, 21), 1e-9)[:, None, None]
    scale = (((y * n).sum() + above * (c - u)) / n.sum() * np.geomspace(1 / 3, 3, 61))[None, :, None]
    log_survival = lambda excess: -np.log1p(shape * excess / scale) / shape
    like = ((log_survival(y[None, None, :]) * (1 + shape) - np.log(scale)) * n).sum(-1) + above * log_survival(np.array([[[c - u]]]))[..., 0]
    a, b = np.unravel_index(np.argmax(like), like.shape)
    xi, sigma, over = float(shape[a, 0, 0]), float(scale[0, b, 0]), (n.sum() + above) / total
    return float(u + sigma * np.expm1(xi * np.log(over / risk)) / xi) if risk < over else float(c)


def _quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    return float(values[np.searchsorted(np.cumsum(counts), q * counts.sum())])


def _fits(p: SpikeParams):
    """Per source and kind of distance (two, one, low, high): n, its upper quartile (scale), the tail's cut, and for one the 90 % quantile by that of two (ratio)."""

    def fit(source: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        rows = []

        def add(kind: str, values: np.ndarray, counts: np.ndarray, mid: float = 0.0, ratio: float = 0.0) -> None:
            if counts.sum():
                rows.append((source[0], kind, counts.sum(), _quantile(values, counts, 0.75), gpd_cut(values, counts, p.risk, p.tail_from, p.tail_to, p.shape_most), mid, ratio))

        of = lambda kind: bins[bins["kind"] == kind].sort_values("bin")
        two, one, conf = of("two"), of("one"), of("conf")
        log = lambda b: np.exp((b["bin"].to_numpy() + 0.5) * _LOG_STEP) - _LOG_ZERO
        count = lambda b: b["n"].to_numpy(dtype=float)
        if len(two):
            enough = count(one).sum() >= p.min_rows / 5
            add("two", log(two), count(two), ratio=_quantile(log(one), count(one), p.tail_from) / _quantile(log(two), count(two), p.tail_from) if enough else 0.0)
        if len(conf):
            v, n = conf["bin"].to_numpy() * _CONF_STEP, count(conf)
            mid = _quantile(v, n, 0.5)
            for kind, sign in (("low", -1), ("high", 1)):
                side = sign * (v - mid) >= 0
                add(kind, np.abs(v - mid)[side][::sign], n[side][::sign], mid)
        return pd.DataFrame(rows, columns=["source", "kind", "n", "scale", "cut", "mid", "ratio"])

    return fit


def _line(nodes: list[int], at: int, c: str) -> Column:
    """The polynomial through the readings of axis ``c`` at the relative frames ``nodes``, at frame ``at``."""
    terms = [F.lit(float(np.prod([(at - m) / (n - m) for m in nodes if m != n]))) * F.col(f"{c}{n}") for n in nodes]
    return sum(terms[1:], terms[0])


def judged_readings(sidecar: DataFrame, info: DataFrame, p: SpikeParams = SpikeParams()) -> DataFrame:
    """One row per visible frame (match_id, frame, source, confidence) with its residual and flags, not yet cut.

    Matches are split into blocks of frames that overlap by ``halo`` frames, so no task holds a whole match.
    """
    size = info.select("match_id", "width", "height")
    named = F.coalesce(*[F.when(F.trim(c) != "", F.lower(F.trim(c))) for c in ("source", "rawsource")], F.lit("unknown"))
    r = sidecar.where("visibility = 1 and frame is not null and match_id is not null").select("match_id", "frame", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "confidence", named.alias("source"))
    r = join_small(r, size, ["match_id"])
    inside = lambda c, most: (F.col(c) >= 0) & F.coalesce(F.col(c) < F.col(most), F.lit(True))
    r = r.withColumn("impossible", ~F.coalesce(inside("x", "width") & inside("y", "height"), F.lit(True)) | F.coalesce(~F.col("confidence").between(0, 1) | F.isnan("confidence"), F.lit(False)))
    unit = F.coalesce(F.when(F.col("width") > 0, F.col("width")), F.lit(p.unit_width)) / p.unit_width
    r = r.withColumns({"unit": unit, "home": F.shiftright("frame", p.block_bits)}).drop("width", "height")
    r = r.withColumn("block", F.explode(F.array_distinct(F.array(F.shiftright(F.col("frame") - p.halo, p.block_bits), "home", F.shiftright(F.col("frame") + p.halo, p.block_bits)))))

    w = Window.partitionBy("match_id", "block").orderBy("frame")
    ties = Window.partitionBy("match_id", "block").orderBy("frame", F.desc("impossible"), "source", "x", "y", "confidence")
    r = r.withColumn("seen", F.lag("frame").over(ties)).where("seen is null or seen != frame").drop("seen")
    near = {k: (F.lag if k < 0 else F.lead)("frame", abs(k)).over(w) == F.col("frame") + k for k in (-3, -2, -1, 1, 2, 3)}
    cols = {f"{c}{k}": F.when(ok, (F.lag if k < 0 else F.lead)(c, abs(k)).over(w)) for k, ok in near.items() for c in "xy"}
    r = r.withColumns(cols | {"source-1": F.when(near[-1], F.lag("source").over(w)), "confidence-1": F.when(near[-1], F.lag("confidence").over(w))})

    # Residuals of an axis to the line and the parabola through the frames before, and after, and to the cubic around; the frame is as odd
    # as its best explanation says, so that a hit, where one side explains it, isn't odd. pair_a, pair_b: as the first and second of two odd
    # frames, which aren't odd if they lie on one line with the frame before or after them (bend: how far three frames are off a line).
    off = lambda c, nodes: F.abs(F.col(c) - _line(nodes, 0, c))
    axis = {}
    for c in "xy":
        left, right = F.least(off(c, [-1, -2]), off(c, [-1, -2, -3])), F.least(off(c, [1, 2]), off(c, [1, 2, 3]))
        axis |= {f"l{c}": off(c, [-1, -2]), f"r{c}": off(c, [1, 2]), f"s{c}": F.least(left, right, off(c, [-2, -1, 1, 2])), f"a{c}": F.least(left, off(c, [-2, -1, 2, 3])), f"b{c}": F.least(right, off(c, [-3, -2, 1, 2])), f"d{c}": 2 * off(c, [-1, 1])}
    r = r.withColumns(axis)
    sides = F.col("lx").isNotNull().cast("int") + F.col("rx").isNotNull().cast("int")
    r = r.withColumns({
        "sides": sides, "single": F.greatest("sx", "sy"), "pair_a": F.when(F.col("lx").isNotNull(), F.least(F.greatest("ax", "ay"), F.greatest("dx", "dy"))), "pair_b": F.when(F.col("rx").isNotNull(), F.least(F.greatest("bx", "by"), F.greatest("dx", "dy"))),
        "linked": F.col("source-1").eqNullSafe(F.col("source")), "same_xy": F.col("source-1").eqNullSafe(F.col("source")) & F.coalesce((F.col("x") == F.col("x-1")) & (F.col("y") == F.col("y-1")), F.lit(False)),
        "same_conf": F.col("source-1").eqNullSafe(F.col("source")) & F.coalesce(F.col("confidence") == F.col("confidence-1"), F.lit(False)),
    }).select("match_id", "block", "home", "frame", "source", "confidence", "impossible", "unit", "sides", "single", "pair_a", "pair_b", "linked", "same_xy", "same_conf")
    near1, near_1 = F.lead("frame").over(w) == F.col("frame") + 1, F.lag("frame").over(w) == F.col("frame") - 1
    both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
    full = p.stuck - 1
    r = r.withColumns({
        "pair": F.greatest(F.when(near1, both(F.col("pair_a"), F.lead("pair_b").over(w))), F.when(near_1, both(F.lag("pair_a").over(w), F.col("pair_b")))),
        **{f"run_{k}": F.sum(F.col(f"same_{k}").cast("int")).over(w.rowsBetween(1 - full, 0)) for k in ("xy", "conf")},
    })
    r = r.withColumns({f"stuck_{k}": F.coalesce(F.max(f"run_{k}").over(w.rowsBetween(0, full)) == full, F.lit(False)) for k in ("xy", "conf")})
    odd = F.when(F.col("sides") == 2, F.greatest("single", "pair")).when(F.col("sides") == 1, F.col("single")) / F.col("unit")
    return r.where("block = home").select("match_id", "frame", "source", "confidence", "impossible", "sides", odd.alias("residual"), "linked", "same_xy", "same_conf", "stuck_xy", "stuck_conf")


def source_limits(readings: DataFrame, p: SpikeParams = SpikeParams()) -> DataFrame:
    """Per source: cut_two and cut_one for residuals judged from both sides or one, conf_low, conf_high, and whether position and confidence
    otherwise vary. It aggregates histograms, so each fit gets a few hundred bins, whatever the source's number of rows."""
    tall = readings.where("not impossible").select("source", F.explode(F.array(
        F.struct(F.when(F.col("sides") == 2, "two").otherwise("one").alias("kind"), F.floor(F.log(F.col("residual") + _LOG_ZERO) / _LOG_STEP).alias("bin")),
        F.struct(F.lit("conf").alias("kind"), F.round(F.col("confidence") / _CONF_STEP).cast("long").alias("bin")),
    )).alias("b"))
    bins = tall.where("b.bin is not null").groupBy("source", F.col("b.kind").alias("kind"), F.col("b.bin").alias("bin")).agg(F.count("*").alias("n"))
    fits = staged(bins.groupBy("source").applyInPandas(_fits(p), "source string, kind string, n double, scale double, cut double, mid double, ratio double"), "fits")
    # what the tails of all sources together say about a small one: how many times its own upper quartile the cut lies
    least = F.when(F.col("kind") == "two", p.min_rows).otherwise(p.min_rows / 2)
    usual = {r.kind: r.times for r in fits.where((F.col("n") >= least) & (F.col("scale") > 0)).groupBy("kind").agg(F.percentile(F.col("cut") / F.col("scale"), F.lit(0.5)).alias("times")).collect()}
    times = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(t))) for k, t in usual.items()], F.when(F.col("kind") == "two", p.plain_factor), F.lit(p.plain_factor / 2))
    weight = F.least(F.lit(1.0), F.col("n") / (2 * least))
    cut = weight * F.col("cut") + (1 - weight) * times * F.col("scale")
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    far = F.greatest(cut, F.lit(2 * _CONF_STEP))
    cuts = fits.groupBy("source").agg(F.coalesce(of("two", cut), F.lit(float("inf"))).alias("cut_two"), F.coalesce(of("two", cut * F.greatest(F.col("ratio"), F.lit(p.one_sided_factor))), F.lit(float("inf"))).alias("cut_one"), F.coalesce(of("low", F.col("mid") - far), F.lit(float("-inf"))).alias("conf_low"), F.coalesce(of("high", F.col("mid") + far), F.lit(float("inf"))).alias("conf_high"))
    moved = lambda k: F.coalesce(F.avg(F.when(F.col("linked") & ~F.col(f"stuck_{k}"), (~F.col(f"same_{k}")).cast("int"))) >= 0.5, F.lit(False)).alias(f"varies_{k}")
    return cuts.join(readings.groupBy("source").agg(moved("xy"), moved("conf")), "source")


def implausible_readings(sidecar: DataFrame, info: DataFrame, p: SpikeParams = SpikeParams()) -> DataFrame:
    """Frames whose visible reading must be distrusted: match_id, frame, source, reasons (array of impossible, spike, confidence, stuck_position, stuck_confidence).

    Rows that aren't visible or have no match or frame are left out. A blank source is replaced by the raw source, else by "unknown". Repeated rows
    count once; of rows of one frame that contradict each other an impossible one stands for the frame, else the first by source, x, y and confidence.
    A null in x, y or confidence is no case. A match without width or height has no upper bounds. A reading without two neighbours on
    consecutive frames on either side has no residual. An empty table gives an empty result.
    """
    r = staged(judged_readings(sidecar, info, p), "readings")
    j = join_small(r, staged(source_limits(r, p), "limits"), ["source"])
    rules = {
        "impossible": F.col("impossible"),
        "spike": F.col("residual") > F.when(F.col("sides") == 2, F.col("cut_two")).otherwise(F.col("cut_one")),
        "confidence": (F.col("confidence") < F.col("conf_low")) | (F.col("confidence") > F.col("conf_high")),
        "stuck_position": F.col("stuck_xy") & F.col("varies_xy"),
        "stuck_confidence": F.col("stuck_conf") & F.col("varies_conf"),
    }
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return j.select("match_id", "frame", "source", reasons.alias("reasons")).where("size(reasons) > 0")
