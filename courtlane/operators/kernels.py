"""Operators that are truly sequential: one pass over the rows of a flight, in order, with a small state.

They run as streams over sorted partitions (mapInPandas): a group is never gathered, and groups are flights or runs, not matches, so a hot match
is spread over as many tasks as it has flights.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlane.operators.sequence import anchors, dense, runs


def scan(df: DataFrame, keys: list[str], order: list[str], columns: list[str], machine: Callable[[], object], schema: str, grow: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Rows of each key, in order, through a fresh ``machine()``: ``row(key, values)`` and ``end(key)`` give lists of result tuples. ``grow`` makes the rows out of those of ``df``
    behind the shuffle, so that it moves only what they are made of; it must keep the keys."""
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for part in parts:
            out = []
            of = lambda names: zip(*(part[c].tolist() for c in names))  # noqa: B023, E731
            for key, values in zip(of(keys), of(columns)):
                if key != at:
                    if state is not None:
                        out += state.end(at)
                    at, state = key, machine()
                out += state.row(key, values)
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(state.end(at), columns=names)

    return grow(df.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class Kalman:
    """Constant-velocity filter of one flight. The axes share one covariance (p, pv, v), as noise and start are the same for both."""

    def __init__(self, q: float = 700.0, r: float = 18.0, predict: int = 3):
        self.q, self.r2, self.predict, self.s = q, r * r, predict, None

    def _start(self, x: float, y: float, frame: int) -> None:
        self.s, self.p, self.last, self.warm = [x, y, 0.0, 0.0], [self.r2, 0.0, 250.0], frame, True

    def row(self, key, values):
        frame, x, y, source, conf, observed, reset = values
        if reset:
            self.s = None
        measured = x is not None and not math.isnan(x)
        if self.s is None:
            if not measured:
                return [(*key, frame, None, None, False, "missing", 0.0)]
            self._start(x, y, frame)
            return [(*key, frame, x, y, True, source, conf if observed else 0.55)]
        s, (a, b, c), q = self.s, self.p, self.q
        s[0], s[1] = s[0] + s[2], s[1] + s[3]
        a, b, c = a + 2 * b + c + q / 4, b + c + q / 2, c + q
        accepted = rejected = False
        again = False
        if measured:
            dx, dy, interp = x - s[0], y - s[1], source == "interp"
            if interp or math.hypot(dx, dy) <= max(180.0, 5.0 * math.sqrt(2 * a)):
                r = self.r2 * (4.0 if interp else 1.0)
                k1, k2 = a / (a + r), b / (a + r)
                s[0], s[1], s[2], s[3] = s[0] + k1 * dx, s[1] + k1 * dy, s[2] + k2 * dx, s[3] + k2 * dy
                a, b, c = (1 - k1) * a, (1 - k1) * b, c - k2 * b
                accepted, self.last = True, frame
            else:
                rejected, self.warm = True, True
        self.p = [a, b, c]
        if measured and not accepted and frame - self.last > self.predict:
            self._start(x, y, frame)
            s, accepted, again = self.s, True, True
        since = frame - self.last
        if accepted:
            if observed and not again:
                self.warm = False
            elif again:
                self.warm = True
            level = conf if source in ("model", "classical") else 0.28 if source in ("model_edge", "single_phase_edge") else 0.40 if source == "classical_gap" else 0.55
            return [(*key, frame, s[0], s[1], True, source, level)]
        if since <= self.predict and not self.warm and not rejected:
            return [(*key, frame, s[0], s[1], True, "kalman", max(0.15, 0.45 - 0.10 * since))]
        s[2], s[3] = s[2] * 0.35, s[3] * 0.35
        return [(*key, frame, None, None, False, "missing", 0.0)]

    def end(self, key):
        return []


#: Frames on either side of a camera cut on which the smoother starts anew in the CLI (K16).
CUT_PADDING = 3


def reset_frames(cuts: DataFrame, padding: int = CUT_PADDING) -> DataFrame:
    """match_id, frame: the frames around camera cuts (match_id, frame) on which the smoother starts anew."""
    return cuts.select("match_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("frame") - padding), F.col("frame") + padding)).alias("frame")).distinct()


_FILTER_IN = ["frame", "x", "y", "source", "conf", "observed", "reset"]


def _measured(track: DataFrame, measured: tuple[str, ...], resets: DataFrame | None) -> DataFrame:
    """Every frame from 0 to the match's last with its measurement (a visible point whose source is in ``measured``) and whether it is in ``resets``."""
    ok = F.col("vis") & F.col("source").isin(*measured)
    t = dense(track).join(track.where(ok).select("match_id", "frame", "x", "y", "source", "conf"), ["match_id", "frame"], "left")
    if resets is None:
        return t.withColumn("reset", F.lit(False))
    return t.join(resets.select("match_id", "frame", F.lit(True).alias("reset")).distinct(), ["match_id", "frame"], "left").withColumn("reset", F.coalesce("reset", F.lit(False)))


def _filtered(t: DataFrame) -> DataFrame:
    """The filter over rows of _FILTER_IN. It keeps its state over holes of any length, so only resets part the work: what lies between two of them is one stream."""
    t = anchors(t, before={"piece": F.when(F.col("reset"), F.col("frame"))}, own=True).withColumn("piece", F.coalesce("piece", F.lit(-1)))
    out = scan(t, ["match_id", "piece"], ["frame"], _FILTER_IN, Kalman, "match_id long, piece long, frame long, x double, y double, vis boolean, source string, conf double")
    return out.drop("piece")


def smooth(track: DataFrame, measured: tuple[str, ...], resets: DataFrame | None = None) -> DataFrame:
    """The filter alone over a track (match_id, frame, x, y, vis, source, conf), one row for every frame from 0 to the match's last: match_id, frame, x, y, vis, source, conf; missing where
    nothing is known. On each frame of ``resets`` (match_id, frame) it starts anew."""
    t = _measured(track, measured, resets)
    return _filtered(t.select("match_id", "frame", "x", "y", F.coalesce("source", F.lit("missing")).alias("source"), F.coalesce("conf", F.lit(0.0)).alias("conf"), (F.col("x").isNotNull() & (F.col("source") != "interp")).alias("observed"), "reset"))


def smoothed_track(track: DataFrame, measured: tuple[str, ...], longest: int = 8, resets: DataFrame | None = None, top: float = 35.0) -> DataFrame:
    """F3 whole: edge breaks, interpolation and the filter, columns as in ``smooth``.

    Holes of at most ``longest`` frames between measurements are interpolated; a hole that ends a flight over the top edge (see fusion.edge_breaks) is not, the filter starts anew on its
    first frame, as on every frame of ``resets``, and no hole that holds or ends in a reset is interpolated.
    """
    at, cut = F.when(F.col("x").isNotNull(), F.struct("frame", "x", "y")), F.when(F.col("reset"), F.col("frame"))
    t = anchors(_measured(track, measured, resets), before={"l": at, "cut_before": cut}, after={"r": at, "cut_after": cut}, own=True)
    gap, dy = F.col("r.frame") - F.col("l.frame") - 1, F.abs(F.col("r.y") - F.col("l.y"))
    left, right, hole = F.col("l.y") <= top, F.col("r.y") <= top, F.col("x").isNull()
    breaks = hole & F.coalesce((gap <= max(2, longest)) & ((dy >= 80) | (gap >= 2) & ((left | right) & (dy >= 70) | left & right)), F.lit(False))
    crossed = F.coalesce(F.col("cut_before") > F.col("l.frame"), F.lit(False)) | F.coalesce(F.col("cut_after") <= F.col("r.frame"), F.lit(False))
    fill = hole & F.coalesce(gap <= longest, F.lit(False)) & ~breaks & ~crossed
    a = (F.col("frame") - F.col("l.frame")) / (F.col("r.frame") - F.col("l.frame"))
    on = lambda c: F.when(fill, F.col(f"l.{c}") * (1 - a) + F.col(f"r.{c}") * a).otherwise(F.col(c)).alias(c)
    opens = F.col("reset") | breaks & (F.col("frame") == F.col("l.frame") + 1)
    return _filtered(t.select("match_id", "frame", on("x"), on("y"), F.when(fill, "interp").otherwise(F.coalesce("source", F.lit("missing"))).alias("source"), F.coalesce("conf", F.lit(0.0)).alias("conf"), (~hole).alias("observed"), opens.alias("reset")))


class StaticLock:
    """Greedy search for stretches in which a point stands still: the first ``window`` frames within ``radius`` of their median and on a path of at most ``path``,
    extended while points stay within ``extend`` of that centre and steps below ``step``. Holds one window, or the last point of a lock."""

    def __init__(self, window: int, radius: float, path: float, extend: float, step: float, most: int = 1 << 30, preroll: int = 0):
        self.window, self.radius, self.path, self.extend, self.step, self.most = window, radius, path, extend, step, most
        self.held, self.centre, self.locks = deque(maxlen=window), None, 0

    def row(self, key, values):
        frame, x, y = values
        if self.centre is not None:
            near = math.hypot(x - self.centre[0], y - self.centre[1])
            if near <= self.extend and math.hypot(x - self.tail[0], y - self.tail[1]) <= self.step:
                self.tail = (x, y)
                return [(*key, frame)]
            self.centre = None
            self.held.clear()
        if self.locks >= self.most:
            return []
        self.held.append((frame, x, y))
        if len(self.held) < self.window:
            return []
        xs, ys = sorted(p[1] for p in self.held), sorted(p[2] for p in self.held)
        m = self.window
        cx, cy = (xs[(m - 1) // 2] + xs[m // 2]) / 2, (ys[(m - 1) // 2] + ys[m // 2]) / 2
        pts = list(self.held)
        if max(math.hypot(p[1] - cx, p[2] - cy) for p in pts) > self.radius or sum(math.hypot(b[1] - a[1], b[2] - a[2]) for a, b in zip(pts, pts[1:])) > self.path:
            return []
        self.centre, self.tail, self.locks = (cx, cy), (x, y), self.locks + 1
        self.held.clear()
        return [(*key, p[0]) for p in pts]

    def end(self, key):
        return []


#: Parameters of the three lock searches: mixed real points, raw model points (one lock per run), and predictions (several locks per run).
LOCKS = {
    "mixed": {"window": 16, "radius": 35.0, "path": 70.0, "extend": 52.5, "step": 52.5},
    "raw_model": {"window": 8, "radius": 10.0, "path": 15.0, "extend": 15.0, "step": 15.0, "most": 1},
    "prediction": {"window": 8, "radius": 10.0, "path": 15.0, "extend": 15.0, "step": 15.0},
}


def static_locks(points: DataFrame, kind: str) -> DataFrame:
    """Frames of static locks: match_id, frame. ``points`` has match_id, frame, x, y; runs of consecutive frames are searched side by side."""
    r = runs(points.select("match_id", "frame", "x", "y"), F.lit(True))
    return scan(r, ["match_id", "run"], ["frame"], ["frame", "x", "y"], lambda: StaticLock(**LOCKS[kind]), "match_id long, run long, frame long").select("match_id", "frame")


class GreedyTracker:
    """Constant-velocity association of candidates: gated, cheapest pairs first, one to one; unmatched good candidates start tracks; a track ends after ``gap`` frames."""

    def __init__(self, seed: float = 1.35, gap: int = 2, cap: int = 200):
        self.seed, self.gap, self.cap, self.active, self.next, self.frame, self.now = seed, gap, cap, [], 0, None, []

    def row(self, key, values):
        frame = values[0]
        out = self._step(key) if self.frame is not None and frame != self.frame else []
        self.frame = frame
        self.now.append(values)
        return out

    def end(self, key):
        return self._step(key) if self.now else []

    def _step(self, key):
        frame, cands, self.now = self.frame, self.now, []
        self.active = [t for t in self.active if frame - t["f"] <= self.gap]
        pairs = []
        for i, t in enumerate(self.active):
            g = frame - t["f"]
            vx, vy = t["v"]
            px, py, gate = t["x"] + vx * g, t["y"] + vy * g, 25.0 + 25.0 * g + min(60.0, math.hypot(vx, vy) * 0.7)
            for j, (_, _, x, y, quality, area) in enumerate(cands):
                d = math.hypot(x - px, y - py)
                if d <= gate:
                    pairs.append((d / gate + 0.12 * abs(math.log((area + 1.0) / (t["area"] + 1.0))) - 0.10 * quality, t["id"], j, i))
        used_t, used_c, out = set(), set(), []
        for _, _, j, i in sorted(pairs):
            if i in used_t or j in used_c:
                continue
            used_t.add(i)
            used_c.add(j)
            t, (_, cand, x, y, quality, area) = self.active[i], cands[j]
            g = frame - t["f"]
            t["v"] = (0.55 * t["v"][0] + 0.45 * (x - t["x"]) / g, 0.55 * t["v"][1] + 0.45 * (y - t["y"]) / g)
            t.update(f=frame, x=x, y=y, area=area, n=t["n"] + 1)
            t["q"].append(quality)
            out.append((*key, t["id"], frame, cand))
        for j, (_, cand, x, y, quality, area) in enumerate(cands):
            if j not in used_c and quality >= self.seed:
                self.active.append({"id": self.next, "f": frame, "x": x, "y": y, "v": (0.0, 0.0), "area": area, "n": 1, "q": deque([quality], maxlen=5)})
                out.append((*key, self.next, frame, cand))
                self.next += 1
        if len(self.active) > self.cap:
            self.active = sorted(self.active, key=lambda t: (-t["n"], -sum(t["q"]) / len(t["q"]), t["id"]))[: self.cap]
        return out


def greedy_tracks(candidates: DataFrame, seed: float = 1.35, gap: int = 2, cap: int = 200) -> DataFrame:
    """Tracks of candidates (match_id, frame, cand_id, x, y, quality, area): match_id, run, track, frame, cand_id. A track can't outlive ``gap`` frames without candidates, so
    runs of frames with smaller holes are tracked side by side; (run, track) names a track within its match.

    At most ``cap`` tracks are followed at once, the longest and best; it is part of the method (a frame has a bounded number of candidates). Points of a track that is given up
    stay in the result, and its later candidates start a new track.
    """
    frames = runs(candidates.select("match_id", "frame").distinct(), F.lit(True), gap)
    c = candidates.join(frames, ["match_id", "frame"])
    return scan(c, ["match_id", "run"], ["frame", "cand_id"], ["frame", "cand_id", "x", "y", "quality", "area"], lambda: GreedyTracker(seed, gap, cap), "match_id long, run long, track long, frame long, cand_id long")


class StaticCentres:
    """Static centres of every frame. Candidates of a frame are merged in order, each into the nearest centre under ``radius`` px. A window starts on every frame; its first cluster that
    has one within ``disp`` px on all ``window`` frames, the closest ones within ``disp`` of their median, marks all its frames with that median, unless an earlier window left a
    centre within half of ``disp`` there. Holds one window of clusters."""

    def __init__(self, window: int = 12, disp: float = 36.0, radius: float = 45.0):
        self.window, self.disp, self.radius, self.held, self.frame, self.now = window, disp, radius, deque(), None, []
        self.order = [window - 1, window // 2, *(k for k in range(1, window - 1) if k != window // 2)]  # far frames first: what moves is soon out

    def row(self, key, values):
        out = self._step(key) if self.frame is not None and values[0] != self.frame else []
        self.frame = values[0]
        self.now.append(values[2:])
        return out

    def end(self, key):
        out = self._step(key) if self.now else []
        return out + [(*key, f, x, y) for f, _, marks in self.held for x, y in marks]

    def _merged(self):
        merged = []
        for x, y, s in self.now:
            best, least = None, self.radius
            for c in merged:
                d = math.hypot(x - c[0], y - c[1])
                if d < least:
                    best, least = c, d
            if best is None:
                merged.append([x, y, s])
            else:
                w, o = max(0.01, s - 0.05), max(0.01, best[2] - 0.05)
                best[:] = [(best[0] * o + x * w) / (o + w), (best[1] * o + y * w) / (o + w), best[2] + s]
        return merged

    def _median(self, x, y):
        pts, most = [(x, y)], self.disp * self.disp
        for k in self.order:
            best = None
            for c in self.held[k][1]:
                d = (c[0] - x) ** 2 + (c[1] - y) ** 2
                if d <= most and (best is None or d < best[0]):
                    best = (d, c[0], c[1])
            if best is None:
                return None
            pts.append(best[1:])
        xs, ys, m = sorted(p[0] for p in pts), sorted(p[1] for p in pts), self.window
        cx, cy = (xs[(m - 1) // 2] + xs[m // 2]) / 2, (ys[(m - 1) // 2] + ys[m // 2]) / 2
        return (cx, cy) if max(math.hypot(px - cx, py - cy) for px, py in pts) <= self.disp else None

    def _step(self, key):
        self.held.append((self.frame, self._merged(), []))
        self.now = []
        if len(self.held) < self.window:
            return []
        for x, y, _ in self.held[0][1]:
            centre = self._median(x, y)
            if centre:
                for _, _, marks in self.held:
                    if not any(math.hypot(a - centre[0], b - centre[1]) <= self.disp * 0.5 for a, b in marks):
                        marks.append(centre)
                break
        frame, _, marks = self.held.popleft()
        return [(*key, frame, x, y) for x, y in marks]


def static_centres(candidates: DataFrame) -> DataFrame:
    """Static centres (match_id, frame, x, y) of candidates (match_id, frame, cand_id, x, y, quality). A window needs candidates on every frame, so runs of frames that have some
    are scanned side by side."""
    frames = runs(candidates.select("match_id", "frame").distinct(), F.lit(True))
    c = candidates.join(frames, ["match_id", "frame"])
    return scan(c, ["match_id", "run"], ["frame", "cand_id"], ["frame", "cand_id", "x", "y", "quality"], StaticCentres, "match_id long, run long, frame long, x double, y double").drop("run")


class StaticTop:
    """A track (x, y in time) whose last ``window`` points, ``least`` or more, lie mostly in the top zone and hardly move is banned from there on."""

    def __init__(self, top: float, window: int = 90, least: int = 42, share: float = 0.88, move: float = 30.0):
        self.top, self.least, self.share, self.move, self.held, self.banned = top, least, share, move, deque(maxlen=window), False

    def row(self, key, values):
        frame, x, y = values
        if not self.banned:
            self.held.append((x, y))
            n = len(self.held)
            if n >= self.least and sum(b <= self.top for _, b in self.held) / n >= self.share:
                xs, ys = [a for a, _ in self.held], [b for _, b in self.held]
                self.banned = math.hypot(max(xs) - min(xs), max(ys) - min(ys)) <= self.move
        return [(*key, frame)] if self.banned else []

    def end(self, key):
        return []


def banned_top_tracks(points: DataFrame, top: float) -> DataFrame:
    """match_id, track, frame: points (match_id, track, frame, x, y) from the one on at which their track is banned for standing still in the top zone (y up to ``top``)."""
    return scan(points, ["match_id", "track"], ["frame"], ["frame", "x", "y"], lambda: StaticTop(top), "match_id long, track long, frame long")


class Identity:
    """Who is the near and who the far player of each frame, by pools on either side of the net's line (they share a band): the one with the identity held so far, else the nearest to where
    that player was, else the outermost. Where both sides want one detection it stays with the side that holds its identity, else with the side it is nearer to; the other side takes
    the outermost of the rest. A far player of another identity may not jump too far, nor up."""

    def __init__(self, band: float = 12.0, far_jump: float = 110.0, far_up: float = 30.0):
        self.band, self.jump, self.up = band, far_jump, far_up
        self.frame, self.now, self.near, self.far = None, [], None, None

    def row(self, key, values):
        out = self._step(key) if self.frame is not None and values[0] != self.frame else []
        self.frame = values[0]
        self.now.append(values)
        return out

    def end(self, key):
        return self._step(key) if self.now else []

    @staticmethod
    def _away(d, was):
        return math.hypot(d[2] - was[2], d[3] - was[3]) if was else math.inf

    def _pick(self, pool, was, outermost):
        if not pool:
            return None
        if was is None:
            return outermost(pool)
        same = next((d for d in pool if d[1] == was[1]), None)
        return same or min(pool, key=lambda d: self._away(d, was))

    def _step(self, key):
        frame, dets, self.now = self.frame, sorted(self.now, key=lambda d: (d[3], d[1])), []
        lowest, highest = (lambda p: max(p, key=lambda d: d[3])), (lambda p: min(p, key=lambda d: d[3]))
        nears, fars = [d for d in dets if d[3] >= d[4] - self.band], [d for d in dets if d[3] <= d[4] + self.band]
        near, far = self._pick(nears, self.near, lowest), self._pick(fars, self.far, highest)
        if near and far and near[1] == far[1]:
            holds_far, holds_near = bool(self.far and far[1] == self.far[1]), bool(self.near and near[1] == self.near[1])
            to_far = holds_far if holds_far != holds_near else self._away(far, self.far) <= self._away(near, self.near)
            rest = [d for d in (nears if to_far else fars) if d[1] != near[1]]
            other = (lowest if to_far else highest)(rest) if rest else None
            near, far = (other, far) if to_far else (near, other)
        if far and self.far and far[1] != self.far[1] and (far[3] < self.far[3] - self.up or self._away(far, self.far) > self.jump):
            far = None
        self.near, self.far = near or self.near, far or self.far
        return [(*key, frame, side, d[1]) for side, d in (("far", far), ("near", near)) if d]


def player_identity(detections: DataFrame, x: str = "mx", y: str = "my", line: str = "0", band: float = 12.0, far_jump: float = 110.0, far_up: float = 30.0) -> DataFrame:
    """Detections (match_id, frame, det_id and a position ``x``, ``y``) that are the near and the far player: match_id, frame, side, det_id. ``line`` is the y of the net's line.

    Identities are held over holes of any length, so a match is one stream; its state is two detections.
    """
    d = detections.select("match_id", "frame", "det_id", F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"), F.expr(line).cast("double").alias("line"))
    return scan(d, ["match_id"], ["frame", "det_id"], ["frame", "det_id", "x", "y", "line"], lambda: Identity(band, far_jump, far_up), "match_id long, frame long, side string, det_id long")


def closest(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """K15: of the candidates (match_id, frame, det_id, x, y) of a frame the one nearest to its reference point (match_id, frame, x, y), the smaller det_id on a tie: match_id, frame, det_id."""
    r = reference.select("match_id", "frame", F.col("x").alias("rx"), F.col("y").alias("ry"))
    d = F.sqrt((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2)
    return candidates.join(r, ["match_id", "frame"]).where(d.isNotNull()).groupBy("match_id", "frame").agg(F.min_by("det_id", F.struct(d, "det_id")).alias("det_id"))


class Selector:
    """One candidate per frame: the best by quality, count and persistence less its distance from where the ball should be; far jumps need a better quality. The position follows by
    exponential means (velocity .55 / .45, point .70 / .30); frames without a choice halve the velocity, more than ``gap`` of them forget the ball."""

    def __init__(self, least: float = 1.3, jump: float = 360.0, gap: int = 5):
        self.least, self.jump, self.gap, self.last, self.v, self.at, self.frame, self.now = least, jump, gap, None, (0.0, 0.0), None, None, []

    def row(self, key, values):
        out = self._step(key) if self.frame is not None and values[0] != self.frame else []
        self.frame = values[0]
        self.now.append(values)
        return out

    def end(self, key):
        return self._step(key) if self.now else []

    def _step(self, key):
        frame, cands, self.now, best = self.frame, self.now, [], None
        if self.last is not None:
            missed = frame - self.at - 1
            if missed > self.gap:
                self.last, self.v = None, (0.0, 0.0)
            else:
                self.v = (self.v[0] * 0.5**missed, self.v[1] * 0.5**missed)
        for _, cand, x, y, quality, count, persistence in cands:
            if quality < self.least:
                continue
            near = 0.0
            if self.last is not None:
                near = math.hypot(x - self.last[0] - self.v[0], y - self.last[1] - self.v[1])
                if near > self.jump and quality < self.least + 0.10:
                    continue
            elif quality < self.least + 0.10 and count < 2 and not persistence:
                continue
            rank = 1.8 * quality + 0.10 * min(count, 3) + 0.08 * min(persistence, 3) - 0.55 * min(1.0, near / self.jump)
            if best is None or (rank, -cand) > best[:2]:
                best = (rank, -cand, x, y)
        if best is None:
            return []
        x, y = best[2], best[3]
        if self.last is not None:
            self.v = (0.55 * self.v[0] + 0.45 * (x - self.last[0]), 0.55 * self.v[1] + 0.45 * (y - self.last[1]))
            x, y = 0.70 * x + 0.30 * (self.last[0] + self.v[0]), 0.70 * y + 0.30 * (self.last[1] + self.v[1])
        self.last, self.at = (x, y), frame
        return [(*key, frame, x, y, -best[1])]


def selected_track(candidates: DataFrame) -> DataFrame:
    """The ball by candidate selection (match_id, frame, cand_id, x, y, quality, count, persistence): match_id, frame, x, y, cand_id. Holes of more than five frames part the work."""
    frames = runs(candidates.select("match_id", "frame").distinct(), F.lit(True), 6)
    out = scan(candidates.join(frames, ["match_id", "frame"]), ["match_id", "run"], ["frame", "cand_id"], ["frame", "cand_id", "x", "y", "quality", "count", "persistence"], Selector, "match_id long, run long, frame long, x double, y double, cand_id long")
    return out.drop("run")


def led(points: deque, dt: int) -> tuple[float, float]:
    """Where the least squares parabola (a line under five points) over frame, x, y leads ``dt`` frames after the last point: one weight per point, the same for x and y."""
    last = points[-1][0]
    t = [p[0] - last for p in points]
    n, a, b = len(t), sum(t), sum(k * k for k in t)
    if n < 5:
        det = n * b - a * a
        w = [(b - a * dt + (n * dt - a) * k) / det for k in t]
    else:
        c, d, e = sum(k**3 for k in t), sum(k**4 for k in t), dt * dt
        p, q, r = b * d - c * c, b * c - a * d, a * c - b * b  # cofactors of the normal equations
        u, v, s = n * d - b * b, a * b - n * c, n * b - a * a
        det = n * p + a * q + b * r
        c0, c1, c2 = (p + q * dt + r * e) / det, (q + u * dt + v * e) / det, (r + v * dt + s * e) / det
        w = [c0 + c1 * k + c2 * k * k for k in t]
    return sum(k * p[1] for k, p in zip(w, points)), sum(k * p[2] for k, p in zip(w, points))


class Extender:
    """Goes on from a track's last points, frame by frame, to the candidate that a local parabola (a line under five points) leads to: a tight gate, little acceleration, little
    turn; ends after ``misses`` frames without one."""

    def __init__(self, misses: int = 5, seed: float = 1.25):
        self.most, self.seed, self.pts, self.frame, self.now, self.missed, self.done = misses, seed, deque(maxlen=7), None, [], 0, False

    def row(self, key, values):
        frame, core, cand, x, y, quality = values
        if core:
            self.pts.append((frame, x, y))
            return []
        out = self._step(key) if self.frame is not None and frame != self.frame else []
        if self.frame is not None:
            self._skip(frame - self.frame - 1)
        elif self.pts:
            self._skip(frame - self.pts[-1][0] - 1)
        self.frame = frame
        self.now.append((cand, x, y, quality))
        return out

    def end(self, key):
        return self._step(key) if self.now else []

    def _skip(self, frames: int) -> None:
        self.missed += max(0, frames)
        self.done = self.done or self.missed >= self.most

    def _step(self, key):
        cands, self.now = self.now, []
        if self.done or len(self.pts) < 3:
            return []
        (f0, x0, y0), (f1, x1, y1) = self.pts[-2], self.pts[-1]
        vx, vy, dt = (x1 - x0) / (f1 - f0), (y1 - y0) / (f1 - f0), self.frame - f1
        speed, best, able = math.hypot(vx, vy), None, []
        for cand, x, y, quality in cands:  # the fit is the dear part: only if a candidate is left for it
            wx, wy = (x - x1) / dt, (y - y1) / dt
            bend, now = math.hypot(wx - vx, wy - vy), math.hypot(wx, wy)
            if quality >= self.seed and bend <= 13.0 + 2.0 * (dt - 1) and (speed <= 3.0 or now <= 3.0 or (vx * wx + vy * wy) >= math.cos(math.radians(38.0)) * speed * now):
                able.append((cand, x, y, quality, bend))
        if able:
            px, py = led(self.pts, dt)
            gate = min(30.0, 10.0 + 0.30 * speed + 4.0 * (dt - 1))
        for cand, x, y, quality, bend in able:
            d = math.hypot(x - px, y - py)
            if d <= gate:
                cost = d / gate + 0.035 * bend - 0.04 * quality
                if best is None or (cost, cand) < best[:2]:
                    best = (cost, cand, x, y)
        if best is None:
            self._skip(1)
            return []
        self.missed = 0
        self.pts.append((self.frame, best[2], best[3]))
        return [(*key, self.frame, best[1])]


def extensions(points: DataFrame, candidates: DataFrame, forward: bool = True, reach: int = 40) -> DataFrame:
    """Candidates that carry tracks on, at most ``reach`` frames, after their end or (on negated frames) before their start: match_id, run, track, frame, cand_id.

    Each track looks at the frames after it by an equi join; a track and its following candidates are one short stream.
    """
    sign = 1 if forward else -1
    p = points.select("match_id", "run", "track", (F.col("frame") * sign).alias("frame"), F.lit(True).alias("core"), "cand_id", "x", "y", "quality")
    stop = p.groupBy("match_id", "run", "track").agg(F.max("frame").alias("z"))
    ahead = stop.select("match_id", "run", "track", F.explode(F.sequence(F.col("z") + 1, F.col("z") + reach)).alias("frame"))
    c = candidates.select("match_id", (F.col("frame") * sign).alias("frame"), F.lit(False).alias("core"), "cand_id", "x", "y", "quality")
    both = p.unionByName(ahead.join(c, ["match_id", "frame"]))
    out = scan(both, ["match_id", "run", "track"], ["frame", "cand_id"], ["frame", "core", "cand_id", "x", "y", "quality"], Extender, "match_id long, run long, track long, frame long, cand_id long")
    return out.withColumn("frame", F.col("frame") * sign)


class ExtendedTracker(GreedyTracker):
    """The greedy tracker over frames with holes of any length, its runs begun anew as in greedy_tracks, and the extensions of each track as soon as they can be known: forward from its
    last points when it has ended, backward over the frames held when its first points are there. Holds the tracks, their seven points, the frames within reach and the open extensions."""

    POINTS = 7

    def __init__(self, forward: bool, reach: int, seed: float = 1.35, gap: int = 2, cap: int = 200):
        super().__init__(seed, gap, cap)
        self.forward, self.reach, self.run, self.past, self.tails, self.open = forward, reach, None, deque(), {}, []

    def end(self, key):
        out = super().end(key)
        for i in list(self.tails):
            out += self._ended(key, i)
        return out + [r for name, _, e in self.open for r in e.end(name)]

    def _step(self, key):
        frame, cands, out = self.frame, self.now, []
        fresh = not self.past or frame - self.past[-1][0] > self.gap
        self.past.append((frame, cands))
        while self.past[0][0] < frame - self.reach - 24:  # 24 frames hold a track's first points and its end
            self.past.popleft()
        if self.open:
            for x in self.open:
                out += self._fed(x, frame, cands)
            self.open = [x for x in self.open if not x[2].done and frame < x[1] + self.reach]
        if fresh:
            for i in list(self.tails):
                out += self._ended(key, i)
            self.active, self.next, self.run = [], 0, frame
        at = {c[1]: c for c in cands}
        for *_, i, _, cand in super()._step(key):
            tail = self.tails.setdefault(i, deque(maxlen=self.POINTS) if self.forward else [])
            if self.forward or len(tail) < self.POINTS:
                tail.append((frame, at[cand][2], at[cand][3]))
                if not self.forward and len(tail) == self.POINTS:
                    out += self._back((key[0], self.run, i), tail)
        if len(self.tails) > len(self.active):
            for i in self.tails.keys() - {t["id"] for t in self.active}:
                out += self._ended(key, i)
        return out

    def _ended(self, key, i):
        tail, name, out = self.tails.pop(i), (key[0], self.run, i), []
        if len(tail) < 3:
            return out
        if not self.forward:
            return self._back(name, tail) if len(tail) < self.POINTS else out
        x = (name, tail[-1][0], Extender())
        x[2].pts.extend(tail)
        for frame, cands in self.past:
            out += self._fed(x, frame, cands) if frame > x[1] else []
        if not x[2].done:
            self.open.append(x)
        return out

    def _fed(self, x, frame, cands):
        name, stop, e = x
        if e.done or frame > stop + self.reach:
            return self._closed(x)
        out = []
        for _, cand, px, py, quality, _ in cands:
            out += e.row(name, (frame, False, cand, px, py, quality))
        return out + (self._closed(x) if frame == stop + self.reach else [])

    @staticmethod
    def _closed(x):
        out, x[2].done = x[2].end(x[0]), True
        return out

    def _back(self, name, tail):
        e, out = Extender(), []
        e.pts.extend((-f, x, y) for f, x, y in reversed(tail))
        for frame, cands in reversed(self.past):
            if frame < tail[0][0] - self.reach or e.done:
                break
            if frame < tail[0][0]:
                for _, cand, x, y, quality, _ in cands:
                    out += e.row(name, (-frame, False, cand, x, y, quality))
        return [(*r[:3], -r[3], r[4]) for r in out + e.end(name)]


def tracked_extensions(frames: DataFrame, grow: Callable[[DataFrame], DataFrame], forward: bool = True, reach: int = 40) -> DataFrame:
    """``extensions`` of the tracks of ``greedy_tracks`` over their own candidates, in one pass: match_id, run, track, frame, cand_id. ``frames`` has match_id, frame and what ``grow`` needs to
    make the frame's candidates (match_id, frame, cand_id, x, y, quality, area and the columns it doesn't know).

    No track bridges a hole of five frames, forward or backward, so runs with smaller holes are followed side by side. Frames are shuffled, not candidates; neither points nor pairs of a
    track and a candidate are written.
    """
    r = runs(frames, F.lit(True), 5)
    return scan(r, ["match_id", "run"], ["frame", "cand_id"], ["frame", "cand_id", "x", "y", "quality", "area"], lambda: ExtendedTracker(forward, reach), "match_id long, run long, track long, frame long, cand_id long", grow)


def parabola(points: list[tuple[float, float, float]], origin: float) -> tuple[float, float, float]:
    """Least squares parabola of x and of y over time about ``origin``: squared error of both, and the velocity there."""
    s = [0.0] * 5
    for f, _, _ in points:
        t, p = f - origin, 1.0
        for k in range(5):
            s[k] += p
            p *= t
    n, a, b, c, d = s
    det = n * (b * d - c * c) - a * (a * d - b * c) + b * (a * c - b * b)
    error, speed = 0.0, []
    for i in (1, 2):
        m0 = m1 = m2 = 0.0
        for p in points:
            t = p[0] - origin
            m0, m1, m2 = m0 + p[i], m1 + t * p[i], m2 + t * t * p[i]
        if abs(det) < 1e-9:
            return math.inf, 0.0, 0.0
        k0 = (m0 * (b * d - c * c) - a * (m1 * d - m2 * c) + b * (m1 * c - m2 * b)) / det
        k1 = (n * (m1 * d - m2 * c) - m0 * (a * d - b * c) + b * (a * m2 - b * m1)) / det
        k2 = (n * (b * m2 - c * m1) - a * (a * m2 - b * m1) + m0 * (a * c - b * b)) / det
        error += sum((p[i] - k0 - k1 * (p[0] - origin) - k2 * (p[0] - origin) ** 2) ** 2 for p in points)
        speed.append(k1)
    return error, speed[0], speed[1]


class SplitTest:
    """Frames where two parabolas explain a flight much better than one and the direction turns: over the points up to ``reach`` frames away, five at least on either side."""

    def __init__(self, reach: int = 13, gain: float = 50.0, turn: float = 90.0):
        self.reach, self.gain, self.turn, self.pts, self.next = reach, gain, turn, deque(), None

    def row(self, key, values):
        frame = values[0]
        if self.next is None:
            self.next = frame + 5
        out = []
        while self.next + self.reach < frame:
            out += self._test(key, self.next)
            self.next += 1
        self.pts.append(values)
        while self.pts[0][0] < self.next - self.reach:
            self.pts.popleft()
        return out

    def end(self, key):
        out = []
        while self.pts and self.next <= self.pts[-1][0] - 5:
            out += self._test(key, self.next)
            self.next += 1
        return out

    def _test(self, key, s):
        left = [p for p in self.pts if s - self.reach <= p[0] < s]
        right = [p for p in self.pts if s < p[0] <= s + self.reach]
        if len(left) < 5 or len(right) < 5:
            return []
        ax, ay, bx, by = left[-1][1] - left[0][1], left[-1][2] - left[0][2], right[-1][1] - right[0][1], right[-1][2] - right[0][2]
        if ax * bx + ay * by > 0.5 * math.hypot(ax, ay) * math.hypot(bx, by):  # chords within 60 degrees: no turn to test for
            return []
        one, (e1, ux, uy), (e2, vx, vy) = parabola(left + right, s)[0], parabola(left, s), parabola(right, s)
        n = 2 * (len(left) + len(right))
        gain = n * math.log(max(one / n, 1e-9)) - n * math.log(max((e1 + e2) / n, 1e-9)) - 6 * math.log(n)
        size = math.hypot(ux, uy) * math.hypot(vx, vy)
        angle = math.degrees(math.acos(max(-1.0, min(1.0, (ux * vx + uy * vy) / size)))) if size > 1e-12 else 0.0
        if gain < self.gain or angle < self.turn:
            return []
        near = min(self.pts, key=lambda p: (abs(p[0] - s), p[0]))
        return [(*key, s, float(near[1]), float(near[2]), gain, angle)]


def split_hits(points: DataFrame, least_y: float = 0.0, apart: int = 16) -> DataFrame:
    """Contacts inside flights by the split test: match_id, frame, x, y, score. ``points`` has match_id, frame, x, y; runs with holes up to two frames are tested side by side, contacts
    above ``least_y`` in the picture are left out, and the strongest stands within ``apart`` frames."""
    from courtlane.operators.sequence import suppressed

    r = runs(points.select("match_id", "frame", "x", "y"), F.lit(True), 3)
    c = scan(r, ["match_id", "run"], ["frame"], ["frame", "x", "y"], SplitTest, "match_id long, run long, frame long, x double, y double, gain double, angle double").where(F.col("y") >= least_y)
    kept = suppressed(c.drop("run").withColumn("gain", F.round("gain", 6)), F.col("gain"), apart)
    return kept.select("match_id", "frame", "x", "y", F.least(F.lit(0.96), F.greatest(F.lit(0.72), 0.68 + 0.001 * F.col("gain") + 0.0005 * F.col("angle"))).alias("score"))
