"""Building blocks for frame series: overlapping blocks, nearest anchors and runs. None of them puts a whole match into one task.

A series has one row per (match_id, frame). Blocks are 2**BLOCK_BITS frames long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from courtlane.session import staged

BLOCK_BITS = 12
KEY = "match_id"
#: Name in a plan of what `anchors` made.
_MARK = "__anchored"


def blocks(df: DataFrame, reach: int = 0) -> DataFrame:
    """``df`` with home, its frame's block, and block; with ``reach`` frames of overlap a row stands in each block that can see it."""
    home = F.shiftright("frame", BLOCK_BITS)
    df = df.withColumn("home", home)
    if not reach:
        return df.withColumn("block", F.col("home"))
    return df.withColumn("block", F.explode(F.array_distinct(F.array(F.shiftright(F.col("frame") - reach, BLOCK_BITS), "home", F.shiftright(F.col("frame") + reach, BLOCK_BITS)))))


def window(*more: str) -> WindowSpec:
    """The window of a block, by frame."""
    return Window.partitionBy(KEY, "block", *more).orderBy("frame")


def at_offsets(df: DataFrame, cols: list[str], offsets: list[int]) -> DataFrame:
    """Adds ``{col}_m{k}`` and ``{col}_p{k}``: the value k frames before or after, null where that frame has no row."""
    reach = max(abs(k) for k in offsets)
    w = window()
    name = lambda c, k: f"{c}_{'m' if k < 0 else 'p'}{abs(k)}"
    b = blocks(df, reach).withColumns({name(c, k): F.max(c).over(w.rangeBetween(k, k)) for c in cols for k in offsets})
    return b.where("block = home").drop("block", "home")


def around(df: DataFrame, exprs: dict[str, tuple[Column, int, int]]) -> DataFrame:
    """Adds aggregates over frames from lo to hi around each row: name -> (aggregate, lo, hi)."""
    reach = max(max(abs(lo), abs(hi)) for _, lo, hi in exprs.values())
    b = blocks(df, reach).withColumns({n: c.over(window().rangeBetween(lo, hi)) for n, (c, lo, hi) in exprs.items()})
    return b.where("block = home").drop("block", "home")


def _read_once(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder if a carry over blocks is in its plan already: each of them reads its input twice, so a chain of n costs n passes, not 2**n."""
    return staged(df, "series") if _MARK in df._jdf.queryExecution().analyzed().toString() else df


def anchors(df: DataFrame, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, own: bool = False, by: str | None = None) -> DataFrame:
    """Adds the last non-null value of each ``before`` expression on an earlier row, and the first of each ``after`` on a later row
    (with ``own`` the row itself counts), of the match or, with ``by``, of its part (a segment, a phase).

    Inside a block it is a window; what comes from other blocks passes through one row per block.
    """
    df = _read_once(df)
    keys = [KEY, *([by] if by else [])]
    before, after = before or {}, after or {}
    names = {**{n: ("b", c) for n, c in before.items()}, **{n: ("a", c) for n, c in after.items()}}
    b = blocks(df).drop("home").withColumns({f"__{n}": c for n, (_, c) in names.items()})
    w = Window.partitionBy(*keys, "block").orderBy("frame")
    past, future = w.rowsBetween(Window.unboundedPreceding, 0 if own else -1), w.orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    at = {n: F.when(F.col(f"__{n}").isNotNull(), F.col("frame")) for n in names}
    summary = b.groupBy(*keys, "block").agg(*[(F.max_by if side == "b" else F.min_by)(F.col(f"__{n}"), at[n]).alias(n) for n, (side, _) in names.items()])
    along = Window.partitionBy(*keys).orderBy("block")
    back, ahead = along.rowsBetween(Window.unboundedPreceding, -1), along.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, "block", *[F.last(n, ignorenulls=True).over(back if side == "b" else ahead).alias(f"__c_{n}") for n, (side, _) in names.items()])
    inner = b.withColumns({n: F.last(f"__{n}", ignorenulls=True).over(past if side == "b" else future) for n, (side, _) in names.items()})
    out = _with_carried(inner, carried, by)
    return out.withColumns({n: F.coalesce(n, f"__c_{n}") for n in names}).alias(_MARK).drop("block", *[f"__{n}" for n in names], *[f"__c_{n}" for n in names])


def _with_carried(inner: DataFrame, carried: DataFrame, by: str | None) -> DataFrame:
    if not by:
        return inner.join(carried, [KEY, "block"], "left")
    same = (inner[KEY] == carried[KEY]) & (inner["block"] == carried["block"]) & inner[by].eqNullSafe(F.col("__by"))
    return inner.join(carried.withColumnRenamed(by, "__by"), same, "left").drop("__by").drop(carried[KEY]).drop(carried["block"])


def runs(df: DataFrame, flag: Column, most_gap: int = 1, by: str | None = None) -> DataFrame:
    """Rows where ``flag`` holds, with run: the first frame of their run, in which neighbours lie at most ``most_gap`` frames apart.

    One pass: inside a block a window finds the starts; a block's first rows belong to the run of the block before if that ends near enough, and its run's
    start comes along one row per block.
    """
    keys = [KEY, *([by] if by else [])]
    b = blocks(_read_once(df.where(flag))).drop("home")
    w = Window.partitionBy(*keys, "block").orderBy("frame")
    opens = F.col("frame") - F.lag("frame").over(w) > most_gap
    b = b.withColumn("__start", F.when(opens, F.col("frame")))
    along = Window.partitionBy(*keys).orderBy("block")
    s = b.groupBy(*keys, "block").agg(F.min("frame").alias("a"), F.max("frame").alias("z"), F.max("__start").alias("s"))
    s = s.withColumn("head", F.when(F.coalesce(F.col("a") - F.lag("z").over(along) > most_gap, F.lit(True)), F.col("a")))
    carried = s.select(*keys, "block", F.coalesce("head", F.last(F.coalesce("s", "head"), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))).alias("__c"))
    inner = b.withColumn("run", F.last("__start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _with_carried(inner, carried, by).withColumn("run", F.coalesce("run", "__c")).alias(_MARK).drop("block", "__start", "__c")


def segments(df: DataFrame, cut: Column, name: str = "segment") -> DataFrame:
    """Adds the frame at which the row's camera segment began: the last row with ``cut`` at or before it, -1 ahead of the first."""
    out = anchors(df, before={name: F.when(cut, F.col("frame"))}, own=True)
    return out.withColumn(name, F.coalesce(name, F.lit(-1)))


def percentiles_by(df: DataFrame, keys: list[str], value: Column, probs: dict[str, float], width: float) -> DataFrame:
    """Exact percentiles with linear interpolation per key: keys and a column per entry of ``probs``. Nulls are left out.

    Equal values are counted before the shuffle and gathered in buckets ``width`` wide; the running count of a key goes over its buckets
    first and then inside only those that hold a wanted rank, so a hot key is spread over its buckets.
    """
    v = df.select(*keys, value.cast("double").alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("n")).withColumn("b", F.floor(F.col("v") / width))
    v = staged(v, "values")
    b = v.groupBy(*keys, "b").agg(F.sum("n").alias("bn"))
    along = Window.partitionBy(*keys).orderBy("b")
    b = b.withColumns({"lo": F.coalesce(F.sum("bn").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("bn").over(Window.partitionBy(*keys))})
    ranks = [r for i, p in enumerate(probs.values()) for r in (F.struct(F.lit(i).alias("i"), F.lit(0).alias("up"), F.floor((F.col("all") - 1) * F.lit(p)).alias("r")), F.struct(F.lit(i).alias("i"), F.lit(1).alias("up"), F.ceil((F.col("all") - 1) * F.lit(p)).alias("r")))]
    wanted = b.withColumn("w", F.explode(F.array(*ranks))).where((F.col("w.r") >= F.col("lo")) & (F.col("w.r") < F.col("lo") + F.col("bn"))).select(*keys, "b", "lo", "all", "w")
    inner = Window.partitionBy(*keys, "b").orderBy("v")
    v = v.withColumn("before", F.coalesce(F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = wanted.join(v, [*keys, "b"]).where((F.col("w.r") >= F.col("lo") + F.col("before")) & (F.col("w.r") < F.col("lo") + F.col("before") + F.col("n")))
    at = at.groupBy(*keys, "w.i").agg(F.max(F.when(F.col("w.up") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("w.up") == 1, F.col("v"))).alias("z"), F.first("all").alias("all"))
    value_of = {n: F.max(F.when(F.col("i") == i, F.col("a") + ((F.col("all") - 1) * F.lit(p) - F.floor((F.col("all") - 1) * F.lit(p))) * (F.col("z") - F.col("a")))).alias(n) for i, (n, p) in enumerate(probs.items())}
    return at.groupBy(*keys).agg(*value_of.values())


class Suppressor:
    """Greedy suppression along time: rows (frame, tie, score) in order of frame. A row is settled once no better row that is still open lies within the separation; it holds
    the rows that wait for a better one ahead, which are those of one rise of the score, and the last kept ones."""

    def __init__(self, separation: int):
        self.sep, self.open, self.kept = separation, [], []

    def row(self, key, values):
        frame, tie, score = values
        out = self._settle(key, frame) if self.open and frame - self.open[0][0] >= self.sep else []
        self.open.append((frame, tie, score))
        return out

    def end(self, key):
        return self._settle(key, None)

    def _settle(self, key, now):
        """Settles open rows that no row from ``now`` on can outdo or free: best first, as far as all rows that could outdo them are known."""
        out, progress = [], True
        while progress and self.open:
            progress = False
            for i in sorted(range(len(self.open)), key=lambda i: (-self.open[i][2], self.open[i][1], self.open[i][0])):
                frame, tie, score = self.open[i]
                if any(abs(frame - k) < self.sep for k in self.kept):
                    self.open.pop(i)
                    progress = True
                    break
                if now is not None and now - frame < self.sep:
                    continue
                rivals = (r for j, r in enumerate(self.open) if j != i and abs(r[0] - frame) < self.sep)
                if all((-score, tie, frame) <= (-r[2], r[1], r[0]) for r in rivals):
                    self.kept.append(frame)
                    out.append((*key, frame, tie))
                    self.open.pop(i)
                    progress = True
                    break
        first = self.open[0][0] if self.open else now
        self.kept = [k for k in self.kept if first is not None and first - k < self.sep]
        return out


def suppressed(candidates: DataFrame, score: Column, separation: int, by: str | None = None, tie: str = "frame") -> DataFrame:
    """Greedy non-maximum suppression in time: candidates by falling score (ties: smaller ``tie``, a whole number, then frame), each kept unless a kept one lies less than
    ``separation`` frames away. A candidate is named by match, ``by``, frame and ``tie``; repeated ones count once.

    Only candidates in one chain of gaps below the separation can touch each other; chains stream one by one (see Suppressor), none is gathered.
    """
    from courtlane.operators.kernels import scan

    keys = [KEY, *([by] if by else [])]
    own = [*keys, "frame", *([tie] if tie != "frame" else [])]
    once = candidates.withColumn("__score", score.cast("double")).dropDuplicates(own)
    c = runs(once.select(*keys, "frame", F.col(tie).cast("long").alias("__tie"), "__score"), F.lit(True), separation - 1, by)
    group = ", ".join(f"k{i} long" for i in range(len(keys) + 1))
    renamed = c.select(*[F.col(k).cast("long").alias(f"k{i}") for i, k in enumerate([*keys, "run"])], "frame", "__tie", "__score")
    names = [f"k{i}" for i in range(len(keys) + 1)]
    kept = scan(renamed, names, ["frame", "__tie"], ["frame", "__tie", "__score"], lambda: Suppressor(separation), f"{group}, frame long, tie long")
    kept = kept.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "frame", *([F.col("tie").alias(tie)] if tie != "frame" else []))
    return once.drop("__score").join(kept, own, "left_semi")


def dense(df: DataFrame) -> DataFrame:
    """match_id, frame: every frame from 0 to the last one of each match of ``df``; blocks are made first and then their frames, so that no task makes a whole match."""
    stop = df.groupBy(KEY).agg(F.max("frame").alias("stop"))
    b = stop.select(KEY, "stop", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("stop", BLOCK_BITS))).alias("block")).repartition(KEY, "block")
    first = F.shiftleft("block", BLOCK_BITS)
    return b.select(KEY, F.explode(F.sequence(first, F.least(F.col("stop"), first + (1 << BLOCK_BITS) - 1))).alias("frame"))
