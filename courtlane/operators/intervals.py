"""Covered periods and gaps of overlapping intervals (problem 5), by a sweep line whose prefix sums go block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of the axis in one block. A hot entity is swept by as many tasks as it has blocks.
BLOCK_BITS = 16


def _carried(df: DataFrame, keys: list[str], summary: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """Aggregate each block to ``summary``, look along the blocks of an entity by the window columns ``over``, and join them back.

    Only one row per block passes the window over the entity; the join back is on (entity, block), which no entity makes hot.
    """
    totals = df.groupBy(*keys, "block").agg(*[c.alias(n) for n, c in summary.items()])
    seen = totals.select(*keys, "block", *[c.alias(n) for n, c in over.items()])
    return df.join(seen, [*keys, "block"])


def covered_and_gaps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Periods and gaps per entity: keys, kind (period or gap), start_frame, end_frame, both inclusive.

    ``start`` and ``end`` are integer columns that both belong to the interval. Intervals with a null key, a null bound or start after end
    are left out; overlapping, nested, repeated and touching intervals ([1, 5], [6, 9]) give one period; an entity without a valid
    interval gives no row. Bounds are kept as BIGINT inside, so that end + 1 can't overflow.

    A bound becomes an event (+1 at start, -1 after end), events on one point are added before the shuffle, and the running sum of an
    entity is taken within blocks of the axis, each with what the earlier blocks carry in.
    """
    at = intervals.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{start}`").cast("long").alias("s"), F.col(f"`{end}`").cast("long").alias("e"))
    at = at.where(" and ".join([*(f"`{k}` is not null" for k in keys), "s <= e"]))
    events = at.select(*keys, F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct((F.col("e") + 1).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    events = events.groupBy(*keys, F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d")).where("d != 0").withColumn("block", F.shiftright("at", BLOCK_BITS))
    along = Window.partitionBy(*keys).orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "block").orderBy("at")
    swept = _carried(
        events, keys,
        {"d_all": F.sum("d"), "at_first": F.min("at"), "at_least": F.min("at")},
        {"carry": F.coalesce(F.sum("d_all").over(before), F.lit(0)), "after": F.lead("at_first").over(along), "origin": F.min("at_least").over(before)},
    )
    swept = swept.select(
        *keys, "block", "at", "origin",
        (F.col("carry") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("active"),
        F.coalesce(F.lead("at").over(inside), F.col("after")).alias("next_at"),
        F.first("at").over(inside).alias("block_first"),
    )
    # Each point where the count falls to zero ends a period, which began where the point before it of this kind was followed by an event.
    ends = swept.where("active = 0")
    ends = _carried(ends, keys, {"next_last": F.max("next_at"), "any": F.count("*")}, {"opened": F.last("next_last", ignorenulls=True).over(before)})
    first = F.coalesce(F.lag("next_at").over(inside), F.col("opened"), F.col("origin"), F.col("block_first"))
    both = ends.select(*keys, "at", "next_at", first.alias("began"))
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start_frame"), b.alias("end_frame"))
    out = both.select(*keys, F.explode(F.array(row("period", F.col("began"), F.col("at") - 1), row("gap", F.col("at"), F.col("next_at") - 1))).alias("r"))
    return out.select(*keys, "r.kind", "r.start_frame", "r.end_frame").where("end_frame is not null")


def match_coverage(track_range: DataFrame, rally_segment: DataFrame) -> DataFrame:
    """Covered periods and gaps of both interval tables: interval_table, match_id, kind, start_frame, end_frame."""
    of = lambda df, name: df.select(F.lit(name).alias("interval_table"), "match_id", "start_frame", "end_frame")
    both = of(track_range, "track_range").unionByName(of(rally_segment, "rally_segment"))
    found = covered_and_gaps(both, ["interval_table", "match_id"], "start_frame", "end_frame")
    return found.select("interval_table", "match_id", "kind", F.col("start_frame").cast("int").alias("start_frame"), F.col("end_frame").cast("int").alias("end_frame"))
