"""Pairing of records with the nearest record in time of the same entity, within a tolerance (problem 6)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ticks of one block; an entity is merged by as many tasks as it has blocks.
BLOCK_BITS = 12


def _merge(tolerance: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One pass over rows sorted by (entity, block, due, side). A right record is due ``tolerance`` ticks before its own, ahead of the
        left records of that tick: when a left record comes, every right record it may take is in the window, and none beyond it."""
        at, window = None, deque()  # of (tick, smallest right id), at most 2 * tolerance + 1, across batches
        for part in parts:
            left, right, gap = [], [], []
            for entity, block, side, tick, ident in zip(part["entity"], part["block"], part["side"], part["tick"], part["id"]):
                if at != (entity, block):
                    at = (entity, block)
                    window.clear()
                if side == 0:
                    if not window or window[-1][0] != tick:  # rows of one tick come by id, so the first has the smallest
                        window.append((tick, ident))
                    continue
                while window and window[0][0] < tick - tolerance:
                    window.popleft()
                best = min(window, key=lambda r: (abs(r[0] - tick), r[0]), default=None)
                if best is not None:
                    left.append(ident)
                    right.append(best[1])
                    gap.append(best[0] - tick)
            yield pd.DataFrame({"left_id": left, "right_id": right, "offset": gap}).astype("int64")

    return run


def nearest_within(left: DataFrame, right: DataFrame, entity: str, tick: str, left_id: str, right_id: str, tolerance: int) -> DataFrame:
    """Each left record with the right record of the same entity that is nearest in ticks, if at most ``tolerance`` away.

    Result: left_id, right_id, offset (right minus left tick), one row per distinct pair. At equal distance the earlier tick wins, on one
    tick the smaller right id. Rows with a null entity, tick or id are left out on either side; redelivered rows count once; a right record
    may serve several left ones; an empty side gives an empty result. Other columns are dropped, so they can't clash. Ids are BIGINT.

    Both tables go once through one shuffle by (entity, block of ticks), right records near a block's edge into the neighbouring block too.
    A task sorts its rows and streams over them; it holds at most 2 * tolerance + 1 right records, so a hot entity or tick needs no more.
    """
    def of(df: DataFrame, ident: str, side: int) -> DataFrame:
        return df.select(F.col(f"`{entity}`").cast("long").alias("entity"), F.col(f"`{tick}`").cast("long").alias("tick"), F.col(f"`{ident}`").cast("long").alias("id"), F.lit(side).alias("side")).where("entity is not null and tick is not null and id is not null")

    edges = F.array_distinct(F.array(F.shiftright(F.col("tick") - tolerance, BLOCK_BITS), F.shiftright(F.col("tick") + tolerance, BLOCK_BITS)))
    a = of(left, left_id, 1).withColumns({"block": F.shiftright("tick", BLOCK_BITS), "due": F.col("tick")})
    b = of(right, right_id, 0).withColumns({"block": F.explode(edges), "due": F.col("tick") - tolerance})
    both = a.unionByName(b).repartition("entity", "block").sortWithinPartitions("entity", "block", "due", "side", "id")
    return both.mapInPandas(_merge(tolerance), "left_id long, right_id long, offset long").distinct()


def hits_with_impulse(hit_event: DataFrame, audio_impulse: DataFrame, tolerance: int = 6) -> DataFrame:
    """Hits with the nearest impulse of their match at most ``tolerance`` frames away: hit_id, audio_id, offset."""
    out = nearest_within(hit_event, audio_impulse, "match_id", "frame", "hit_id", "audio_id", tolerance)
    return out.select(F.col("left_id").alias("hit_id"), F.col("right_id").alias("audio_id"), "offset")
