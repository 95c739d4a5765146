"""Stretches of activity separated by quiet time (problem 3), by occupancy bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtlane.session import join_small

#: Ticks (frames) in one bitmap; a bitmap has BLOCK / 64 words.
BLOCK = 1 << 16


def close_bitmap(bits: int, gap: int) -> int:
    """Morphological closing of a bitmap held in an int: set bits at most ``gap`` ticks apart become joined.

    The dilation to the right by ``gap`` - 1 ticks is built from shifts that double, about 2 log2(gap) of them; the bits that
    the dilation adds behind a run's last event are removed by eroding with the same window.
    """
    width, out = 1, bits  # out covers ticks t .. t + width - 1 of every set bit
    while width < gap:
        step = min(width, gap - width)
        out |= out << step
        width += step
    width, back = 1, out
    while width < gap:
        step = min(width, gap - width)
        back &= back >> step
        width += step
    return back | bits


def bitmap_runs(words: np.ndarray, masks: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First tick, last tick and number of events of each run of a block's bitmap, given as word numbers and 64-bit masks."""
    full = np.zeros(BLOCK // 64, dtype="<u8")
    full[words] = masks.astype("<i8").view("<u8")
    raw = full.tobytes()
    closed = close_bitmap(int.from_bytes(raw, "little"), gap) & ((1 << BLOCK) - 1)
    hit = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little")
    run = np.unpackbits(np.frombuffer(closed.to_bytes(BLOCK // 8, "little"), dtype=np.uint8), bitorder="little")
    edge = np.diff(np.concatenate(([0], run.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    events = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
    return first, last, events[last + 1] - events[first]


def _runs_of_blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for entity, block, gap, cells in zip(part["entity"], part["block"], part["gap"], part["cells"]):
            word = np.fromiter((c["word"] for c in cells), dtype=np.int64, count=len(cells)) - block * (BLOCK // 64)
            mask = np.fromiter((c["mask"] for c in cells), dtype=np.int64, count=len(cells))
            first, last, events = bitmap_runs(word, mask, int(gap))
            n = len(first)
            edge = np.zeros(n, dtype=bool)
            edge[[0, n - 1]] = True
            out.append(pd.DataFrame({"entity": entity, "gap": gap, "first": first + block * BLOCK, "last": last + block * BLOCK, "events": events, "edge": edge}))
        yield pd.concat(out) if out else pd.DataFrame({"entity": [], "gap": [], "first": [], "last": [], "events": [], "edge": []})


def sessions(events: DataFrame, entity: str, tick: str, gap: str) -> DataFrame:
    """Longest series of events of an entity in which neighbours lie at most ``gap`` ticks apart.

    ``events`` has the columns ``entity`` (BIGINT), ``tick`` (integer) and ``gap`` (integer, constant per entity, 1 or more). Result: entity,
    first, last, events (number of distinct ticks). Rows with a null in any of the three are left out, repeated rows count once, an empty
    table gives an empty result.

    Ticks become set bits of 64-bit words (a map-side combined bit_or, so a hot entity costs nothing extra), words become blocks of BLOCK
    ticks, each block is closed and cut into runs by itself. Only the first and the last run of a block can go on in another block;
    these few are merged by a window over the entity.
    """
    e = events.select(F.col(entity).cast("long").alias("entity"), F.col(tick).cast("long").alias("tick"), F.col(gap).cast("long").alias("gap")).where("entity is not null and tick is not null and gap is not null")
    cells = e.groupBy("entity", "gap", F.shiftright("tick", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(tick & 63 as int))")).alias("mask"))
    blocks = cells.groupBy("entity", "gap", F.shiftright("word", (BLOCK // 64).bit_length() - 1).alias("block")).agg(F.collect_list(F.struct("word", "mask")).alias("cells"))
    runs = blocks.mapInPandas(_runs_of_blocks, "entity long, gap long, first long, last long, events long, edge boolean")
    w = Window.partitionBy("entity").orderBy("first")
    inner = runs.where("not edge").select("entity", "first", "last", "events")
    edge = runs.where("edge").withColumn("opens", F.when(F.col("first") - F.lag("last").over(w) <= F.col("gap"), 0).otherwise(1))
    seam = edge.withColumn("n", F.sum("opens").over(w)).groupBy("entity", "n").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events")).drop("n")
    return inner.unionByName(seam)


def rally_sessions(sidecar: DataFrame, info: DataFrame, quiet_seconds: float = 5.0, default_fps: int = 30) -> DataFrame:
    """Stretches of play: match_id, start_frame, end_frame, duration_seconds, hit_frames.

    A hit frame has hit 1 and a frame; its rallyid is ignored. ``info`` has one row per match with fps; a match without a positive fps
    is read at ``default_fps``. duration_seconds is (end_frame - start_frame) / fps. A match without hits gives no row.
    """
    rate = info.select("match_id", F.when(F.col("fps") > 0, F.col("fps")).alias("fps"))
    hits = sidecar.where("hit = 1 and frame is not null and match_id is not null").select("match_id", "frame")
    hits = join_small(hits, rate, ["match_id"]).withColumn("fps", F.coalesce("fps", F.lit(default_fps)))
    found = sessions(hits.withColumn("gap", F.floor(F.col("fps") * F.lit(quiet_seconds))), "match_id", "frame", "gap")
    out = join_small(found.withColumnRenamed("entity", "match_id"), rate, ["match_id"])
    return out.select(
        "match_id", F.col("first").cast("int").alias("start_frame"), F.col("last").cast("int").alias("end_frame"),
        ((F.col("last") - F.col("first")) / F.coalesce("fps", F.lit(default_fps))).alias("duration_seconds"), F.col("events").alias("hit_frames"),
    )
