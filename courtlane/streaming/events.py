"""Stateful versions of the frame operators for Structured Streaming.

Event time is frame / fps since the start of a match. Late rows, beyond the watermark, are dropped by Spark and counted in the progress of the
query (``late_rows``). State is kept per match, except for sessions, whose state is one open interval.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from courtlane.session import work_path


def read_stream(spark: SparkSession, sf: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """The table as a stream of its files, with the schema of the stored table."""
    path = f"{sf}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there now and gives its result as a table in the shared folder; in complete mode the last result only."""
    spark = stream.sparkSession
    base = work_path(spark, f"stream-{label}")
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over the progress reports still kept."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def _stretch(length: int, slide: int) -> int:
    """Frames from one stretch of whole windows to the next; a stretch has at most 64."""
    return ((64 - length) // slide + 1) * slide


def _pane(length: int, slide: int) -> int | None:
    """Frames of the equal parts that windows longer than a word are put together from: the largest divisor of ``slide`` up to 64. None for windows that fit into a word."""
    if not 0 < slide <= length or length % slide:
        raise ValueError("length must be a multiple of slide")
    return max(d for d in range(1, 65) if slide % d == 0) if length > 64 else None


def frame_words(frames: DataFrame, length: int, offset: int = 0, slide: int | None = None) -> DataFrame:
    """The state of ``count_windows``: match_id, stretch, visibility and a word with a bit for each frame of the stretch that has a row of that visibility. Repeated rows set the same bit, so
    there is no state per row. The same for batch and stream. A stretch holds whole windows, or panes of longer ones; frames at its start end the one before, too."""
    slide = slide or length
    if pane := _pane(length, slide):
        return frame_words(frames, pane, offset)
    step = _stretch(length, slide)
    at = F.col("frame").cast("long") - offset
    last = F.floor(at / step).cast("long")
    both = F.array(F.struct(last.alias("stretch"), F.pmod(at, F.lit(step)).alias("bit")), F.struct((last - 1).alias("stretch"), (F.pmod(at, F.lit(step)) + step).alias("bit")))
    w = frames.select("match_id", "visibility", F.explode(both).alias("s")).where(F.col("s.bit") < step - slide + length)
    return w.groupBy("match_id", F.col("s.stretch").alias("stretch"), "visibility").agg(F.bit_or(F.expr("shiftleft(1L, cast(s.bit as int))")).alias("word"))


def count_windows(words: DataFrame, length: int, offset: int = 0, slide: int | None = None) -> DataFrame:
    """Windows of ``length`` frames, one every ``slide`` frames (tumbling where it isn't given), that begin at ``offset`` plus multiples: match_id, window_start, frames, visible. ``words`` come
    from ``frame_words`` with the same numbers. Rows of one frame that differ in visibility count apart; windows at a match's ends hold fewer frames. Any ``length``, a multiple of ``slide``."""
    slide = slide or length
    if pane := _pane(length, slide):
        last = F.floor((F.col("window_start") - offset) / slide) * slide + offset
        starts = F.explode(F.array(*[(last - k * slide).cast("long") for k in range(length // slide)]))
        p = count_windows(words, pane, offset).select("match_id", starts.alias("window_start"), "frames", "visible")
        return p.groupBy("match_id", "window_start").agg(F.sum("frames").alias("frames"), F.sum("visible").alias("visible"))
    step = _stretch(length, slide)
    ones = F.lit(-1 if length == 64 else (1 << length) - 1)
    n = lambda word, k: F.bit_count(F.expr("shiftrightunsigned({}, {})".format(word, k)).bitwiseAND(ones)).cast("long")
    seen = F.coalesce("visibility", F.lit(0)).cast("long")
    each = [F.struct(F.sum(n("word", k)).alias("frames"), F.sum(n("word", k) * seen).alias("visible"), F.lit(k).alias("k")) for k in range(0, step, slide)]
    g = words.groupBy("match_id", "stretch").agg(F.array(*each).alias("w")).select("match_id", "stretch", F.explode("w").alias("w")).where("w.frames > 0")
    return g.select("match_id", (F.col("stretch") * step + offset + F.col("w.k")).alias("window_start"), "w.frames", "w.visible")


def sessions(hits: DataFrame, fps: int | Column, seconds: int = 5, delay: str = "1 hour") -> DataFrame:
    """Stretches of hits with at most ``seconds`` in between, as session windows: match_id, start_frame, end_frame. ``fps`` is a number or a column of ``hits``.

    Session windows part at a gap of the given length, the operator only at a longer one, so a microsecond is added.
    """
    at = F.timestamp_seconds(F.col("frame") / (fps if isinstance(fps, Column) else F.lit(float(fps))))
    e = hits.withColumn("at", at).withWatermark("at", delay)
    return e.groupBy("match_id", F.session_window("at", f"{seconds} seconds 1 microsecond").alias("w")).agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame")).select("match_id", "start_frame", "end_frame")


def _motion(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, path, n, x, y = state.get if state.exists else (-1, 0.0, 0, None, None)
    rows = pd.concat(list(parts)).drop_duplicates("frame").sort_values("frame")
    for frame, px, py in rows[["frame", "x", "y"]].itertuples(index=False, name=None):
        if frame <= last:
            continue
        if x is not None and frame - last == 1:
            path += ((px - x) ** 2 + (py - y) ** 2) ** 0.5
            n += 1
        last, x, y = int(frame), float(px), float(py)
    state.update((last, path, n, x, y))
    yield pd.DataFrame({"match_id": [key[0]], "last_frame": [last], "path_px": [path], "steps": [n]})


def path_lengths(points: DataFrame) -> DataFrame:
    """Running path of the ball per match over steps between neighbouring frames, emitted after each micro-batch: match_id, last_frame, path_px, steps. Rows at or before the last frame seen are
    ignored (late or repeated)."""
    return points.groupBy("match_id").applyInPandasWithState(_motion, "match_id long, last_frame long, path_px double, steps long", "last long, path double, n long, x double, y double", "append", GroupStateTimeout.NoTimeout)


def _back_fill(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    open_hit = state.get[0] if state.exists else None
    out = []
    for frame in sorted(set(int(f) for part in parts for f in part["frame"])):
        if open_hit is not None and frame > open_hit:
            out.append((key[0], open_hit, frame))
        if open_hit is None or frame > open_hit:
            open_hit = frame
    state.update((open_hit,))
    yield pd.DataFrame(out, columns=["match_id", "start_frame", "end_frame"]).astype("int64")


def closed_shots(hits: DataFrame) -> DataFrame:
    """A shot is written when the next hit arrives: match_id, start_frame, end_frame. The last hit of a match stays open in the state."""
    return hits.groupBy("match_id").applyInPandasWithState(_back_fill, "match_id long, start_frame long, end_frame long", "frame long", "append", GroupStateTimeout.NoTimeout)
