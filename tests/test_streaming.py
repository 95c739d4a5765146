"""Streams: state over micro-batches equals the batch result; late rows are counted."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from courtlane.streaming import events


def write(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by their time


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_state_goes_on_over_batches(spark, folder):
    hits = [[(1, 30), (1, 10), (2, 5)], [(1, 50), (1, 30), (2, 9)], [(1, 20), (1, 80)]]
    write(spark, f"{folder}/hit_event.parquet", hits, "match_id long, frame long")
    s = events.read_stream(spark, folder, "hit_event", 1)
    got = sorted(tuple(r) for r in events.run_available(events.closed_shots(s), "t1").collect())
    assert got == [(1, 10, 30), (1, 30, 50), (1, 50, 80), (2, 5, 9)]  # the late hit at 20 is ignored


def test_paths_over_batches(spark, folder):
    rows = [(1, f, float(3 * f), float(4 * f)) for f in range(30)]
    write(spark, f"{folder}/sidecar.parquet", [rows[:10], rows[10:20][::-1], rows[20:] + rows[5:8]], "match_id long, frame long, x double, y double")
    s = events.read_stream(spark, folder, "sidecar", 1)
    out = events.run_available(events.path_lengths(s), "t2")
    last = out.orderBy("last_frame", ascending=False).first()
    assert (last.last_frame, last.path_px, last.steps) == (29, 145.0, 29)


def test_late_rows_are_dropped_and_counted(spark, folder):
    write(spark, f"{folder}/sidecar.parquet", [[(1, 0), (1, 30)], [(1, 30_000)], [(1, 31_000)], [(1, 60), (1, 90_000)]], "match_id long, frame long")
    s = events.sessions(events.read_stream(spark, folder, "sidecar", 1), 30, delay="10 seconds")
    q = s.writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert events.late_rows(q) == 1
    assert (1, 0, 30) in {tuple(r) for r in spark.table("late").collect()}


@pytest.mark.parametrize("numbers", [(8, 4, None), (8, 0, 2), (5, -3, 1), (64, 7, 64)])
def test_windows_by_words(spark, numbers):
    """Repeated rows count once, rows of one frame that differ in visibility apart; the state has a word for many frames, not a row for each."""
    length, offset, slide = numbers
    rng = random.Random(5)
    rows = [(m, rng.randrange(-70, 700), rng.choice([0, 1, 1, 1, 2, None])) for m in (1, 2) for _ in range(900)]
    want, seen = Counter(), Counter()
    for m, f, v in set(rows):
        last = (f - offset) // (slide or length) * (slide or length) + offset
        for s in range(last, f - length, -(slide or length)):
            want[m, s] += 1
            seen[m, s] += v or 0
    words = events.frame_words(spark.createDataFrame(rows, "match_id long, frame int, visibility int"), *numbers)
    got = {(r.match_id, r.window_start): (r.frames, r.visible) for r in events.count_windows(words, *numbers).collect()}
    assert got == {k: (n, seen[k]) for k, n in want.items()}
    if length == 8:
        assert words.count() < len(set(rows)) / 5


def test_windows_of_the_sidecar_come_in_one_batch(spark, folder, monkeypatch):
    from courtlane.plans import ref_streams

    for i in range(20):
        spark.range(i * 10, i * 10 + 10).select(F.lit(1).cast("long").alias("match_id"), F.col("id").cast("int").alias("frame"), F.lit(1).alias("visibility")).coalesce(1).write.mode("append").parquet(f"{folder}/sidecar.parquet")
    told, run = [], events.run_available
    monkeypatch.setattr(ref_streams.E, "run_available", lambda s, *a: (told.append(s), run(s, *a))[1])
    assert sum(r.frames for r in ref_streams.i01_count_windows(spark, folder).collect()) == 200
    monkeypatch.undo()
    batches = []
    told[0].writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/again").trigger(availableNow=True).foreachBatch(lambda df, k: batches.append(df.count())).start().awaitTermination()
    assert batches == [5]  # one batch; four words of 64 frames from frame 4 on, and one before it


@pytest.mark.parametrize("numbers", [(65, 0, None), (128, 4, 64), (100, -3, 20), (134, 7, 67), (96, 0, 1)])
def test_windows_longer_than_a_word(spark, numbers):
    """No length is refused: windows beyond 64 frames are put together from panes."""
    length, offset, slide = numbers
    rng = random.Random(6)
    rows = [(m, rng.randrange(-300, 900), rng.choice([0, 1, 1, 2, None])) for m in (1, 2) for _ in range(900)]
    want, seen = Counter(), Counter()
    for m, f, v in set(rows):
        last = (f - offset) // (slide or length) * (slide or length) + offset
        for s in range(last, f - length, -(slide or length)):
            want[m, s] += 1
            seen[m, s] += v or 0
    words = events.frame_words(spark.createDataFrame(rows, "match_id long, frame int, visibility int"), *numbers)
    got = {(r.match_id, r.window_start): (r.frames, r.visible) for r in events.count_windows(words, *numbers).collect()}
    assert got == {k: (n, seen[k]) for k, n in want.items()}
    assert words.count() < len(set(rows)) / 4


def test_windows_need_a_slide_that_divides_them(spark):
    frames = spark.createDataFrame([(1, 1, 1)], "match_id long, frame int, visibility int")
    for numbers in [(8, 0, 3), (8, 0, 16), (100, 0, 64), (8, 0, -8)]:
        with pytest.raises(ValueError):
            events.frame_words(frames, *numbers)
