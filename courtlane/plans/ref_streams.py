"""Reference queries: behaviour over time, each run as a stream over the files that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlane.plans.views import Registry, table
from courtlane.session import join_small, match_info
from courtlane.streaming import events as E

add = Registry()


@add("", "f AS (SELECT DISTINCT match_id, frame, visibility FROM sidecar WHERE match_id IS NOT NULL AND frame IS NOT NULL)", "SELECT match_id, CAST(floor((frame - 4) / 8) * 8 + 4 AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS frames, CAST(sum(coalesce(visibility, 0)) AS BIGINT) AS visible FROM f GROUP BY ALL")
def i01_count_windows(spark, sf):
    """Windows of eight frames from half a window on, as a stream; repeated rows of a frame are dropped by its state."""
    return _windows(spark, sf, "windows", 8, 4)


def _windows(spark, sf, label, *numbers):
    """Files are taken in one batch: in complete mode each batch writes all of the state. The state holds a word for 64 frames; windows are counted on its last result."""
    s = E.read_stream(spark, sf, "sidecar", 1_000_000).where("match_id is not null and frame is not null")
    return E.count_windows(E.run_available(E.frame_words(s, *numbers), label, "complete"), *numbers)


@add("", "f AS (SELECT DISTINCT match_id, frame, visibility FROM sidecar WHERE match_id IS NOT NULL AND frame IS NOT NULL), g AS (SELECT *, unnest([floor(frame / 2) * 2, floor(frame / 2) * 2 - 2, floor(frame / 2) * 2 - 4, floor(frame / 2) * 2 - 6]) AS s FROM f)", "SELECT match_id, CAST(s AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS frames, CAST(sum(coalesce(visibility, 0)) AS BIGINT) AS visible FROM g GROUP BY ALL")
def i01_sliding_windows(spark, sf):
    """Windows of eight frames that begin every two frames, as a stream."""
    return _windows(spark, sf, "slides", 8, 0, 2)


_GAP = "h AS (SELECT DISTINCT s.match_id, frame, coalesce(fps, 30) AS fps FROM sidecar s LEFT JOIN (SELECT match_id, max(fps) AS fps FROM match_info GROUP BY 1) m USING (match_id) WHERE hit = 1 AND frame IS NOT NULL AND s.match_id IS NOT NULL), c AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY match_id ORDER BY frame) <= 5 * fps THEN 0 ELSE 1 END AS o FROM h), r AS (SELECT *, sum(o) OVER (PARTITION BY match_id ORDER BY frame) AS n FROM c)"


@add("", _GAP, "SELECT match_id, min(frame) AS start_frame, max(frame) AS end_frame FROM r GROUP BY match_id, n")
def i02_stream_sessions(spark, sf):
    """At each match's own frame rate (30 where it is unknown); complete mode, so that open sessions count."""
    s = E.read_stream(spark, sf, "sidecar").where("hit = 1 and frame is not null and match_id is not null").select("match_id", "frame")
    s = join_small(s, match_info(spark, sf).select("match_id", "fps"), ["match_id"])
    return E.run_available(E.sessions(s, F.coalesce("fps", F.lit(30)).cast("double")), "sessions", "complete")


@add("", "p AS (SELECT match_id, frame, max(x) AS x, max(y) AS y FROM sidecar WHERE visibility = 1 AND frame IS NOT NULL AND match_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY ALL), s AS (SELECT a.match_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON b.match_id = a.match_id AND b.frame = a.frame - 1)", "SELECT m.match_id, CAST(m.last_frame AS BIGINT) AS last_frame, round(coalesce(sum(d), 0), 3) AS path_px, CAST(count(d) AS BIGINT) AS steps FROM (SELECT match_id, max(frame) AS last_frame FROM p GROUP BY match_id) m LEFT JOIN s USING (match_id) GROUP BY ALL")
def i03_stream_paths(spark, sf):
    """Files are taken in one batch here, as the rows of a match lie in any order over the files; the last state of each match is its result."""
    s = E.read_stream(spark, sf, "sidecar", 1_000_000).where("visibility = 1 and frame is not null and match_id is not null and x is not null and y is not null").select("match_id", "frame", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    out = E.run_available(E.path_lengths(s), "paths")
    return out.groupBy("match_id").agg(F.max("last_frame").alias("last_frame"), F.round(F.max_by("path_px", "last_frame"), 3).alias("path_px"), F.max("steps").alias("steps"))


@add("", "h AS (SELECT DISTINCT match_id, frame FROM hit_event WHERE match_id IS NOT NULL AND frame IS NOT NULL), l AS (SELECT match_id, frame, lead(frame) OVER (PARTITION BY match_id ORDER BY frame) AS e FROM h)", "SELECT match_id, CAST(frame AS BIGINT) AS start_frame, CAST(e AS BIGINT) AS end_frame FROM l WHERE e IS NOT NULL")
def i04_stream_closed_shots(spark, sf):
    s = E.read_stream(spark, sf, "hit_event", 1_000_000).where("frame is not null and match_id is not null").select("match_id", "frame")
    return E.run_available(E.closed_shots(s), "shots")
