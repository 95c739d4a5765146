"""Oracle SQL (DuckDB) of the core pN_ queries; each is written by another way than the operator."""

_HITS = """
hits AS (SELECT DISTINCT s.match_id, s.frame, coalesce(m.fps, 30) AS fps FROM sidecar s
  LEFT JOIN (SELECT match_id, max(fps) AS fps FROM match_info GROUP BY 1) m USING (match_id)
  WHERE s.hit = 1 AND s.frame IS NOT NULL AND s.match_id IS NOT NULL),
cuts AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= 5 * fps THEN 0 ELSE 1 END AS opens FROM hits WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY match_id ORDER BY frame) AS n FROM cuts),
found AS (SELECT match_id, min(frame) AS start_frame, max(frame) AS end_frame, CAST(max(frame) - min(frame) AS DOUBLE) / max(fps) AS duration_seconds, count(*) AS hit_frames FROM runs GROUP BY match_id, n)
"""

_COVER = """
valid AS (SELECT 'track_range' AS interval_table, match_id, start_frame, end_frame FROM track_range
  UNION ALL SELECT 'rally_segment', match_id, start_frame, end_frame FROM rally_segment),
ok AS (SELECT * FROM valid WHERE match_id IS NOT NULL AND start_frame <= end_frame),
far AS (SELECT *, max(end_frame) OVER (PARTITION BY interval_table, match_id ORDER BY start_frame, end_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok),
cut AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_frame > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY interval_table, match_id ORDER BY start_frame, end_frame ROWS UNBOUNDED PRECEDING) AS n FROM far),
periods AS (SELECT interval_table, match_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM cut GROUP BY interval_table, match_id, n),
gaps AS (SELECT interval_table, match_id, end_frame + 1 AS start_frame, lead(start_frame) OVER (PARTITION BY interval_table, match_id ORDER BY start_frame) - 1 AS end_frame FROM periods)
"""

SQL = {
    "p3_sessions": f"WITH {_HITS} SELECT * FROM found",
    "p3_found": f"WITH {_HITS} SELECT match_id, start_frame, end_frame FROM found",
    "p5_found": f"WITH {_COVER} SELECT interval_table, match_id, 'period' AS kind, start_frame, end_frame FROM periods UNION ALL SELECT interval_table, match_id, 'gap', start_frame, end_frame FROM gaps WHERE end_frame IS NOT NULL",
}
