"""Oracle SQL (DuckDB) of the pN_ queries of this subpackage; each is written by another way than the operator."""

SQL = {
    "p2_found": r"""
WITH r AS (SELECT match_id, lower(trim(phase, E' \t\r\n')) AS phase, TRY_CAST(trim(frame) AS DOUBLE) AS f, TRY_CAST(trim(visibility) AS DOUBLE) AS v, row_id, exported_at,
    CASE WHEN trim(source) = '' THEN NULL ELSE source END AS source, confidence, x, y FROM ball_raw),
k AS (SELECT match_id, phase, CAST(trunc(f) AS INTEGER) AS frame, row_id, source, confidence, row_number() OVER (PARTITION BY match_id, phase, trunc(f) ORDER BY
    CASE WHEN isfinite(v) AND trunc(v) = 1 THEN 0 WHEN isfinite(v) AND trunc(v) = 0 THEN 1 ELSE 2 END,
    (x IS NOT NULL)::INT + (y IS NOT NULL)::INT + (source IS NOT NULL)::INT + (confidence IS NOT NULL)::INT DESC, exported_at DESC NULLS LAST, row_id DESC) AS n
  FROM r WHERE isfinite(f) AND phase IN ('primary', 'secondary'))
SELECT match_id, phase, frame, arg_min(row_id, n) AS row_id, coalesce(arg_min(row_id, n) FILTER (source IS NOT NULL), -1) AS source_row_id, coalesce(arg_min(row_id, n) FILTER (confidence IS NOT NULL), -1) AS confidence_row_id
FROM k GROUP BY match_id, phase, frame HAVING count(*) > 1""",
    "p6_nearest": """
WITH p AS (SELECT DISTINCT h.hit_id, h.frame AS hf, a.audio_id, CAST(a.frame - h.frame AS BIGINT) AS "offset" FROM hit_event h JOIN audio_impulse a ON h.match_id = a.match_id AND a.frame BETWEEN h.frame - 6 AND h.frame + 6)
SELECT hit_id, audio_id, "offset" FROM p QUALIFY row_number() OVER (PARTITION BY hit_id, hf ORDER BY abs("offset"), "offset", audio_id) = 1""",
}
SQL["p2_merged"] = r"""
WITH r AS (SELECT match_id, lower(trim(phase, E' \t\r\n')) AS phase, TRY_CAST(trim(frame) AS DOUBLE) AS f, TRY_CAST(trim(visibility) AS DOUBLE) AS v, row_id, exported_at,
    CASE WHEN trim(source) = '' THEN NULL ELSE trim(source) END AS source, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence, x, y FROM ball_raw),
s AS (SELECT *, CASE WHEN isfinite(v) AND trunc(v) = 1 THEN 2 WHEN isfinite(v) AND trunc(v) = 0 THEN 1 ELSE 0 END AS seen FROM r WHERE isfinite(f) AND phase IN ('primary', 'secondary') AND match_id IS NOT NULL),
k AS (SELECT *, CAST(trunc(f) AS INTEGER) AS frame, row_number() OVER (PARTITION BY match_id, phase, trunc(f) ORDER BY seen DESC,
    (x IS NOT NULL)::INT + (y IS NOT NULL)::INT + (source IS NOT NULL)::INT + (confidence IS NOT NULL)::INT DESC, exported_at DESC NULLS LAST, row_id DESC) AS n FROM s)
SELECT match_id, phase, frame, count(*) AS records, arg_min(row_id, n) AS row_id, arg_min(seen, n) AS seen, arg_min(x, n) FILTER (x IS NOT NULL) AS x, arg_min(y, n) FILTER (y IS NOT NULL) AS y,
  arg_min(source, n) FILTER (source IS NOT NULL) AS source, arg_min(confidence, n) FILTER (confidence IS NOT NULL) AS confidence FROM k GROUP BY match_id, phase, frame"""
SQL["p6_found"] = f"SELECT hit_id, audio_id FROM ({SQL['p6_nearest']})"
_P4 = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
SQL["p4_percentiles"] = f"""
WITH v AS (SELECT rallyid, shotavgspeedkmh AS v, row_number() OVER (PARTITION BY rallyid ORDER BY shotavgspeedkmh) AS r, count(*) OVER (PARTITION BY rallyid) AS n
  FROM sidecar WHERE shotavgspeedkmh IS NOT NULL AND NOT isnan(shotavgspeedkmh))
SELECT rallyid, n, {", ".join(f"round(max(CASE WHEN r = greatest(1, ceil(round({p} * n, 6))) THEN v END), 6) AS {c}" for c, p in _P4.items())}, CAST(44 * (n // 44000) AS BIGINT) AS rank_error
FROM v GROUP BY rallyid, n"""
SQL["p4_rank_errors"] = """
SELECT shotspeedquality, count(*) AS n, CAST(24 * (count(*) // 480) AS BIGINT) AS rank_error, true AS within FROM sidecar WHERE shotavgspeedkmh IS NOT NULL AND NOT isnan(shotavgspeedkmh) GROUP BY shotspeedquality"""
