"""All queries for the operators of the survey, with their oracle statements."""

from courtlane.plans import ref_fusion, ref_hits, ref_reports, ref_shots, ref_sources, ref_streams, ref_strokes, ref_tracks, ref_vetoes

_PARTS = (ref_sources.add, ref_vetoes.add, ref_fusion.add, ref_hits.add, ref_shots.add, ref_tracks.add, ref_streams.add, ref_strokes.add, ref_reports.add)
QUERIES = {n: f for part in _PARTS for n, f in part.queries.items()}
SQL = {n: s for part in _PARTS for n, s in part.sql.items()}
