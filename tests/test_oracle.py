"""Every core query that has SQL, against DuckDB."""

import pytest
from helpers import duck_rows, rows

from courtlane.plans import core, core_sql, reference

QUERIES, SQL = core.QUERIES | reference.QUERIES, core_sql.SQL | reference.SQL


#: What the smallest tables hold no case of.
RARE = {"c05_mixed_static_locks", "c06_raw_model_locks", "c07_prediction_locks", "f21_split_hits"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, sf, name):
    assert rows(QUERIES[name](spark, sf)) == duck_rows(sf, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    """Without SQL: the query gives rows (but for what is rare at this size), and none twice."""
    df = QUERIES[name](spark, sf)
    cols, got = rows(df)
    assert len(cols) == len(set(cols)) and len(got) == len(set(got)) and (got or name in RARE)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())
