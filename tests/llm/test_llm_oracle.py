"""Every query of the subpackage that has SQL, against DuckDB; the others run."""

import pytest

queries = pytest.importorskip("courtlane.llm.queries")
from helpers import duck_rows, rows  # noqa: E402

from courtlane.llm import sql  # noqa: E402


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_equals_duckdb(spark, sf, name):
    assert rows(queries.QUERIES[name](spark, sf)) == duck_rows(sf, sql.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() >= 0
