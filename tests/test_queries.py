"""Every registered query against its DuckDB counterpart, on the smallest fixture."""

import pytest
from tests.conftest import rows_of, rows_of_sql

from corpusloom.plans import catalogue


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.SQL])
def test_equals_sql(spark, duck, sf, name):
    assert rows_of(catalogue.QUERIES[name](spark, sf)) == rows_of_sql(duck, catalogue.SQL[name])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL])
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 10 * 40
    assert set(e.oracle_sql()) <= set(e.queries())
