"""Every registered query against its DuckDB oracle on the whole sf0.01 tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare
from tidemark.plans import catalog

# fitted models, which SQL cannot express: tests/test_publish.py holds them against own fits and fixed thresholds
NO_ORACLE = {"budget_curve", "calibrator_by_database", "leakage_audit", "program_ranker_held_out"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name) == ""


def test_every_query_has_an_oracle_unless_listed():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == NO_ORACLE
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
