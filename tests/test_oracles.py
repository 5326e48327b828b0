"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entries
import compare
from conftest import SMALL

QUERIES = entries.queries()
ORACLES = entries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, db, name):
    result = QUERIES[name](spark, SMALL)
    assert compare.spark_rows(result) == compare.sql_rows(db, ORACLES[name])
    assert compare.type_differences(result, db, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entries.entry(spark).count() > 0
