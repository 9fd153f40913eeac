"""Every registered query agrees with its SQL on a small scale factor."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, oracle_connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF_DIR)


# At this scale no event of the broken kind exists, so nothing is quarantined.
MAY_BE_EMPTY = {"landing_quarantine"}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, oracle, name):
    problem = compare(spark, oracle, name, queries()[name], oracle_sql().get(name), SF_DIR)
    assert problem is None or (name in MAY_BE_EMPTY and problem == "both sides are empty")


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert {r["_date"] for r in entry(spark).collect()} == {"1998-03-25"}
