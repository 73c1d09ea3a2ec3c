"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from knotwork.plans.oracles import ORACLES
from knotwork.plans.queries import QUERIES
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    ok, _, _, note = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert ok, note
