"""Every registered query against its SQL in DuckDB, on whole tables."""

import os

import pytest

import check_oracles as co
from conftest import SF
from tabloom.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return co.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, _, message = co.compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
