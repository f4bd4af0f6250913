"""Every registered query against its oracle on the smallest tables."""

import os

import pytest

from tidemark.plans.catalog import ORACLES, QUERIES
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, name, SF)
    assert ok, note


def test_names():
    assert set(ORACLES) <= set(QUERIES)
