"""Every registered query of the library against its oracle SQL, on the smallest tables."""

import os

import pytest

from lexforge.plans import catalogue
from tests import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_oracle(spark, con, name):
    oracle.compare(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name])


def test_names_agree():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
