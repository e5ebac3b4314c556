import pytest

from tests.compare import connect, same
from vellumgrid.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
SLOW_SQL = {"q_fill_holes"}  # its SQL closes over all pairs of background cells


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalogue.SQL) - SLOW_SQL))
def test_equals_sql(spark, con, name):
    same(catalogue.QUERIES[name](spark, FOLDER), con, catalogue.SQL[name])
