"""Every query with SQL gives the rows of its SQL; every other one runs."""

import pytest

from loomgraph.plans.queries import ORACLE_SQL, QUERIES

from .compare import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    if name in ORACLE_SQL:
        assert not differences(spark, con, QUERIES[name], ORACLE_SQL[name], SF)
    else:
        assert QUERIES[name](spark, SF).columns
        assert QUERIES[name](spark, SF).count() >= 0
