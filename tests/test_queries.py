"""Every registered graph query against its SQL, on the smallest tables."""

import pytest

from quivera.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert compare(df, con, ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0
