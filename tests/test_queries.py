import pytest
from oracle_check import connect, differences

from roadweave.plans import problems, reference

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLE = {**problems.QUERIES, **reference.QUERIES}, {**problems.ORACLE, **reference.ORACLE}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE:
        assert differences(spark, name, QUERIES[name], ORACLE[name], SMALL, con) == ""
    else:
        assert QUERIES[name](spark, SMALL).columns
        QUERIES[name](spark, SMALL).count()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
