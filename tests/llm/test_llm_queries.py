import pytest
from oracle_check import connect, differences

SMALL = "/root/testdata/sf0.001"


def _names():
    from roadweave.llm.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query(spark, name):
    from roadweave.llm.queries import QUERIES
    from roadweave.llm.sql import ORACLE

    if name in ORACLE:
        assert differences(spark, name, QUERIES[name], ORACLE[name], SMALL, connect(SMALL)) == ""
    else:
        assert QUERIES[name](spark, SMALL).count() > 0
