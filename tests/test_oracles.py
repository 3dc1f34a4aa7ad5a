import pytest
from compare import assert_same, connect

from chalkline.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        assert_same(found, con.execute(SQL[name]).df())
    else:
        assert len(found)
