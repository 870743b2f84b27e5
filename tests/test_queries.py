import pytest

from loomline import catalog
from tests.oracle_check import differences


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_agrees_with_its_sql(spark, name):
    if name not in catalog.ORACLES:
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
        return
    only, n = differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], "/root/testdata/sf0.01")
    assert only[:4] == [] and n > 0
