import pytest

from loomline.llm import queries
from tests.oracle_check import differences


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_agrees_with_its_sql(spark, name):
    only, n = differences(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.01")
    assert only[:4] == [] and n > 0
