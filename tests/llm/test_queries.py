import pytest

from lonepoint.llm import registry
from tests.oracle import assert_same

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query_equals_its_sql(spark, name):
    assert_same(spark, DIR, registry.QUERIES[name], registry.ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n != "pipeline") == list(range(1, 11))
