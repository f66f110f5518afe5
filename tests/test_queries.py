import pytest

from lonepoint.plans import registry
from tests.oracle import assert_same

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query_equals_its_sql(spark, name):
    assert_same(spark, DIR, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs_and_repeats(spark, name):
    a, b = (sorted(map(repr, registry.QUERIES[name](spark, DIR).collect())) for _ in range(2))
    assert a == b and a
