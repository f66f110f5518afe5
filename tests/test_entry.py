import importlib
import sys

import __spark_entry__
import pytest

from lonepoint.plans import registry
from tests.oracle import assert_same


def test_contract():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(registry.QUERIES) <= set(queries)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id"]
    assert_same(spark, "/root/testdata/sf0.001", lambda spark, d: __spark_entry__.entry(spark), registry.ORACLES["pure_outliers"])


@pytest.mark.parametrize("missing", ["lonepoint.llm", "corpus_pipeline", "public_tokenizers", "regex"])
def test_the_other_queries_without_llm(missing, monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("lonepoint.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    with pytest.warns(UserWarning, match="without the llm queries"):
        assert set(__spark_entry__.queries()) == set(registry.QUERIES)
        assert set(__spark_entry__.oracle_sql()) == set(registry.ORACLES)


def test_errors_of_the_library_itself_show(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError("no", name="lonepoint.operators.gone")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()


@pytest.mark.parametrize("name", ["pure_outliers", "range_join_1d", "lshod_pure"])
def test_plans_keep_to_equality_joins(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
