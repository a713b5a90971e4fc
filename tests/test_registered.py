"""Every registered query against its check SQL on the smallest data set."""

import pytest

from __spark_entry__ import entry
from rxweave.catalog import CHECKS, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"



@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "collect_list"):
        assert word not in plan
    status, n, _, note = compare(spark, con, SF, name, lambda *_: df, CHECKS.get(name))
    assert status in ("ok", "rows"), note
    assert n > 0


def test_entry(spark):
    df = entry(spark)
    assert df.limit(1).count() == 1 and "drug_1" in df.columns
