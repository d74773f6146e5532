"""The operators marked native run no Python on the executors."""

import pytest

from rivulet.llm import queries

NODES = ("Python", "Pandas", "Arrow")


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_pii", "op8_mixing"])
def test_native_queries_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in NODES if n in plan]


def test_scans_read_only_needed_columns(spark):
    plan = queries.QUERIES["op7_licenses"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
