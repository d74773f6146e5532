"""Plan checks: native queries stay in the JVM; pruning reaches the scan."""

import re

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from rivulet.plans.catalog import QUERIES

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonMapInArrow", "FlatMapGroupsInPandas")
PYTHON_QUERIES = {"model_batch_score"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_native_plans_have_no_python(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    found = [n for n in PYTHON_NODES if n in plan]
    if name in PYTHON_QUERIES:
        assert found, "the pluggable scorer should run as a pandas map"
    else:
        assert not found, f"{name} evaluates Python: {found}"


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(entry.queries()["readability_by_source"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("lang" not in s and "doc_id" not in s for s in schemas), schemas
    plan = _plan(entry.queries()["engagement_score"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("props" not in s and "value" not in s for s in schemas), schemas


def test_aggregates_combine_before_the_shuffle(spark):
    plan = _plan(entry.queries()["last_write_wins"](spark, SF_SMALL))
    assert "partial_max_by" in plan
    plan = _plan(entry.queries()["engagement_score"](spark, SF_SMALL))
    assert "partial_count_if" in plan or "partial_count(" in plan


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["source", "n_entries", "mean_readability", "mean_chars"]


@pytest.mark.parametrize("name", ["html_to_markdown", "summary_clean", "content_fallback", "markdown_to_html",
                                  "validate_entries", "log_once", "enrich_pipeline"])
def test_expensive_chains_are_evaluated_once(spark, name):
    """Catalyst copies an expression per reference; the HTML chain must
    appear once per plan (bound with ``let`` where a function reuses it)."""
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert plan.count("(?is)<script") <= 1
