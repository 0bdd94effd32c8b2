"""The resolver's queries take each title through Python once: containment, then similarity, in one operator."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from quilate.functions import fixed_values as V

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
NAMES = ["resolve_counters", "resolve_snapshots", "match_rate", "resolve_priority", "source_match_rate"]


@pytest.mark.parametrize("name", NAMES)
def test_titles_are_searched_once(spark, name):
    plan = entry.queries()[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "search(" not in plan and plan.count("MapInPandas") == 1


@pytest.mark.parametrize("name", NAMES)
def test_titles_without_a_model_skip_rewrites_and_patterns(spark, name):
    plan = entry.queries()[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert all(f", {need}) THEN" in plan for need in (*(need for _, _, need in V.REWRITES_NEED), V.MODELS_NEED))


def test_shares_are_counted_without_a_join(spark):
    plan = entry.queries()["source_match_rate"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
