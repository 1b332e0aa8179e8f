"""Plans: no Cartesian product, no row-at-a-time Python, one exchange for the window block."""

import pytest

from riskloom import catalog
from riskloom.operators import velocity
from riskloom.plans.adapters import Tables

SHAPES = ["velocity_1h_24h", "velocity_block", "rules_decisions", "feature_resolution", "blocklist_screen", "shared_entities", "similar_accounts", "case_state", "findings_outcome", "pattern_spike", "ranking_metrics", "drift_ks", "quality_report"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SHAPES)
def test_shape(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text


def test_one_exchange_for_the_velocity_block(spark, sf_dir):
    text = plan(velocity.velocity_block(Tables(spark, sf_dir)("v_txn")))
    assert text.count("Exchange hashpartitioning") == 1


def test_one_exchange_for_trailing_windows(spark, sf_dir):
    text = plan(velocity.trailing(Tables(spark, sf_dir)("v_txn"), {"1h": velocity.HOUR, "24h": velocity.DAY}))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1


def test_columns_reach_the_scan(spark, sf_dir):
    text = plan(catalog.QUERIES["filter_eval"](spark, sf_dir))
    assert "o_orderpriority" not in text.split("ReadSchema")[-1]
