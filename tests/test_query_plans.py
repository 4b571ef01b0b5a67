"""What the plans must not contain, and what they must keep, with broadcasts switched off."""

from __future__ import annotations

import re

import pytest
from conftest import TESTDATA

from ebbtide.suite.queries import QUERIES

SF = str(TESTDATA / "sf0.001")
BATCH = [n for n in QUERIES if not n.startswith("stream")]
# Aggregates to one row, and windows over rows already counted per quarter, day, band or slice.
ONE_TASK = {
    "load", "integrity_report", "gap_quantiles", "gap_quantiles_approx", "gap_quantiles_sketched", "growth_accounting",
    "survival_curve", "lift_table", "auc", "auc_model", "auc_model_value", "budget_list", "experiment_readout",
    "event_retention", "feature_correlation", "fit_churn_model",
}
# query: (scans, shuffles on keys)
SHAPE = {
    "order_days": (1, 1), "churn_label": (1, 1), "recency_state": (1, 1), "period_spine": (1, 1),
    "spend_trend": (1, 1), "purchase_gaps": (1, 2), "period_status": (1, 2), "spells": (1, 2),
    "last_orders": (1, 2), "return_share": (2, 3), "holdout": (1, 0), "sessions": (1, 2),
    "quiet_periods": (1, 2), "integrity_report": (6, 2),
}


@pytest.fixture(scope="module")
def plans(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = {n: QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString() for n in BATCH}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return out


def test_no_pairwise_joins_and_no_python(plans):
    bad = re.compile("CartesianProduct|NestedLoop|Python|InPandas|InArrow")
    assert {n: bad.findall(p) for n, p in plans.items() if bad.search(p)} == {}


def test_only_bounded_rows_meet_in_one_task(plans):
    assert {n for n, p in plans.items() if "SinglePartition" in p} <= ONE_TASK


@pytest.mark.parametrize("name", sorted(SHAPE))
def test_scans_and_shuffles(plans, name):
    p = plans[name]
    assert (p.count("FileScan"), p.count("Exchange hashpartitioning")) == SHAPE[name]


def test_aggregates_combine_before_the_first_shuffle(plans):
    for name in ("order_days", "churn_label", "period_spine", "sessions", "spend_trend"):
        below = plans[name].split("Exchange hashpartitioning")[-1]
        assert "HashAggregate" in below, name


def test_targets_are_cut_before_the_shuffle(plans):
    assert plans["top_targets"].count("WindowGroupLimit") == 4


def test_integrity_needs_no_join_of_keys(plans):
    assert "SortMergeJoin" not in plans["integrity_report"]


@pytest.mark.parametrize("name", ["assign_action", "rfm_segment"])
def test_small_rules_are_broadcast_by_their_known_size(spark, name):
    """With the settings as they come, without help from adaptive execution."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BroadcastHashJoin [strip" in p or "BroadcastHashJoin [r" in p
    # Of the cells only the rules, while they are put together, shuffle.
    assert "hashpartitioning(strip" not in p and p.count("hashpartitioning(r#") <= 1
