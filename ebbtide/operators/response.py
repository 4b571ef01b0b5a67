"""Turning scores into actions: rules, target lists, budgets, holdout groups and readouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import bucket_percent, ratio
from ebbtide.plans import first_per_group, prefix_sum

RULE_COLUMNS = (
    "rule_id int, risk_lo double, risk_hi double, value_lo double, value_hi double, "
    "action string, cost double"
)
STRIPS = 64
Z_95 = 1.959963984540054


class OverlappingRules(ValueError):
    """Some customer could fall under two rules."""


def _strip(risk: Column) -> Column:
    """Which of equal strips of [0, 1] a risk falls in; outside values go to the end strips."""
    inside = F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0))
    return F.floor(inside * STRIPS).cast("int")


def _by_strip(rules: DataFrame) -> DataFrame:
    """Each rule once per strip it touches, open ends filled in, empty bands left out."""
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    return (
        rules.withColumn("risk_lo", F.coalesce("risk_lo", low))
        .withColumn("risk_hi", F.coalesce("risk_hi", high))
        .withColumn("value_lo", F.coalesce("value_lo", low))
        .withColumn("value_hi", F.coalesce("value_hi", high))
        .filter("risk_lo < risk_hi and value_lo < value_hi")
        .withColumn(
            "strip", F.explode(F.sequence(_strip(F.col("risk_lo")), _strip(F.col("risk_hi"))))
        )
    )


def check_rules(rules: DataFrame) -> DataFrame:
    """rule_a, rule_b: pairs whose half-open risk and value bands overlap."""
    spread = _by_strip(rules).select(
        "strip", "rule_id", "risk_lo", "risk_hi", "value_lo", "value_hi"
    )
    a, b = spread.alias("a"), spread.alias("b")
    meet = (
        (F.col("a.strip") == F.col("b.strip"))
        & (F.col("a.rule_id") < F.col("b.rule_id"))
        & (F.col("a.risk_lo") < F.col("b.risk_hi"))
        & (F.col("b.risk_lo") < F.col("a.risk_hi"))
        & (F.col("a.value_lo") < F.col("b.value_hi"))
        & (F.col("b.value_lo") < F.col("a.value_hi"))
    )
    return (
        a.join(b, meet)
        .select(F.col("a.rule_id").alias("rule_a"), F.col("b.rule_id").alias("rule_b"))
        .distinct()
    )


def assign_action(valued: DataFrame, rules: DataFrame) -> DataFrame:
    """k, risk, value, at_risk, rule_id, action, cost: the rule whose bands hold the customer.

    Bands are half-open, [lo, hi), null meaning no bound; customers under no rule keep nulls.
    Overlapping rules are refused, so there is one row per customer.

    Rules are spread over strips of risk, which makes this a join on equal strips. Rules whose
    size the planner knows to be small (`ebbtide.sources.literal_rows`) are broadcast;
    otherwise customers and rules shuffle on strips, which skew handling splits.
    """
    clash = check_rules(rules).first()
    if clash is not None:
        raise OverlappingRules(f"rules {clash.rule_a} and {clash.rule_b} overlap")
    spread = _by_strip(rules)
    customers = valued.withColumn("strip", _strip(F.col("risk")))
    inside = (
        (customers.strip == spread.strip)
        & (F.col("risk") >= F.col("risk_lo"))
        & (F.col("risk") < F.col("risk_hi"))
        & (F.col("value") >= F.col("value_lo"))
        & (F.col("value") < F.col("value_hi"))
    )
    return customers.join(spread, inside, "left").select(
        "k", "risk", "value", "at_risk", "rule_id", "action", "cost"
    )


def top_targets(valued: DataFrame, dims: DataFrame, by: str, n: int) -> DataFrame:
    """`by`, rank, k, at_risk: the n customers with most value at risk per dimension value."""
    placed = valued.join(dims.select("k", by), "k", "left").select(by, "k", "at_risk")
    return first_per_group(placed, [by], [F.desc("at_risk"), F.asc("k")], n, "k", "rank")


def budget_list(assigned: DataFrame, budget: float, priority: str = "at_risk") -> DataFrame:
    """k, priority, cost, spent: customers in priority order while their total cost fits.

    A strict prefix: the list ends at the first customer who does not fit. Ties go by key;
    customers without an action are not listed; costs must not be negative.
    """
    cost = F.when(F.col("cost") < 0, F.raise_error(F.lit("negative cost"))).otherwise(F.col("cost"))
    listed = assigned.filter(F.col("cost").isNotNull()).select(
        "k", F.col(priority).alias("priority"), cost.alias("cost")
    )
    order = [F.desc("priority"), F.asc("k")]
    return prefix_sum(listed, order, F.col("cost"), "spent", at_most=budget)


def holdout(customers: DataFrame, salt: str, pct: int) -> DataFrame:
    """k, arm: a stable split; about pct percent are `control`, the others `treated`."""
    control = bucket_percent(F.col("k"), salt) < pct
    return customers.select("k", F.when(control, "control").otherwise("treated").alias("arm"))


def experiment_readout(assigned: DataFrame, label: DataFrame) -> DataFrame:
    """One row: both arms' customers, churned and rate; treated minus control with its 95%
    interval; two-proportion z. Null where an arm is empty or, for z, nothing varies."""

    def arm(name: str) -> list[Column]:
        here = F.col("arm") == name
        return [
            F.count_if(here).alias(f"{name}_n"),
            F.count_if(here & (F.col("churned") == 1)).alias(f"{name}_churned"),
        ]

    n1, c1, n0, c0 = (
        F.col(c).cast("double")
        for c in ("treated_n", "treated_churned", "control_n", "control_churned")
    )
    p1, p0, p = ratio(c1, n1), ratio(c0, n0), ratio(c1 + c0, n1 + n0)
    error = F.sqrt(ratio(p1 * (1 - p1), n1) + ratio(p0 * (1 - p0), n0))
    pooled = F.sqrt(p * (1 - p) * (ratio(F.lit(1), n1) + ratio(F.lit(1), n0)))
    return (
        assigned.join(label, "k")
        .agg(*arm("treated"), *arm("control"))
        .select(
            "*",
            p1.alias("treated_rate"),
            p0.alias("control_rate"),
            (p1 - p0).alias("difference"),
            (p1 - p0 - Z_95 * error).alias("low"),
            (p1 - p0 + Z_95 * error).alias("high"),
            ratio(p1 - p0, pooled).alias("z"),
        )
    )
