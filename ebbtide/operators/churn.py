"""Defining churn from order history and measuring it over time.

`k` is the customer, `d` an order date, `q` a quarter index (year * 4 + quarter - 1).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.functions import day, quarter_index, ratio
from ebbtide.functions.columns import quarter_of
from ebbtide.operators.preparation import active_quarters, between

STATUSES = ("new", "retained", "resurrected", "churned", "dormant")

SKETCH_SIZE = 4096


class UnobservedHorizon(ValueError):
    """The outcome window runs past the last day with data, so quiet is not yet churned."""


def purchase_gaps(order_days: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """k, d, prev, gap: days from each customer's previous order day; none for the first.

    With `last` (k, d: each customer's last order day before those of `order_days`), gaps of new
    days come from those days and that table, without the order days in between.
    """
    prev = F.lag("d").over(W.partitionBy("k").orderBy("d"))
    days = order_days.select("k", "d", F.lit(True).alias("new"))
    if last is not None:
        days = days.unionByName(last.select("k", "d", F.lit(False).alias("new")))
    return (
        days.withColumn("prev", prev)
        .filter(F.col("prev").isNotNull() & F.col("new"))
        .drop("new")
        .withColumn("gap", F.datediff("d", "prev").cast("bigint"))
    )


def gap_quantiles(gaps: DataFrame, probs: Sequence[float], exact: bool = True) -> DataFrame:
    """prob, gap: quantiles of the gaps, to choose how long a silence means churn.

    Exact interpolates between neighbours. It works on the count per distinct gap, which the
    calendar bounds, never on the gaps themselves.
    """
    probs = [float(p) for p in probs]
    if exact:
        cuts = (
            gaps.groupBy("gap")
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.percentile("gap", probs, F.col("n")).alias("cuts"))
        )
    else:
        cuts = gaps.agg(F.percentile_approx("gap", probs, 10000).cast("array<double>").alias("cuts"))
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("prob"), F.col("cuts"))
    return (
        cuts.filter(F.col("cuts").isNotNull())
        .select(F.explode(pairs).alias("p"))
        .select(F.col("p.prob").alias("prob"), F.col("p.cuts").alias("gap"))
    )


def gap_sketches(gaps: DataFrame, by: Sequence[str] = ("d",), k: int = SKETCH_SIZE) -> DataFrame:
    """`by` columns, gaps, sketch: one mergeable sketch of the gaps per group, by order day.

    To be stored, by day, with `write_result(..., mode="replace", partition_by=["d"])`: a new or
    corrected day is then sketched from its own gaps, and no other day is read.
    """
    return gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("gaps"), F.kll_sketch_agg_bigint("gap", F.lit(k)).alias("sketch")
    )


def sketched_quantiles(
    sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = (), k: int = SKETCH_SIZE
) -> DataFrame:
    """`by` columns, prob, gap: quantiles of all gaps that the sketches stand for.

    A sketch has about 3k values at most, whatever it stands for, and merges before the shuffle.
    The rank is off by about 2 / k, and which value that gives differs from run to run. No gaps,
    no rows.
    """
    probs = [float(p) for p in probs]
    asked = F.array(*[F.lit(p) for p in probs])
    whole = (
        sketches.groupBy(*by)
        .agg(F.sum("gaps").alias("gaps"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"))
        .filter(F.col("gaps") > 0)
    )
    cuts = F.arrays_zip(asked.alias("prob"), F.kll_sketch_get_quantile_bigint("sketch", asked).alias("gap"))
    return whole.select(*by, F.inline(cuts))


def recency_state(facts: DataFrame, snapshot: str | dt.date, days: int) -> DataFrame:
    """k, last_d, days_since, state: lapsed when the last order is more than `days` days back.

    Orders after the snapshot are unknown at the snapshot and ignored.
    """
    at = F.lit(day(snapshot))
    since = F.datediff(at, F.col("last_d")).cast("bigint")
    return (
        facts.filter(F.col("d") <= at)
        .groupBy("k")
        .agg(F.max("d").alias("last_d"))
        .withColumn("days_since", since)
        .withColumn("state", F.when(F.col("days_since") > days, "lapsed").otherwise("active"))
    )


def churn_label(
    facts: DataFrame,
    cutoff: str | dt.date,
    horizon_days: int = 365,
    lookback_days: int = 365,
    observed_until: str | dt.date | None = None,
) -> DataFrame:
    """k, churned: customers with an order in the lookback, and whether the horizon has none.

    Windows are half-open: [cutoff - lookback, cutoff) and [cutoff, cutoff + horizon). The
    last observed day is looked up in `facts` unless given.

    One aggregate over both windows instead of two key sets and a join: the flags combine
    before the only shuffle.
    """
    at = day(cutoff)
    start, end = at - dt.timedelta(lookback_days), at + dt.timedelta(horizon_days)
    last = day(observed_until) if observed_until else facts.agg(F.max("d")).first()[0]
    if last is None or end > last + dt.timedelta(1):
        raise UnobservedHorizon(f"outcomes run to {end} (exclusive) but data ends on {last}")
    return (
        between(facts, start, end)
        .groupBy("k")
        .agg(
            F.max(F.col("d") < F.lit(at)).alias("known"),
            F.max(F.col("d") >= F.lit(at)).alias("returned"),
        )
        .filter("known")
        .select("k", F.when(F.col("returned"), 0).otherwise(1).cast("int").alias("churned"))
    )


def churn_rate(
    label: DataFrame, dims: DataFrame, by: Sequence[str], mode: str = "groupBy"
) -> DataFrame:
    """`by` columns, level, customers, churned, rate; mode is groupBy, rollup or cube.

    `level` has one bit per dimension, first one highest, set where the row is a subtotal over
    it. Customers are counted per full combination first, so subtotals expand those few rows.
    """
    cells = (
        label.join(dims.select("k", *by), "k", "left")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("churned").alias("c"))
    )
    totals = [F.sum("n").alias("customers"), F.sum("c").alias("churned")]
    if mode == "groupBy":
        counted = cells.groupBy(*by).agg(F.lit(0).cast("bigint").alias("level"), *totals)
    else:
        counted = getattr(cells, mode)(*by).agg(F.grouping_id().alias("level"), *totals)
    return counted.withColumn("rate", ratio(F.col("churned"), F.col("customers")))


def period_status(facts: DataFrame, until: str | dt.date) -> DataFrame:
    """k, q, status for every quarter from a customer's first to the quarter of `until`.

    new: first active quarter. retained: active, as in the quarter before. resurrected: active
    after a pause. churned: inactive, active the quarter before. dormant: inactive for longer.

    Each active quarter emits itself and the silence up to the next one, so the full grid is
    never joined and inactive quarters are never shuffled.
    """
    last = quarter_of(day(until))
    line = W.partitionBy("k").orderBy("q")
    p, q, prev = F.col("p"), F.col("q"), F.col("prev")
    status = (
        F.when((p == q) & prev.isNull(), "new")
        .when((p == q) & (prev == q - 1), "retained")
        .when(p == q, "resurrected")
        .when(p == q + 1, "churned")
        .otherwise("dormant")
    )
    return (
        active_quarters(facts, until)
        .withColumn("prev", F.lag("q").over(line))
        .withColumn("stop", F.lead("q", 1, last + 1).over(line) - 1)
        .withColumn("p", F.explode(F.sequence("q", "stop")))
        .select("k", p.alias("q"), status.alias("status"))
    )


def growth_accounting(status: DataFrame) -> DataFrame:
    """Per quarter: customers of each status, active, and churned / active in the quarter before.

    The window has no partition key, but sees one row per quarter.
    """
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    before = F.lag("active").over(W.orderBy("q"))
    return (
        status.groupBy("q")
        .agg(*counts)
        .withColumn("active", F.col("new") + F.col("retained") + F.col("resurrected"))
        .withColumn("churn_rate", ratio(F.col("churned"), before))
    )


def cohort_retention(facts: DataFrame, until: str | dt.date) -> DataFrame:
    """cohort, since, customers, retained, rate: who of a first-order quarter ordered again.

    Every cell observed by `until` is present, also with nobody retained; later ones are absent.
    """
    last = F.lit(quarter_of(day(until))).cast("bigint")
    counted = (
        active_quarters(facts, until)
        .groupBy(F.col("first").alias("cohort"), (F.col("q") - F.col("first")).alias("since"))
        .agg(F.count(F.lit(1)).alias("retained"))
    )
    # Everybody is active in their first quarter, so offset 0 holds the cohort's size.
    size = F.max(F.when(F.col("since") == 0, F.col("retained")))
    by_offset = F.map_from_entries(F.collect_list(F.struct("since", "retained")))
    return (
        counted.groupBy("cohort")  # at most one row per quarter pair from here on
        .agg(size.alias("customers"), by_offset.alias("cells"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last - F.col("cohort"))).alias("since"))
        .withColumn("retained", F.coalesce(F.try_element_at("cells", F.col("since")), F.lit(0)))
        .select("cohort", "since", "customers", "retained",
                ratio(F.col("retained"), F.col("customers")).alias("rate"))
    )


def spells(order_days: DataFrame, snapshot: str | dt.date) -> DataFrame:
    """k, start, dur, event: from one order day to the next; the last is cut at the snapshot."""
    at = F.lit(day(snapshot))
    following = F.lead("d").over(W.partitionBy("k").orderBy("d"))
    return (
        order_days.filter(F.col("d") <= at)
        .select("k", F.col("d").alias("start"), following.alias("next"))
        .select(
            "k",
            "start",
            F.datediff(F.coalesce("next", at), "start").cast("bigint").alias("dur"),
            F.when(F.col("next").isNull(), 0).otherwise(1).cast("int").alias("event"),
        )
    )


def survival_curve(spells: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """Per stratum and time with an event: t, at_risk, events, survival (Kaplan-Meier).

    `strata` names columns of `spells`. Spells are counted per distinct duration first; the
    windows see at most one row per calendar day and stratum.
    """
    times = spells.groupBy(*strata, F.col("dur").alias("t")).agg(
        F.sum("event").alias("events"), F.count(F.lit(1)).alias("n")
    )
    line = W.partitionBy(*strata)
    onward = line.orderBy("t").rowsBetween(0, W.unboundedFollowing)
    so_far = line.orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    stay = F.col("at_risk") - F.col("events")
    log_stay = F.when(stay > 0, F.ln(ratio(stay, F.col("at_risk"))))
    survival = F.when(
        F.min(stay).over(so_far) > 0, F.exp(F.sum(log_stay).over(so_far))
    ).otherwise(F.lit(0.0))
    return (
        times.withColumn("at_risk", F.sum("n").over(onward))
        .filter(F.col("events") > 0)
        .withColumn("survival", survival)
        .select(*strata, "t", "at_risk", "events", "survival")
    )


def last_orders(order_days: DataFrame, n: int) -> DataFrame:
    """k, d, n_orders, amount, rank: the latest n order days of each customer."""
    latest = F.row_number().over(W.partitionBy("k").orderBy(F.desc("d")))
    return (
        order_days.withColumn("rank", latest.cast("bigint"))
        .filter(F.col("rank") <= n)
        .select("k", "d", "n_orders", "amount", "rank")
    )
