"""Segments, features known at a cutoff, and what sets leavers apart from stayers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.functions import day, quarter_index, ratio
from ebbtide.functions.columns import quarter_of
from ebbtide.operators.preparation import between
from ebbtide.plans import durable, quantiles
from ebbtide.sources import literal_rows

WINDOWS = (90, 180, 365)
SOME_ROWS = 1000  # of which a value per column is taken
URGENT = "1-URGENT"
RETURNED = "R"
RULE_COLUMNS = "segment string, priority int, r_lo int, r_hi int, f_lo int, f_hi int, m_lo int, m_hi int"


def band(x: Column, cuts: Sequence[float]) -> Column:
    """1 + the number of cutpoints below x, so equal values always share a band; null stays null."""
    above = sum(((x > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    return F.when(x.isNotNull(), above + 1)


def rfm(
    facts: DataFrame,
    snapshot: str | dt.date,
    bins: int = 5,
    exact: bool = True,
    digits: int = 2,
) -> DataFrame:
    """k, recency, frequency, monetary and their scores r, f, m in 1..bins (bins is best).

    Orders up to and including the snapshot count; several orders on a day are several.
    Monetary is rounded to `digits`, so that sums that differ only in their last bits, from
    the order in which they were added, are ties and share a band.
    The customer table is written once and then read for both the cutpoints and the scores,
    instead of scanning the orders twice. Cutpoints are numbers in the plan, not a join.
    """
    at = F.lit(day(snapshot))
    customers = durable(
        facts.filter(F.col("d") <= at)
        .groupBy("k")
        .agg(
            F.datediff(at, F.max("d")).cast("bigint").alias("recency"),
            F.count(F.lit(1)).alias("frequency"),
            F.round(F.sum("amount"), digits).alias("monetary"),
        )
    )
    metrics = ["recency", "frequency", "monetary"]
    cuts = quantiles(customers, metrics, [i / bins for i in range(1, bins)], exact)
    r, f, m = (band(F.col(c).cast("double"), cuts[c]) for c in metrics)
    return customers.select("*", (bins + 1 - r).alias("r"), f.alias("f"), m.alias("m"))


def rfm_segment(scores: DataFrame, rules: DataFrame, bins: int = 5) -> DataFrame:
    """`scores` plus `segment`: the matching rule with the lowest priority number, else null.

    Rules have the columns of RULE_COLUMNS, ranges inclusive. Each rule is spread over the
    score cells it covers, so customers join a table of at most bins^3 cells on equal scores
    instead of comparing every customer with every rule.
    """
    cells = rules
    for axis in ("r", "f", "m"):
        low = F.greatest(F.col(f"{axis}_lo"), F.lit(1))
        high = F.least(F.col(f"{axis}_hi"), F.lit(bins))
        cells = cells.filter(low <= high).withColumn(axis, F.explode(F.sequence(low, high)))
    first = F.min_by("segment", F.struct("priority", "segment"))
    return scores.join(cells.groupBy("r", "f", "m").agg(first.alias("segment")), ["r", "f", "m"], "left")


def features(
    orders: DataFrame,
    dims: DataFrame,
    cutoff: str | dt.date,
    windows: Sequence[int] = WINDOWS,
) -> DataFrame:
    """One row per customer with an order in the longest window before the cutoff.

    Per window of w days: orders_w, spend_w, mean_gap_w (days between its order days, null
    below two). Over the longest: days_since, urgent_share. From `dims`: balance, segment,
    region. Nothing on or after the cutoff is read.

    Order days reduce before the customer shuffle, and the gaps between neighbours add up to
    last minus first, so no window is needed. `dims` has a row per customer too: both sides are
    sorted and merged, as a broadcast would bring all customers to the driver.
    """
    at, longest = day(cutoff), max(windows)
    days = (
        between(
            orders.withColumn("d", F.to_date("o_orderdate")), at - dt.timedelta(longest), at
        )
        .groupBy(F.col("o_custkey").alias("k"), "d")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("o_totalprice").alias("amount"),
            F.count_if(F.col("o_orderpriority") == URGENT).alias("urgent"),
        )
    )
    columns = [F.datediff(F.lit(at), F.max("d")).cast("bigint").alias("days_since")]
    for w in windows:
        inside = F.col("d") >= F.lit(at - dt.timedelta(w))
        seen = F.when(inside, F.col("d"))
        columns += [
            F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias(f"orders_{w}"),
            F.coalesce(F.sum(F.when(inside, F.col("amount"))), F.lit(0.0)).alias(f"spend_{w}"),
            ratio(F.datediff(F.max(seen), F.min(seen)), F.count(seen) - 1).alias(f"mean_gap_{w}"),
        ]
    columns.append(ratio(F.sum("urgent"), F.sum("n")).alias("urgent_share"))
    known = dims.select("k", "balance", "segment", "region").hint("merge")
    return days.groupBy("k").agg(*columns).join(known, "k", "left")


def numeric_features(windows: Sequence[int] = WINDOWS) -> list[str]:
    """Names of the numeric columns of `features`."""
    per_window = [f"{name}_{w}" for w in windows for name in ("orders", "spend", "mean_gap")]
    return ["days_since", *per_window, "urgent_share", "balance"]


def return_share(lineitem: DataFrame, orders: DataFrame, cutoff: str | dt.date) -> DataFrame:
    """k, lines, returned, share over the orders before the cutoff; share null without lines.

    Lines shrink to one row per order before the join, and the join reuses that partitioning.
    """
    per_order = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("l_returnflag") == RETURNED).alias("returned"),
    )
    placed = orders.filter(F.to_date("o_orderdate") < F.lit(day(cutoff)))
    return (
        placed.select("o_orderkey", F.col("o_custkey").alias("k"))
        .join(per_order, "o_orderkey", "left")
        .groupBy("k")
        .agg(
            F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
            F.coalesce(F.sum("returned"), F.lit(0)).alias("returned"),
        )
        .withColumn("share", ratio(F.col("returned"), F.col("lines")))
    )


def spend_trend(facts: DataFrame, cutoff: str | dt.date, periods: int = 8) -> DataFrame:
    """k, quarters, slope: least-squares change of spend per quarter.

    Over the last `periods` whole quarters before the cutoff, or from the customer's first
    quarter if later. Quarters without orders count as zero; slope is null for one quarter.

    Zero quarters add nothing to the sums, so the slope comes from three sums per customer
    and the grid of customer quarters is never built.
    """
    last = quarter_of(day(cutoff)) - 1
    start = last - periods + 1
    q = F.col("q")
    sums = (
        facts.select("k", quarter_index(F.col("d")).alias("q"), "amount")
        .filter(q <= last)
        .groupBy("k")
        .agg(
            F.min(F.greatest(q, F.lit(start))).alias("first"),
            F.coalesce(F.sum(F.when(q >= start, F.col("amount"))), F.lit(0.0)).alias("y"),
            F.coalesce(F.sum(F.when(q >= start, (q - start) * F.col("amount"))), F.lit(0.0)).alias("qy"),
        )
        .withColumn("quarters", F.lit(last + 1) - F.col("first"))
    )
    n = F.col("quarters")
    # x counts from the customer's first quarter, mean (n - 1) / 2, squares n (n^2 - 1) / 12.
    xy = F.col("qy") - (F.col("first") - start) * F.col("y")
    slope = ratio(xy - (n - 1) / 2 * F.col("y"), n * (n * n - 1) / 12)
    return sums.select("k", "quarters", slope.alias("slope"))


def driver_contrast(features: DataFrame, label: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: mean of leavers and stayers, difference, Cohen's d (null for no spread).

    Features become rows and are combined per feature and outcome before the shuffle.
    """
    long = (
        features.join(label, "k")
        .select("churned", *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot("churned", list(columns), "feature", "x")
    )
    per_outcome = long.groupBy("feature", "churned").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance")
    )

    def of(outcome: int, column: str) -> Column:
        return F.max(F.when(F.col("churned") == outcome, F.col(column)))

    spread = F.coalesce((F.col("n1") - 1) * F.col("v1"), F.lit(0.0)) + F.coalesce(
        (F.col("n0") - 1) * F.col("v0"), F.lit(0.0)
    )
    pooled = F.sqrt(ratio(spread, F.col("n1") + F.col("n0") - 2))
    difference = F.col("mean_churned") - F.col("mean_stayed")
    return (
        per_outcome.groupBy("feature")
        .agg(
            of(1, "mean").alias("mean_churned"),
            of(0, "mean").alias("mean_stayed"),
            of(1, "n").alias("n1"),
            of(0, "n").alias("n0"),
            of(1, "variance").alias("v1"),
            of(0, "variance").alias("v0"),
        )
        .select(
            "feature",
            "mean_churned",
            "mean_stayed",
            difference.alias("difference"),
            ratio(difference, pooled).alias("cohens_d"),
        )
    )


def category_lift(label: DataFrame, dims: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per dimension and category: churn rate, lift over the base, weight of evidence, and the
    dimension's information value. Half a customer is added to each cell before the logarithm.

    Customers are counted per combination of categories first; the rest sees those few rows.
    """
    counted = (
        label.join(dims.select("k", *by), "k", "left")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("churned").alias("c"))
    )
    cells = (
        counted.unpivot(["n", "c"], list(by), "dimension", "category")
        .groupBy("dimension", "category")
        .agg(F.sum("n").alias("customers"), F.sum("c").alias("churned"))
    )
    whole = W.partitionBy("dimension")  # one row per category
    all_n, all_c = F.sum("customers").over(whole), F.sum("churned").over(whole)
    k = F.count(F.lit(1)).over(whole)
    stayed = F.col("customers") - F.col("churned")
    share_c = (F.col("churned") + 0.5) / (all_c + 0.5 * k)
    share_s = (stayed + 0.5) / (all_n - all_c + 0.5 * k)
    rate = ratio(F.col("churned"), F.col("customers"))
    scored = cells.select(
        "dimension",
        "category",
        "customers",
        "churned",
        rate.alias("rate"),
        ratio(rate, ratio(all_c, all_n)).alias("lift"),
        F.ln(share_c / share_s).alias("woe"),
        (share_c - share_s).alias("apart"),
    )
    value = F.sum(F.col("apart") * F.col("woe")).over(whole)
    return scored.withColumn("information_value", value).drop("apart")


def feature_correlation(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature_a, feature_b, correlation for every pair, over the rows that have both; null where
    a feature does not vary.

    The features are written, and read once however many columns there are: each row gives a
    matrix of products (which pairs are there, values, squares and products of those that are),
    matrices are added up per task and then over tasks, and one matrix is left. Values are taken
    relative to one of the column's own, so that little is lost when means are taken out.
    """
    columns = list(columns)
    if len(columns) < 2:
        return features.sparkSession.createDataFrame([], "feature_a string, feature_b string, correlation double")
    kept = durable(features.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    some = kept.limit(SOME_ROWS).agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns]).first()
    values = F.array(*[F.col(c) - F.lit(some[c] or 0.0) for c in columns])

    def cross(a: Column, b: Column) -> Column:
        return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))

    x = F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))
    there = F.transform("x", lambda v: v.isNotNull().cast("double"))
    squares = F.transform(x, lambda v: v * v)
    products = F.concat(cross(there, there), cross(x, there), cross(squares, there), cross(x, x))
    (sums,) = kept.select(values.alias("x")).agg(
        vector_to_array(Summarizer.sum(array_to_vector(products))).alias("s")
    ).first() or (None,)
    k = len(columns)
    # Without rows there are no sums; every pair is listed all the same.
    n, first, second, both = np.array(sums if sums else [0.0] * 4 * k * k).reshape(4, k, k)
    found = np.divide(1.0, n, out=np.zeros((k, k)), where=n > 0)
    spread = np.maximum(0.0, second - first**2 * found)
    spread[spread <= second * 1e-14] = 0.0  # what rounding leaves of a column that does not vary
    together = both - first * first.T * found
    rows = [
        (a, b, float(together[i, j] / scale) if (scale := np.sqrt(spread[i, j]) * np.sqrt(spread[j, i])) else None)
        for (i, a), (j, b) in combinations(enumerate(columns), 2)
    ]
    return literal_rows(features.sparkSession, rows, "feature_a string, feature_b string, correlation double")
