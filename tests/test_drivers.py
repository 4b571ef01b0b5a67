from __future__ import annotations

import datetime as dt
import random

from conftest import TESTDATA, as_set
from pyspark.sql import functions as F

from ebbtide.operators import drivers
from ebbtide.operators.preparation import customer_dims
from ebbtide.sources import SCHEMAS, load


def test_equal_customers_share_a_score(facts):
    got = drivers.rfm(facts(*[(k, "2000-01-01", 5) for k in range(12)]), "2000-02-01")
    assert as_set(got, "r", "f", "m") == {(5, 1, 1)}


def test_fewer_values_than_bins(facts):
    rows = [(k, "2000-01-01", 1 if k < 6 else 100) for k in range(12)]
    got = drivers.rfm(facts(*rows), "2000-02-01", bins=4)
    by_spend = {r.monetary: r.m for r in got.collect()}
    assert by_spend[100.0] > by_spend[1.0]


def test_scores_stay_in_range_and_recent_is_best(facts):
    rows = [(k, (dt.date(2000, 1, 1) + dt.timedelta(k)).isoformat(), k) for k in range(50)]
    got = {r.k: r for r in drivers.rfm(facts(*rows), "2000-12-31").collect()}
    assert {r.r for r in got.values()} == {1, 2, 3, 4, 5}
    assert got[49].r == 5 and got[0].r == 1 and got[49].m == 5


def test_first_rule_wins_and_no_rule_gives_null(spark):
    scores = spark.createDataFrame([(1, 5, 5, 5), (2, 5, 1, 1), (3, 1, 1, 1)], "k bigint, r int, f int, m int")
    rules = spark.createDataFrame(
        [("wide", 2, 5, 9, 0, 9, 1, 5), ("best", 1, 5, 5, 5, 5, 5, 5)], drivers.RULE_COLUMNS
    )
    got = drivers.rfm_segment(scores, rules)
    assert as_set(got, "k", "segment") == {(1, "best"), (2, "wide"), (3, None)}


def _orders(spark, rows):
    full = [(i, k, "O", amount, dt.datetime.fromisoformat(d), p) for i, (k, d, amount, p) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMAS["orders"])


def _dims(spark, *keys):
    return spark.createDataFrame(
        [(k, 1.0, "S", "N", "R") for k in keys], "k bigint, balance double, segment string, nation string, region string"
    )


def test_features_use_half_open_windows(spark):
    orders = _orders(spark, [
        (1, "2000-05-03", 10.0, "1-URGENT"),  # 90 days before
        (1, "2000-07-31", 5.0, "5-LOW"), (1, "2000-07-31", 5.0, "5-LOW"),
        (1, "2000-08-01", 99.0, "1-URGENT"),  # the cutoff itself is unknown
        (2, "1999-08-02", 7.0, "5-LOW"), (3, "1999-08-01", 7.0, "5-LOW"),
    ])
    got = {r.k: r for r in drivers.features(orders, _dims(spark, 1, 2, 3), "2000-08-01").collect()}
    assert set(got) == {1, 2}
    one, two = got[1], got[2]
    assert (one.orders_90, one.spend_90, one.mean_gap_90, one.days_since) == (3, 20.0, 89.0, 1)
    assert abs(one.urgent_share - 1 / 3) < 1e-12
    assert (two.orders_90, two.orders_365, two.spend_90, two.mean_gap_365, two.days_since) == (0, 1, 0.0, None, 365)


def test_nothing_after_the_cutoff_reaches_the_features(spark):
    sf = str(TESTDATA / "sf0.001")
    orders = load(spark, sf, "orders")
    dims = customer_dims(load(spark, sf, "customer"), load(spark, sf, "nation"), load(spark, sf, "region"))
    cutoff = F.lit(dt.date(2000, 8, 1))
    future = orders.withColumn(
        "o_totalprice", F.when(F.to_date("o_orderdate") >= cutoff, -1.0).otherwise(F.col("o_totalprice"))
    )
    before, after = (drivers.features(o, dims, "2000-08-01") for o in (orders, future))
    assert as_set(before) == as_set(after)


def test_return_share_without_lines_is_null(spark):
    orders = _orders(spark, [(1, "2000-01-01", 1.0, "x"), (2, "2000-01-01", 1.0, "x"), (2, "2001-01-01", 1.0, "x")])
    line = lambda key, flag: (key, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, flag, "O", dt.datetime(2000, 1, 1))
    lines = spark.createDataFrame([line(0, "R"), line(0, "A"), line(2, "R")], SCHEMAS["lineitem"])
    got = drivers.return_share(lines, orders, "2000-08-01")
    assert as_set(got, "k", "lines", "share") == {(1, 2, 0.5), (2, 0, None)}


def test_trend_counts_quarters_without_orders(facts):
    history = facts((1, "2000-01-10", 4), (1, "2000-05-10", 8), (2, "2000-05-10", 3), (3, "1990-01-01", 50),
                    (4, "2000-07-02", 1))
    got = {r.k: (r.quarters, r.slope) for r in drivers.spend_trend(history, "2000-08-01", 4).collect()}
    # Quarters 1999Q3..2000Q2; customer 1 starts in 2000Q1, customer 3 long before, 4 too late.
    assert got == {1: (2, 4.0), 2: (1, None), 3: (4, 0.0)}


def test_constant_feature_and_category_without_leavers(spark):
    rng = random.Random(0)
    rows = [(k, 1.0, float(k % 2) * 3 + rng.random(), "ab"[k % 2], int(k % 2 == 0 and k < 8)) for k in range(20)]
    df = spark.createDataFrame(rows, "k bigint, same double, x double, cat string, churned int")
    label = df.select("k", "churned")
    got = {r.feature: r for r in drivers.driver_contrast(df.drop("churned"), label, ["same", "x"]).collect()}
    assert got["same"].difference == 0 and got["same"].cohens_d is None
    assert got["x"].cohens_d < 0
    lift = {r.category: r for r in drivers.category_lift(label, df.select("k", "cat"), ["cat"]).collect()}
    assert lift["b"].rate == 0 and lift["b"].woe < 0 < lift["a"].woe
    assert lift["a"].information_value == lift["b"].information_value > 0
    pairs = {(r.feature_a, r.feature_b): r.correlation
             for r in drivers.feature_correlation(df.withColumn("y", -F.col("x")), ["same", "x", "y"]).collect()}
    assert pairs["same", "x"] is None and abs(pairs["x", "y"] + 1) < 1e-9
