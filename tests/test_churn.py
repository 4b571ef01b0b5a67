from __future__ import annotations

import datetime as dt
import math
import random
from bisect import bisect_left, bisect_right

import pytest
from conftest import TESTDATA, as_set
from pyspark.sql import functions as F

from ebbtide.operators import churn


def days(facts):
    return facts.select("k", "d", F.lit(1).cast("bigint").alias("n_orders"), "amount")


def test_label_windows_are_half_open(facts):
    history = facts(
        (1, "1999-08-02"),  # first day of the lookback
        (2, "1999-08-01"),  # the day before it: not in the population
        (3, "2000-07-31"), (3, "2000-08-01"),  # returns on the cutoff itself
        (4, "2000-07-31"), (4, "2001-07-31"),  # returns on the horizon's last day
        (5, "2000-07-31"), (5, "2001-08-01"),  # returns one day too late
        (6, "2000-08-01"),  # only future orders
    )
    label = churn.churn_label(history, "2000-08-01")
    assert as_set(label) == {(1, 1), (3, 0), (4, 0), (5, 1)}


def test_label_refuses_an_unobserved_horizon(facts):
    with pytest.raises(churn.UnobservedHorizon):
        churn.churn_label(facts((1, "2000-07-01"), (1, "2001-07-30")), "2000-08-01")
    churn.churn_label(facts((1, "2000-07-01"), (1, "2001-07-31")), "2000-08-01")


def test_label_of_nothing_is_refused(facts, spark):
    with pytest.raises(churn.UnobservedHorizon):
        churn.churn_label(facts((1, "2000-07-01")).limit(0), "2000-08-01")


def test_label_shuffles_once(facts, capsys):
    label = churn.churn_label(facts((1, "2000-07-01")), "2000-08-01", observed_until="2001-08-01")
    label.explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_gaps_and_single_orders(facts):
    gaps = churn.purchase_gaps(days(facts((1, "2000-01-01"), (1, "2000-01-11"), (2, "2000-01-01"))))
    assert as_set(gaps, "k", "gap") == {(1, 10)}


def test_quantiles_of_no_gaps(facts):
    gaps = churn.purchase_gaps(days(facts((1, "2000-01-01"))))
    assert churn.gap_quantiles(gaps, [0.5]).count() == 0


def test_exact_and_approximate_quantiles_agree_on_few_values(facts):
    gaps = churn.purchase_gaps(days(facts((1, "2000-01-01"), (1, "2000-01-03"), (1, "2000-01-09"))))
    assert as_set(churn.gap_quantiles(gaps, [0.0, 0.5, 1.0])) == {(0.0, 2.0), (0.5, 4.0), (1.0, 6.0)}
    assert as_set(churn.gap_quantiles(gaps, [1.0], exact=False)) == {(1.0, 6.0)}


def test_recency_ignores_later_orders(facts):
    state = churn.recency_state(facts((1, "2000-01-01"), (1, "2000-03-01"), (2, "2000-01-31"), (3, "2000-03-01")),
                                "2000-02-01", 31)
    assert as_set(state, "k", "days_since", "state") == {(1, 31, "active"), (2, 1, "active")}
    lapsed = churn.recency_state(facts((1, "2000-01-01")), "2000-02-02", 31)
    assert as_set(lapsed, "k", "state") == {(1, "lapsed")}


def test_rates_weighted_by_counts_give_the_base_rate(spark):
    label = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "k bigint, churned int")
    dims = spark.createDataFrame([(i, "ab"[i % 2], "xyz"[i % 3]) for i in range(29)], "k bigint, a string, b string")
    rows = churn.churn_rate(label, dims, ["a", "b"], "cube").collect()
    total = [r for r in rows if r.level == 3]
    assert [(r.customers, r.churned) for r in total] == [(30, 10)]
    for level in (0, 1, 2):
        part = [r for r in rows if r.level == level]
        assert sum(r.customers for r in part) == 30
        assert math.isclose(sum(r.rate * r.customers for r in part), 10)


def test_statuses_over_a_long_pause(facts):
    history = facts((1, "1999-01-05"), (1, "1999-01-20"), (1, "1999-05-01"), (1, "2000-11-01"),
                    (2, "2001-05-01"), (3, "2001-09-01"))
    got = churn.period_status(history, "2001-06-30")
    first = 1999 * 4
    line = ["new", "retained", "churned", "dormant", "dormant", "dormant", "dormant", "resurrected",
            "churned", "dormant"]
    want = {(1, first + i, s) for i, s in enumerate(line)} | {(2, 2001 * 4 + 1, "new")}
    assert as_set(got) == want


def test_growth_rate_is_null_without_a_base(spark):
    status = spark.createDataFrame(
        [(1, 10, "new"), (1, 11, "churned"), (1, 12, "dormant"), (2, 12, "new")],
        "k bigint, q bigint, status string",
    )
    got = churn.growth_accounting(status)
    assert as_set(got, "q", "active", "churned", "churn_rate") == {
        (10, 1, 0, None), (11, 0, 1, 1.0), (12, 1, 0, None)
    }


def test_retention_has_zero_cells_but_no_unobserved_ones(facts):
    got = churn.cohort_retention(facts((1, "2000-01-01"), (1, "2000-09-01"), (2, "2000-12-01")), "2000-12-31")
    q = 2000 * 4
    assert as_set(got, "cohort", "since", "retained") == {
        (q, 0, 1), (q, 1, 0), (q, 2, 1), (q, 3, 0), (q + 3, 0, 1)
    }


def test_spells_are_cut_at_the_snapshot(facts):
    got = churn.spells(days(facts((1, "2000-01-01"), (1, "2000-01-11"), (1, "2000-03-01"))), "2000-02-01")
    assert as_set(got, "dur", "event") == {(10, 1), (21, 0)}


def test_survival_extremes(spark):
    day = dt.date(2000, 1, 1)
    rows = [(1, day, 3, 1, "all"), (2, day, 3, 1, "all"),
            (3, day, 5, 0, "none"), (4, day, 2, 1, "some"), (5, day, 4, 0, "some"), (6, day, 6, 1, "some")]
    spells = spark.createDataFrame(rows, "k bigint, start date, dur bigint, event int, stratum string")
    got = {(r.stratum, r.t): round(r.survival, 9) for r in churn.survival_curve(spells, ["stratum"]).collect()}
    assert got == {("all", 3): 0.0, ("some", 2): round(2 / 3, 9), ("some", 6): 0.0}


def test_survival_never_rises(facts):
    history = facts(*[(k, f"2000-{1 + (k * m) % 12:02d}-{1 + (k + m) % 28:02d}") for k in range(40) for m in (1, 5, 7)])
    once = history.select("k", "d").distinct().withColumn("n_orders", F.lit(1)).withColumn("amount", F.lit(1.0))
    curve = churn.survival_curve(churn.spells(once, "2001-01-01")).orderBy("t").collect()
    levels = [1.0] + [r.survival for r in curve]
    assert all(b <= a + 1e-12 for a, b in zip(levels, levels[1:]))


def test_last_orders(facts):
    got = churn.last_orders(days(facts((1, "2000-01-01"), (1, "2000-01-03"), (1, "2000-01-02"), (2, "1999-01-01"))), 2)
    assert as_set(got, "k", "d", "rank") == {
        (1, dt.date(2000, 1, 3), 1), (1, dt.date(2000, 1, 2), 2), (2, dt.date(1999, 1, 1), 1)
    }


def test_sketched_quantiles_and_a_day_added_later(spark, tmp_path):
    """Each day is sketched from its own gaps; ranks are off by at most 2 / k."""
    from ebbtide.sources import write_result

    rng, k, out = random.Random(3), 256, str(tmp_path / "sketches")
    start = dt.date(2000, 1, 1)
    rows = sorted({(rng.randrange(300), start + dt.timedelta(rng.randrange(400))) for _ in range(20_000)})
    days = spark.createDataFrame(rows, "k bigint, d date")
    late = start + dt.timedelta(399)
    early = days.filter(F.col("d") < F.lit(late))
    write_result(churn.gap_sketches(churn.purchase_gaps(early), k=k), out, "replace", ["d"])
    # The last day, twice; the second run replaces the first. Of earlier days only the last counts.
    last = early.groupBy("k").agg(F.max("d").alias("d"))
    for _ in range(2):
        added = churn.purchase_gaps(days.filter(F.col("d") == F.lit(late)), last)
        write_result(churn.gap_sketches(added, k=k), out, "replace", ["d"])
    stored = spark.read.parquet(out)
    gaps = sorted(r["gap"] for r in churn.purchase_gaps(days).collect())
    assert stored.agg(F.sum("gaps")).first()[0] == len(gaps)
    assert stored.select("d").distinct().count() == stored.count()
    probs = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)
    for r in churn.sketched_quantiles(stored, probs, k=k).collect():
        below, upto = (bisect(gaps, r["gap"]) / len(gaps) for bisect in (bisect_left, bisect_right))
        assert below - 2 / k <= r["prob"] <= upto + 2 / k
    by_half = stored.withColumn("half", F.month("d") > 6)
    halves = churn.sketched_quantiles(by_half, (0.5,), ["half"], k=k)
    assert halves.columns == ["half", "prob", "gap"] and halves.count() == 2
    assert churn.sketched_quantiles(stored.limit(0), probs).count() == 0


def test_sketched_query_is_near_the_exact_one(spark):
    from ebbtide.suite.queries import QUERIES

    folder = str(TESTDATA / "sf0.01")
    exact = {r["prob"]: r["gap"] for r in QUERIES["gap_quantiles"](spark, folder).collect()}
    near = {r["prob"]: r["gap"] for r in QUERIES["gap_quantiles_sketched"](spark, folder).collect()}
    assert set(near) == set(exact) and all(abs(near[p] - exact[p]) <= 0.02 * exact[p] + 2 for p in exact)
