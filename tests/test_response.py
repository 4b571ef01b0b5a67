from __future__ import annotations

import pytest
from conftest import as_set
from pyspark.errors import PySparkException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.operators import response


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), response.RULE_COLUMNS)


def valued(spark, *rows):
    return spark.createDataFrame(
        [(k, float(r), float(v), float(r * v)) for k, r, v in rows],
        "k bigint, risk double, value double, at_risk double",
    )


def test_touching_bands_do_not_overlap_and_holes_give_null(spark):
    table = rules(spark, (1, 0.0, 0.5, None, None, "a", 1.0), (2, 0.5, 0.9, 10.0, None, "b", 2.0))
    people = valued(spark, (1, 0.0, 1), (2, 0.5, 10), (3, 0.5, 9.99), (4, 0.9, 50), (5, 0.499999, 0))
    got = response.assign_action(people, table)
    assert as_set(got, "k", "rule_id") == {(1, 1), (2, 2), (3, None), (4, None), (5, 1)}
    assert got.count() == 5


def test_unbounded_rule_covers_risks_outside_the_unit_range(spark):
    got = response.assign_action(
        valued(spark, (1, -3, 1), (2, 7, 1)), rules(spark, (1, None, None, None, None, "a", 1.0))
    )
    assert as_set(got, "k", "rule_id") == {(1, 1), (2, 1)}


def test_overlaps_are_found_and_refused(spark):
    table = rules(spark, (1, 0.0, 0.5, 0.0, 10.0, "a", 1.0), (2, 0.4, 0.6, 9.0, 20.0, "b", 1.0),
                  (3, 0.4, 0.6, 20.0, 30.0, "c", 1.0), (4, 0.45, 0.45, 0.0, 99.0, "empty", 1.0))
    assert as_set(response.check_rules(table)) == {(1, 2)}
    with pytest.raises(response.OverlappingRules):
        response.assign_action(valued(spark, (1, 0.1, 1)), table)


def assigned(spark, *rows):
    return spark.createDataFrame(list(rows), "k bigint, at_risk double, cost double")


def test_budget_stops_at_the_first_who_does_not_fit(spark):
    people = assigned(spark, (1, 9.0, 5.0), (2, 8.0, 100.0), (3, 7.0, 1.0), (4, 6.0, None))
    assert as_set(response.budget_list(people, 10.0), "k") == {(1,)}
    assert as_set(response.budget_list(people, 106.0), "k") == {(1,), (2,), (3,)}
    assert response.budget_list(people, 4.0).count() == 0


def test_budget_ties_go_by_key(spark):
    people = assigned(spark, *[(k, 1.0, 2.0) for k in range(10)])
    assert as_set(response.budget_list(people, 6.0), "k", "spent") == {(0, 2.0), (1, 4.0), (2, 6.0)}


def test_budget_equals_the_plain_window(spark):
    people = spark.range(2000).select(
        F.col("id").alias("k"), (F.col("id") * 37 % 11).cast("double").alias("at_risk"),
        (F.col("id") % 4).cast("double").alias("cost"),
    )
    line = W.orderBy(F.desc("at_risk"), "k").rowsBetween(W.unboundedPreceding, 0)
    plain = people.withColumn("spent", F.sum("cost").over(line)).filter("spent <= 1234")
    assert as_set(response.budget_list(people, 1234.0), "k", "spent") == as_set(plain, "k", "spent")


def test_negative_costs_are_refused(spark):
    with pytest.raises(PySparkException, match="negative cost"):
        response.budget_list(assigned(spark, (1, 1.0, -1.0)), 5.0).collect()


def test_top_targets_break_ties_by_key(spark):
    dims = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(6)], "k bigint, region string")
    got = response.top_targets(valued(spark, *[(k, 1, 5) for k in range(6)]), dims, "region", 2)
    assert as_set(got, "region", "rank", "k") == {("a", 1, 0), ("a", 2, 2), ("b", 1, 1), ("b", 2, 3)}


def test_holdout_is_stable_and_near_its_share(spark):
    people = spark.range(20_000).withColumnRenamed("id", "k")
    first = response.holdout(people, "s", 20)
    again = response.holdout(people.repartition(7).orderBy(F.desc("k")), "s", 20)
    assert as_set(first) == as_set(again)
    control = first.filter("arm = 'control'").count()
    assert 3700 < control < 4300
    assert as_set(first) != as_set(response.holdout(people, "t", 20))


def test_readout_of_an_empty_arm(spark):
    arms = spark.createDataFrame([(1, "treated"), (2, "treated")], "k bigint, arm string")
    label = spark.createDataFrame([(1, 1), (2, 0)], "k bigint, churned int")
    (row,) = response.experiment_readout(arms, label).collect()
    assert (row.treated_n, row.control_n, row.treated_rate) == (2, 0, 0.5)
    assert row.difference is None and row.low is None and row.z is None


def test_readout_numbers(spark):
    rows = [(i, "treated" if i < 100 else "control", int(i % 100 < (20 if i < 100 else 30))) for i in range(200)]
    df = spark.createDataFrame(rows, "k bigint, arm string, churned int")
    (row,) = response.experiment_readout(df.select("k", "arm"), df.select("k", "churned")).collect()
    assert abs(row.difference + 0.1) < 1e-12 and abs(row.z + 1.632993) < 1e-5
    assert abs(row.low + 0.219212) < 1e-4 and abs(row.high - 0.019212) < 1e-4
