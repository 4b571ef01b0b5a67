"""The building blocks against brute force, with one key holding a third of the rows."""

from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from ebbtide.plans import first_per_group, prefix_sum, quantiles, running
from ebbtide.plans.ranked import in_slices

ROOT = Path(__file__).resolve().parents[1]


def test_prefix_sum_equals_running_total(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([7, rng.randrange(1000)]), rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, x bigint, v bigint").repartition(16)
    got = {r.id: r.upto for r in prefix_sum(df, [F.desc("x"), F.asc("id")], F.col("v"), "upto").collect()}
    total, want = 0, {}
    for i, _, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        total += v
        want[i] = total
    assert got == want


def test_prefix_sum_at_most_is_the_same_prefix(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    whole = prefix_sum(df, [F.col("id")], F.col("v"), "upto").filter("upto <= 900")
    cut = prefix_sum(df, [F.col("id")], F.col("v"), "upto", at_most=900)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in cut.collect()}


def test_prefix_sum_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, v bigint")
    assert prefix_sum(df, [F.col("id")], F.col("v"), "upto").count() == 0


def test_quantiles_pick_values_by_rank(spark):
    xs = [5.0] * 400 + [float(i) for i in range(800)] + [None] * 50
    df = spark.createDataFrame([(x, 1.0) for x in xs], "x double, same double").repartition(9)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df, ["x", "same"], probs)
    known = sorted(x for x in xs if x is not None)
    want = [known[max(1, -(-round(p * 100) * len(known) // 100)) - 1] for p in probs]
    assert got["x"] == want
    assert got["same"] == [1.0] * len(probs)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(1.0, None)], "x double, none double")
    assert quantiles(df, ["x", "none"], [0.5]) == {"x": [1.0], "none": []}


def test_approximate_quantiles_are_close(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("x"))
    (got,) = quantiles(df, ["x"], [0.5], exact=False)["x"]
    assert abs(got - 5000) <= 2


@pytest.mark.parametrize("slices", [1, 3, 40, None])
@pytest.mark.parametrize("strict", [True, False])
def test_running_equals_brute_force_for_any_slices(spark, slices, strict):
    rng = random.Random(3)
    rows = [
        (i, 0 if rng.random() < 0.34 else rng.randrange(1, 40), rng.randrange(-300, 300),
         rng.choice([None, rng.randrange(9)]))
        for i in range(900)
    ]
    df = spark.createDataFrame(rows, "id bigint, k bigint, at bigint, v bigint")
    got = running(df, "k", "at", F.col("v"), F.sum, lambda a, b: a + b, "s", strict, slices)

    def brute(k, at):
        seen = [r[3] for r in rows if r[1] == k and (r[2] < at if strict else r[2] <= at)]
        seen = [v for v in seen if v is not None]
        return sum(seen) if seen else None

    assert {r.id: r.s for r in got.collect()} == {r[0]: brute(r[1], r[2]) for r in rows}


@pytest.mark.parametrize("n", [1, 3, 2000])
def test_first_per_group_with_one_big_group(spark, n):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2500, "big").otherwise("small").alias("g"), F.col("id").alias("k")
    )
    got = first_per_group(df, ["g"], [F.desc("k")], n, "k", "rank").collect()
    want = {("big", 2499 - i, i + 1) for i in range(min(n, 2500))}
    want |= {("small", 2999 - i, i + 1) for i in range(min(n, 500))}
    assert {tuple(r) for r in got} == want


def _rows_per_task(df):
    counts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return sorted(r["count"] for r in counts)


def test_the_largest_slice_does_not_depend_on_the_hottest_key(spark):
    even = spark.range(6000).select((F.col("id") % 60).alias("k"), F.col("id").alias("at"))
    burst = F.when(F.col("id") % 4 == 0, F.col("id") / 4).otherwise(F.col("id") * 10**6).cast("bigint")
    hot = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 59 + 1).otherwise(0).alias("k"), burst.alias("at")
    )
    for df in (even, hot):
        sliced, n = in_slices(df, [F.col("k"), F.col("at")], 12)
        tasks = _rows_per_task(sliced.repartitionById(n, "_slice"))
        assert len(tasks) == 12 and tasks[-1] <= 2 * 6000 / 12


def test_equal_times_count_once_per_row(spark):
    df = spark.createDataFrame([(0, 500)] * 300 + [(0, t) for t in range(1000)], "k bigint, at bigint")
    got = running(df, "k", "at", F.lit(1), F.sum, lambda a, b: a + b, "n", False, 7)
    counts = {(r.at, r.n) for r in got.collect()}
    assert got.count() == 1300 and (499, 500) in counts and (500, 801) in counts


def test_slices_have_a_task_each_and_are_not_hashed(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(5000).select(F.xxhash64("id").alias("x"), F.lit(1).alias("v"))
        summed = prefix_sum(df, [F.col("x")], F.col("v"), "upto")
        plan = summed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    above = plan.split("BroadcastExchange")[0]
    assert "hashpartitioning(_slice" not in above and above.count("Exchange") == 1


def test_folders_go_with_the_session(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import functions as F
from ebbtide.operators import drivers
from ebbtide.session import build_session
from ebbtide.suite.queries import QUERIES
spark = build_session("gone", "local[2]", **{{"spark.checkpoint.dir": {str(tmp_path)!r},
    "spark.sql.shuffle.partitions": "2"}})
QUERIES["rfm_segment"](spark, {str(TESTDATA / 'sf0.001')!r}).count()
QUERIES["stream_sessions"](spark, {str(TESTDATA / 'sf0.001')!r}).count()
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
