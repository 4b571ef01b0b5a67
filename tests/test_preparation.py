from __future__ import annotations

import datetime as dt

import pytest
from conftest import TESTDATA, as_set
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ebbtide.operators.preparation import (
    RELATIONS,
    Relation,
    integrity_report,
    order_days,
    period_spine,
)
from ebbtide.sources import SCHEMAS, SchemaDrift, check_schema, load, write_result


def test_load_checks_types(spark):
    assert load(spark, str(TESTDATA / "sf0.001"), "orders").count() == 1500
    drifted = spark.range(1).select(F.lit(1).cast("bigint").alias("r_regionkey"))
    with pytest.raises(SchemaDrift, match="r_name: expected string.*r_regionkey: expected int"):
        check_schema(drifted, SCHEMAS["region"], "region")


def test_every_relation_names_known_columns():
    for r in RELATIONS:
        assert isinstance(SCHEMAS[r.parent], StructType)
        assert r.parent_key in SCHEMAS[r.parent].names and r.child_key in SCHEMAS[r.child].names


def test_integrity_report_counts_each_fault(spark):
    parents = spark.createDataFrame([(1,), (1,), (2,), (3,)], "p bigint")
    children = spark.createDataFrame([(1,), (1,), (9,), (9,), (None,)], "c bigint")
    report = integrity_report({"a": parents, "b": children}, [Relation("a", "p", "b", "c")])
    assert as_set(report) == {("b.c->a.p", 1, 3, 2)}


def test_integrity_report_of_empty_tables(spark):
    none = spark.createDataFrame([], "p bigint, c bigint")
    report = integrity_report({"a": none, "b": none}, [Relation("a", "p", "b", "c")])
    assert as_set(report) == {("b.c->a.p", 0, 0, 0)}


def test_order_days_collapse_one_day(spark):
    at = dt.datetime
    orders = spark.createDataFrame(
        [(1, 1, "O", 10.0, at(2000, 1, 1), "x"), (2, 1, "O", 5.0, at(2000, 1, 1, 23), "x"),
         (3, 1, "O", 1.0, at(2000, 1, 2), "x")],
        SCHEMAS["orders"],
    )
    day = dt.date(2000, 1, 1)
    assert as_set(order_days(orders)) == {(1, day, 2, 15.0), (1, dt.date(2000, 1, 2), 1, 1.0)}
    assert as_set(order_days(orders, until="2000-01-02")) == {(1, day, 2, 15.0)}


def test_day_filters_reach_the_scan(spark, capsys):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    orders = load(spark, str(TESTDATA / "sf0.001"), "orders")
    order_days(orders, "2000-01-01", "2000-02-01").explain()
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01" in plan
    assert "LessThan(o_orderdate,2000-02-01" in plan
    assert "o_orderpriority" not in plan


def test_period_spine_starts_at_the_first_quarter(facts):
    spine = period_spine(facts((1, "2000-11-05"), (1, "2001-02-01"), (2, "2001-09-01")), "2001-06-30")
    assert as_set(spine) == {(1, 8003), (1, 8004), (1, 8005)}


def test_write_result_partitions_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (5, 3):
        write_result(spark.range(n).withColumn("p", F.col("id") % 2), path, partition_by=["p"])
    assert spark.read.parquet(path).count() == 3
    assert (tmp_path / "out" / "p=1").is_dir()


def test_a_stream_cannot_be_written_without_a_checkpoint(spark, tmp_path):
    rate = spark.readStream.schema("id bigint").parquet(str(tmp_path))
    with pytest.raises(ValueError, match="checkpoint"):
        write_result(rate, str(tmp_path / "out"))


def test_a_day_run_again_replaces_only_itself(spark, tmp_path):
    path = str(tmp_path / "days")

    def run(day, values, mode="replace"):
        df = spark.createDataFrame([(day, v) for v in values], "day string, v int")
        write_result(df, path, mode, ["day"])

    run("a", [1, 2, 3])
    run("b", [4, 5])
    run("a", [6])
    assert as_set(spark.read.parquet(path)) == {(6, "a"), (4, "b"), (5, "b")}
    run("a", [])  # nothing to put in its place
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        write_result(spark.range(1), path, "replace")
    # `overwrite` means the whole, whatever the session says.
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        run("c", [7], "overwrite")
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert as_set(spark.read.parquet(path)) == {(7, "c")}
