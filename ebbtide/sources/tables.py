"""Reading the input tables and writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES: dict[str, DataType] = {
    "int": IntegerType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "string": StringType(),
    "timestamp_ntz": TimestampNTZType(),
}


def _schema(columns: str) -> StructType:
    """Parsing DDL with Spark would need a running session at import time."""
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS = {
    name: _schema(columns)
    for name, columns in {
        "region": "r_regionkey int, r_name string",
        "nation": "n_nationkey int, n_name string, n_regionkey int",
        "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
        "c_mktsegment string",
        "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
        "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
        "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
        "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string",
    }.items()
}


class SchemaDrift(ValueError):
    """A table's columns or types are not the expected ones."""


def check_schema(df: DataFrame, expected: StructType, name: str) -> DataFrame:
    """`df` unchanged, or SchemaDrift naming every differing column (nullability ignored)."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    faults = [
        f"{c}: expected {want.get(c, 'no such column')}, found {have.get(c, 'no such column')}"
        for c in sorted(have.keys() | want.keys())
        if have.get(c) != want.get(c)
    ]
    if faults:
        raise SchemaDrift(f"{name}: " + "; ".join(faults))
    return df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, checked against its expected schema."""
    return check_schema(spark.read.parquet(f"{sf_dir}/{name}.parquet"), SCHEMAS[name], name)


def write_result(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    checkpoint: str | None = None,
) -> StreamingQuery | None:
    """Write parquet. A stream appends until its input is used up and returns its query.

    `mode` is one of Spark's, or `replace`, which needs `partition_by`: partitions that `df` has
    rows of are replaced as a whole and all others stay, so a day that is run again is neither
    doubled nor does it remove another. A partition of which nothing is left stays as it was.

    Batch rows are first rebalanced on the partition columns, so that each folder gets a few
    files of good size and a very big folder is still written by many tasks.

    A stream needs `checkpoint`, a folder all executors share: with the file sink's own log
    it makes a restart carry on without losing or repeating rows.
    """
    if not df.isStreaming:
        if mode == "replace" and not partition_by:
            raise ValueError("replacing partitions needs the columns they are made of")
        if partition_by:
            df = df.hint("rebalance", *partition_by)
        own = "dynamic" if mode == "replace" else "static"
        writer = df.write.mode("overwrite" if mode == "replace" else mode)
        writer.option("partitionOverwriteMode", own).partitionBy(*partition_by).parquet(path)
        return None
    if checkpoint is None:
        raise ValueError("a streaming write needs a checkpoint folder")
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .partitionBy(*partition_by)
        .trigger(availableNow=True)
        .start(path)
    )


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table whose size the planner knows, unlike one made from a Python list.

    Values may be None, numbers and strings.
    """

    def text(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{value!r}D" if isinstance(value, float) else repr(value)

    fields = StructType.fromDDL(schema)
    names = ", ".join(f"`{f.name}`" for f in fields)
    values = ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return table.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
