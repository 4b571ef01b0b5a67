"""Global order without a one-task sort: prefix sums, exact quantiles, best rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.plans.durable import durable

SALTS = 64


def in_slices(
    df: DataFrame, order: Sequence[Column], slices: int | None = None
) -> tuple[DataFrame, int]:
    """`df` range partitioned by `order`, with the partition number as `_slice`, and how many
    slices there are. Written, as a second run could draw other bounds."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id())), n


def sliced_once(df: DataFrame, order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """`df` in slices as `in_slices` makes them, a task each, without a written copy.

    For results that read the slices once: bounds are drawn once for an execution and hold for
    tasks that are run again, but another execution may draw others.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id())
    return numbered.repartitionById(n, "_slice")


def prefix_sum(
    df: DataFrame,
    order: Sequence[Column],
    value: Column,
    name: str,
    at_most: float | None = None,
) -> DataFrame:
    """`df` plus `name`, the sum of `value` over all rows up to and including this one.

    `order` must be a total order of the rows. Rows are range partitioned by it, so a slice is
    a run of neighbours, whatever the distribution; each slice adds the total of those before
    it. Nothing but one total per slice is ever brought together, and that table has at most
    as many rows as there are partitions, hence the broadcast.

    With `at_most`, which needs values that are never negative, only rows whose sum stays at
    or below it are kept, and slices that start beyond it are dropped before they shuffle.
    """
    sliced, n = in_slices(df.withColumn("_value", value), order)
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_slice")
        .agg(F.sum("_value").alias("_total"))
        .select("_slice", F.sum("_total").over(before).alias("_before"))
    )
    inside = W.partitionBy("_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = sliced.join(F.broadcast(offsets), "_slice")
    before_slice = F.coalesce("_before", F.lit(0))
    if at_most is not None:
        placed = placed.filter(before_slice <= at_most)
    # By slice number, not its hash, so each slice has a task of its own.
    placed = placed.repartitionById(n, "_slice")
    summed = placed.withColumn(name, F.sum("_value").over(inside) + before_slice)
    if at_most is not None:
        summed = summed.filter(F.col(name) <= at_most)
    return summed.drop("_slice", "_value", "_before")


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact: bool = True
) -> dict[str, list[float]]:
    """For each column, the smallest value with at least a share p of the values at or below it.

    Nulls are left out. Exact: values are counted, the counts are prefix summed in value
    order, and the rows holding the wanted ranks are picked, so only columns x probs rows
    reach the driver. Otherwise one pass of mergeable sketches, off by at most 0.01% in rank.
    """
    if not exact:
        row = df.agg(
            *[F.percentile_approx(c, list(probs), 10000).alias(c) for c in columns]
        ).first()
        return {c: [float(v) for v in row[c] or ()] for c in columns}
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x"))
              for i, c in enumerate(columns)]
        )
    )
    counts = (
        df.select(pairs.alias("p"))
        .select("p.c", "p.x")
        .filter(F.col("x").isNotNull())
        .groupBy("c", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = prefix_sum(counts, [F.col("c"), F.col("x")], F.col("n"), "upto")
    ends = {
        r["c"]: (r["lo"], r["hi"])
        for r in ranked.groupBy("c")
        .agg(F.min(F.col("upto") - F.col("n")).alias("lo"), F.max("upto").alias("hi"))
        .collect()
    }
    ranks = {
        (c, j): lo + max(1, _ceil(p * (hi - lo)))
        for c, (lo, hi) in ends.items()
        for j, p in enumerate(probs)
    }
    hit = F.lit(False)
    for rank in ranks.values():
        hit = hit | ((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    rows = ranked.filter(hit).collect()
    return {
        name: [
            next(r["x"] for r in rows if r["c"] == i and r["upto"] - r["n"] < ranks[i, j] <= r["upto"])
            for j in range(len(probs))
        ]
        if i in ends
        else []
        for i, name in enumerate(columns)
    }


def _ceil(x: float) -> int:
    """Ceiling that forgives the last bits of p * n, e.g. 0.1 * 30 = 3.0000000000000004."""
    near = round(x)
    return near if abs(x - near) < 1e-9 * max(1.0, abs(x)) else int(x) + 1


def first_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, spread: str, rank: str
) -> DataFrame:
    """The first `n` rows of each group in a total `order`, numbered in `rank`.

    Groups are few and large here, so each is first cut by a hash of `spread` and every cut
    keeps its own n; a group's last task sees at most SALTS x n rows.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS))
    cut = W.partitionBy(*group, "_salt").orderBy(*order)
    whole = W.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(cut))
        .filter(F.col("_rank") <= n)
        .drop("_salt", "_rank")
        .withColumn(rank, F.row_number().over(whole).cast("bigint"))
        .filter(F.col(rank) <= n)
    )
