"""Running aggregates along each key's time line, whatever share of the rows one key or time has.

Rows are range partitioned by key, time and a number of their own into slices of neighbours, and
written. A task works on one slice and gives its rows their results, so rows shuffle for that once
more and meet nothing but a broadcast of at most two rows per slice. Only the first and the last
key of a slice can have rows elsewhere. For those the slice's rows are summed up in three points:
at its first time, in between, and at its last time. A key's points, at most three per slice,
give the results at the times where slices meet, also if one time fills several slices, and what
rows in between start from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.plans.ranked import in_slices


def running(
    df: DataFrame,
    key: str,
    at: str,
    value: Column,
    how: Callable[[Column], Column],
    merge: Callable[[Column, Column], Column],
    name: str,
    strict: bool,
    slices: int | None = None,
) -> DataFrame:
    """`df` plus `name`: `how` of `value` over the key's rows up to the row's own time `at`.

    Rows at the same time count too unless `strict`. `how` is an aggregate that can be taken of
    its own results (sum, max, min), `merge` joins two results. `at` is a whole number. Rows
    without a key are left out. Rows without a time are each other's peers only: they count for
    no other row, and for each other unless `strict`.
    """
    group = [key, "_none"]
    known = df.filter(F.col(key).isNotNull()).select(
        "*",
        value.alias("_value"),
        F.col(at).isNull().alias("_none"),
        F.coalesce(at, F.lit(0).cast("bigint")).alias("_at"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # The row's number splits times with very many rows.
    sliced, n = in_slices(known, [F.col(c) for c in (*group, "_at", "_row")], slices)
    ends = sliced.groupBy("_slice").agg(
        F.min(F.struct(*group)).alias("_first"), F.max(F.struct(*group)).alias("_last")
    )
    # At most two rows per slice: keys that may have rows in other slices, and their times here.
    spans = (
        sliced.groupBy("_slice", *group)
        .agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
        .join(F.broadcast(ends), "_slice")
        .filter((F.struct(*group) == F.col("_first")) | (F.struct(*group) == F.col("_last")))
        .select("_slice", *group, "_from", "_to")
    )
    # Twice the time for a time where slices may meet, and one more for what is in between.
    place = F.when(F.col("_at") == F.col("_from"), 2 * F.col("_from")).when(
        F.col("_at") == F.col("_to"), 2 * F.col("_to")
    )
    points = (
        sliced.join(F.broadcast(spans), ["_slice", *group])
        .groupBy(*group, F.coalesce(place, 2 * F.col("_from") + 1).alias("_place"))
        .agg(how(F.col("_value")).alias("_value"))
    )
    line = W.partitionBy(*group).orderBy("_place")
    upto = how(F.col("_value")).over(line.rowsBetween(W.unboundedPreceding, 0))
    before = how(F.col("_value")).over(line.rowsBetween(W.unboundedPreceding, -1))
    met = points.select(*group, "_place", upto.alias("_upto"), (before if strict else upto).alias("_here"))

    def at_time(time: str, *results: str) -> DataFrame:
        return met.select(
            *group, F.shiftright("_place", 1).alias(time), *[F.col(c).alias(f"{time}{c}") for c in results]
        ).where(F.col("_place") % 2 == 0)

    carried = (
        spans.join(at_time("_from", "_here", "_upto"), [*group, "_from"])
        .join(at_time("_to", "_here"), [*group, "_to"])
        .select("_slice", *group, "_from", "_to", "_from_here", "_from_upto", "_to_here")
    )
    placed = sliced.repartitionById(n, "_slice").join(F.broadcast(carried), ["_slice", *group], "left")
    alone = F.col("_from").isNull()  # all rows of the key are in this slice
    later = F.when(alone | (F.col("_at") > F.col("_from")), F.col("_value"))
    inside = W.partitionBy("_slice", *group).orderBy("_at")
    inside = inside.rangeBetween(W.unboundedPreceding, -1 if strict else W.currentRow)
    own, carry = F.col("_own"), F.col("_from_upto")
    either = F.when(own.isNull(), carry).when(carry.isNull(), own).otherwise(merge(own, carry))
    found = (
        F.when(alone, own)
        .when(F.col("_at") == F.col("_from"), F.col("_from_here"))
        .when(F.col("_at") == F.col("_to"), F.col("_to_here"))
        .otherwise(either)
    )
    others = [c for c in df.columns if c not in (key, at)]
    return placed.withColumn("_own", how(later).over(inside)).select(key, at, *others, found.alias(name))
