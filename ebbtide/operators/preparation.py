"""From raw orders to the grains the other operators work on."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.functions import day, quarter_index
from ebbtide.functions.columns import quarter_of


def order_facts(
    orders: DataFrame, since: str | dt.date | None = None, until: str | dt.date | None = None
) -> DataFrame:
    """k, d, amount per order in [since, until). A projection: no shuffle.

    Enough for every operator that does not care about several orders on one day.
    """
    facts = orders.select(
        F.col("o_custkey").alias("k"),
        F.to_date("o_orderdate").alias("d"),
        F.col("o_totalprice").alias("amount"),
    )
    return between(facts, since, until)


def between(
    facts: DataFrame, since: str | dt.date | None, until: str | dt.date | None
) -> DataFrame:
    """Rows with d in [since, until). The optimizer turns this into a filter on the raw column."""
    if since is not None:
        facts = facts.filter(F.col("d") >= F.lit(day(since)))
    if until is not None:
        facts = facts.filter(F.col("d") < F.lit(day(until)))
    return facts


def order_days(
    orders: DataFrame, since: str | dt.date | None = None, until: str | dt.date | None = None
) -> DataFrame:
    """k, d, n_orders, amount: one row per customer and day with an order.

    Counted before the shuffle, so afterwards no customer has more rows than the calendar has
    days; windows over one customer are bounded by that, however many orders it placed.
    """
    return (
        order_facts(orders, since, until)
        .groupBy("k", "d")
        .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("amount").alias("amount"))
    )


def customer_dims(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """k, segment, nation, region, balance per customer; unknown nations give nulls.

    No broadcast hint: Spark picks one from the file sizes, and joins by shuffle beyond its
    threshold.
    """
    places = nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        "n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )
    return customer.join(places, customer.c_nationkey == places.n_nationkey, "left").select(
        F.col("c_custkey").alias("k"),
        F.col("c_mktsegment").alias("segment"),
        "nation",
        "region",
        F.col("c_acctbal").alias("balance"),
    )


@dataclass(frozen=True)
class Relation:
    """A parent key column and the child column that should refer to it."""

    parent: str
    parent_key: str
    child: str
    child_key: str

    @property
    def name(self) -> str:
        return f"{self.child}.{self.child_key}->{self.parent}.{self.parent_key}"


RELATIONS = (
    Relation("region", "r_regionkey", "nation", "n_regionkey"),
    Relation("nation", "n_nationkey", "customer", "c_nationkey"),
    Relation("customer", "c_custkey", "orders", "o_custkey"),
    Relation("orders", "o_orderkey", "lineitem", "l_orderkey"),
    Relation("customer", "c_custkey", "events", "user_id"),
)


def integrity_report(
    tables: dict[str, DataFrame], relations: Sequence[Relation] = RELATIONS
) -> DataFrame:
    """Per relation: surplus parent rows, child rows without a parent, parents without a child.

    Each table is read once and gives a row per relation it takes part in; those are counted
    per relation and key, combined before the shuffle, so no join is needed and a hot key is
    one row. Null child keys count as orphans; null parent keys are never matched.
    """

    def ends(name: str) -> DataFrame:
        sides = [
            F.struct(
                F.lit(r.name).alias("relation"),
                F.col(key).cast("bigint").alias("key"),
                F.lit(int(parent)).cast("bigint").alias("parents"),
                F.lit(int(not parent)).cast("bigint").alias("children"),
            )
            for r in relations
            for parent, table, key in ((True, r.parent, r.parent_key), (False, r.child, r.child_key))
            if table == name
        ]
        return tables[name].select(F.inline(F.array(*sides)))

    named = {n: None for r in relations for n in (r.parent, r.child)}
    rows = reduce(DataFrame.unionByName, [ends(n) for n in named])
    parents, children, lone = F.col("parents"), F.col("children"), F.col("key").isNull()
    empty = F.array(*[F.struct(F.lit(r.name).alias("relation")) for r in relations])
    every = rows.sparkSession.range(1).select(F.inline(empty))
    found = (
        rows.groupBy("relation", "key")
        .agg(F.sum("parents").alias("parents"), F.sum("children").alias("children"))
        .groupBy("relation")
        .agg(
            F.sum(F.greatest(parents - 1, F.lit(0))).alias("duplicate_keys"),
            F.sum(F.when((parents == 0) | lone, children).otherwise(0)).alias("orphans"),
            F.count_if((parents > 0) & ((children == 0) | lone)).alias("childless"),
        )
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("duplicate_keys", "orphans", "childless")]
    return every.join(F.broadcast(found), "relation", "left").select("relation", *counts)


def period_spine(facts: DataFrame, until: str | dt.date) -> DataFrame:
    """k, q for every quarter from a customer's first order up to the quarter of `until`."""
    last = F.lit(quarter_of(day(until))).cast("bigint")
    return (
        facts.groupBy("k")
        .agg(quarter_index(F.min("d")).alias("first"))
        .filter(F.col("first") <= last)
        .select("k", F.explode(F.sequence("first", last)).alias("q"))
    )


def active_quarters(facts: DataFrame, until: str | dt.date) -> DataFrame:
    """k, q, first: the quarters with an order, up to the quarter of `until`."""
    last = F.lit(quarter_of(day(until))).cast("bigint")
    return (
        facts.select("k", quarter_index(F.col("d")).alias("q"))
        .filter(F.col("q") <= last)
        .distinct()
        .withColumn("first", F.min("q").over(W.partitionBy("k")))
    )
