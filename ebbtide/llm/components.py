"""Connected components of a graph whose edges never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.plans import durable

SALTS = 8


def _state(edges: DataFrame) -> tuple[int, int]:
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    row = edges.agg(F.count("*"), F.sum(mark)).first()
    return row[0], int(row[1] or 0)


def _least(edges: DataFrame) -> DataFrame:
    """u, v, least: the smallest v of each u beside each of its edges. The table of smallest
    ones is repeated per salt, so a node with very many edges is dealt to several tasks."""
    least = (
        edges.groupBy("u")
        .agg(F.min("v").alias("least"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(
        least, ["u", "salt"]
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of `edges` (u, v bigint).

    Large-star and small-star steps by turns: each links a node's neighbours to the smallest
    among them, until every node hangs on its component's smallest. Rounds grow with the
    logarithm of the longest chain. Loops, repeated edges and either direction are fine; nulls
    must not occur; no edges give no rows.
    """
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    now = durable(edges.filter("u <> v").select(*pair).distinct())
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _least(both)
            .filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
            .distinct()
        )
        small = _least(large)
        links = small.select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v")
        now = durable(links.union(small.select("u", F.col("least").alias("v"))).distinct())
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
