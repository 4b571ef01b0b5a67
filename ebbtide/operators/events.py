"""Event behaviour. Sessions and silences are reduced per user and gap-wide cell before they
shuffle; running results are worked out in slices of the sorted (user, time) pairs, so a user's
events are spread over as many tasks as they fill."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.functions import cell_start, day, from_micros, micros, ratio
from ebbtide.plans import running, sliced_once

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def _greatest(a, b):
    return F.when(a >= b, a).otherwise(b)


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("at", micros(F.col("ts")))


def sessions(events: DataFrame, gap: int = 6 * HOUR) -> DataFrame:
    """user_id, session_start, session_end, events; a wait of `gap` or more starts a new one.

    Events of one gap-wide cell are less than a gap apart, hence in the same session. So only
    first, last and count per user and cell shuffle, and sessions are runs of those cells.

    Runs are found slice by slice of the (user, cell) pairs, so a user with a short gap and very
    many cells is spread over as many tasks as they fill. Only the first and the last run a user
    has in a slice can go on in another; those, at most two per slice, meet per user, and all
    others are sessions already.
    """
    cells = (
        _timed(events)
        .groupBy("user_id", cell_start(F.col("at"), gap).alias("cell"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    )
    opens = F.when(F.col("first") - F.col("before") < gap, 0).otherwise(1)
    inside = W.partitionBy("_slice", "user_id")
    runs = (
        sliced_once(cells, [F.col("user_id"), F.col("cell")])
        .withColumn("before", F.lag("last").over(inside.orderBy("cell")))
        .withColumn("run", F.sum(opens).over(inside.orderBy("cell")))
        .groupBy("_slice", "user_id", "run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    )
    edge = (F.col("run") == 1) | F.lead("run").over(inside.orderBy("run")).isNull()
    # Runs inside a slice are alone under their own start; a user's edges share none.
    placed = runs.withColumn("alone", F.when(~edge, F.col("first")))
    line = W.partitionBy("user_id", "alone").orderBy("first")
    return (
        placed.withColumn("before", F.lag("last").over(line))
        .withColumn("session", F.sum(opens).over(line))
        .groupBy("user_id", "alone", "session")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("events"))
        .select(
            "user_id",
            from_micros(F.col("first")).alias("session_start"),
            from_micros(F.col("last")).alias("session_end"),
            "events",
        )
    )


def funnel(events: DataFrame, steps: Sequence[str], within: int = DAY) -> DataFrame:
    """user_id, furthest: how many of the ordered steps the user completed at best.

    Steps must be strictly later than each other and at most `within` after step 1. Users
    without any step's event are absent; without a first step, furthest is 0. Rows without a
    time can only be a first step.

    Of all chains that reach a step, the one that started last has the most time left, so one
    start per step tells all about what a user has done so far. The (user, time) pairs are range
    partitioned into slices, and each slice is summed up per user: the latest start of chains
    that begin in it and reach step j (s_j), and how early step j can be completed in it by a
    chain that comes in with step i (e_i_j). Such summaries follow each other as functions do,
    so a user's are folded in the order of slices; a user has at most one per slice.
    """
    k = len(steps)
    kind, at = F.col("event_type"), F.col("at")
    line = (
        _timed(events.filter(kind.isin(list(steps)) & F.col("user_id").isNotNull()))
        .groupBy("user_id", "at")
        .agg(*[F.bool_or(kind == name).alias(f"is_{j}") for j, name in enumerate(steps, 1)])
    )
    placed = sliced_once(line, [F.col("user_id"), at])
    before = W.partitionBy("_slice", "user_id").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("s_1", F.when(F.col("is_1"), at))
    ends: list[str] = []
    for j in range(2, k + 1):
        here = F.col(f"is_{j}") & at.isNotNull()
        chain = F.max(f"s_{j - 1}").over(before)
        done = {f"s_{j}": F.when(here & (at - chain <= within), chain)}
        for i in range(1, j):
            come = here if i == j - 1 else here & F.min(f"e_{i}_{j - 1}").over(before).isNotNull()
            done[f"e_{i}_{j}"] = F.when(come, at)
        ends += list(done)[1:]
        placed = placed.withColumns(done)
    starts = [f"s_{j}" for j in range(1, k + 1)]
    parts = placed.groupBy("_slice", "user_id").agg(
        *[F.max(c).alias(c) for c in starts], *[F.min(c).alias(c) for c in ends], F.bool_or("is_1").alias("is_1")
    )

    def follow(was: Column, part: Column) -> Column:
        def start(j: int) -> Column:
            onward = [
                F.when(part[f"e_{i}_{j}"] - was[f"s_{i}"] <= within, was[f"s_{i}"]) for i in range(1, j)
            ]
            return F.greatest(was[f"s_{j}"], part[f"s_{j}"], *onward)

        return F.struct(*[start(j).alias(f"s_{j}") for j in range(1, k + 1)])

    nothing = F.struct(*[F.lit(None).cast("bigint").alias(c) for c in starts])
    whole = parts.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("_slice", *starts, *ends))).alias("parts"),
        F.bool_or("is_1").alias("is_1"),
    )
    done = F.aggregate("parts", nothing, follow)
    reached = F.when(F.col("is_1"), 1).otherwise(0)
    for j in range(2, k + 1):
        reached = F.when(F.col("done")[f"s_{j}"].isNotNull(), j).otherwise(reached)
    return whole.withColumn("done", done).select("user_id", reached.cast("int").alias("furthest"))


def event_retention(
    events: DataFrame, days: Sequence[int], observed_until: str | dt.date | None = None
) -> DataFrame:
    """day_n, users, returned, rate: users seen again exactly n days after their first day.

    Only users whose day n is observed count. One row per user and active day is all that
    shuffles; every n shares one aggregate.
    """
    active = events.select("user_id", F.to_date("ts").alias("d"))
    last = day(observed_until) if observed_until else active.agg(F.max("d")).first()[0]
    first = F.min("d").over(W.partitionBy("user_id"))
    ages = active.distinct().withColumn("first", first).withColumn("age", F.datediff("d", "first"))
    rows = [
        F.struct(
            F.lit(n).alias("day_n"),
            F.count_if((F.col("age") == 0) & (F.date_add("first", n) <= F.lit(last))).alias("users"),
            F.count_if((F.col("age") == n) & (F.col("d") <= F.lit(last))).alias("returned"),
        )
        for n in days
    ]
    return (
        ages.agg(F.array(*rows).alias("rows"))
        .select(F.inline("rows"))
        .withColumn("rate", ratio(F.col("returned"), F.col("users")))
    )


def quiet_periods(events: DataFrame, hours: int = 24) -> DataFrame:
    """user_id, last_event_id, last_type, quiet_from, quiet_until, wait_seconds: every wait
    between two events of at least `hours`, with the last event before it.

    As with sessions, such a wait can only lie between two cells of that width.
    """
    width = hours * HOUR
    cells = (
        _timed(events)
        .groupBy("user_id", cell_start(F.col("at"), width).alias("cell"))
        .agg(
            F.min("at").alias("first"),
            F.max(F.struct("at", "event_id", "event_type")).alias("last"),
        )
    )
    following = F.lead("first").over(W.partitionBy("user_id").orderBy("cell"))
    return (
        cells.withColumn("next", following)
        .filter(F.col("next") - F.col("last.at") >= width)
        .select(
            "user_id",
            F.col("last.event_id").alias("last_event_id"),
            F.col("last.event_type").alias("last_type"),
            from_micros(F.col("last.at")).alias("quiet_from"),
            from_micros(F.col("next")).alias("quiet_until"),
            ((F.col("next") - F.col("last.at")) / SECOND).alias("wait_seconds"),
        )
    )


def rolling_errors(events: DataFrame, days: int = 7, kind: str = "error") -> DataFrame:
    """event_id, user_id, ts, errors: errors of the user in [ts - days, ts], at each event.

    An error counts +1 at its time and -1 just after its window ends; the running sum of both
    is the count, so the window can be sliced like any running sum.
    """
    timed = _timed(events).select("event_id", "user_id", "at", "event_type")
    error = F.col("event_type") == kind
    # Doubled times leave room for "just after".
    here = F.struct((F.col("at") * 2).alias("at"), error.cast("int").alias("step"))
    after = F.struct(
        ((F.col("at") + days * DAY) * 2 + 1).alias("at"), F.lit(-1).alias("step")
    )
    steps = timed.select(
        "event_id",
        "user_id",
        F.explode(F.when(error & F.col("at").isNotNull(), F.array(here, after)).otherwise(F.array(here))).alias("s"),
    ).select("event_id", "user_id", "s.at", "s.step")
    counted = running(
        steps, "user_id", "at", F.col("step"), F.sum, lambda a, b: a + b, "errors", strict=False
    )
    return counted.filter(F.col("step") >= 0).select(
        "event_id", "user_id", from_micros(F.shiftright("at", 1)).alias("ts"), "errors"
    )


def last_before(events: DataFrame, kind: str) -> DataFrame:
    """event_id, user_id, ts, last_ts, last_value: the user's latest event of one type that is
    strictly before each event, null if none; equal times go by event_id."""
    timed = _timed(events).select("event_id", "user_id", "at", "event_type", "value")
    wanted = F.when(F.col("event_type") == kind, F.struct("at", "event_id", "value"))
    found = running(timed, "user_id", "at", wanted, F.max, _greatest, "found", strict=True)
    return found.select(
        "event_id",
        "user_id",
        from_micros(F.col("at")).alias("ts"),
        from_micros(F.col("found.at")).alias("last_ts"),
        F.col("found.value").alias("last_value"),
    )
