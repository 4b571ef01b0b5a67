"""Small column expressions shared by the operators. All stay in generated JVM code."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day(value: str | dt.date) -> dt.date:
    """A date from an ISO string or a date."""
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def quarter_index(d: Column) -> Column:
    """Calendar quarters counted from year 0, so neighbours differ by one."""
    return (F.year(d) * 4 + F.quarter(d) - 1).cast("bigint")


def quarter_of(value: dt.date) -> int:
    """`quarter_index` of a plain date."""
    return value.year * 4 + (value.month - 1) // 3


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp; a naive one is taken in the session time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(m: Column) -> Column:
    """Naive timestamp from microseconds, the inverse of `micros`."""
    return F.timestamp_micros(m).cast("timestamp_ntz")


def cell_start(at: Column, width: int) -> Column:
    """Start of the half-open cell of `width` that holds `at`, also before 1970."""
    return at - F.pmod(at, F.lit(width))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is zero."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def bucket_percent(key: Column, salt: str) -> Column:
    """Stable number 0..99 from the salt and the key, the same on every run and engine."""
    digest = F.md5(F.concat(F.lit(salt), F.lit(":"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100


def unused(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
