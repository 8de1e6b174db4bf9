"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def seconds(time: Column) -> Column:
    """Seconds since 1970 of a time without zone (read as UTC), whatever the session's zone is."""
    return F.unix_date(time.cast("date")).cast("long") * 86400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def moment(count: Column) -> Column:
    """The time without zone that is so many seconds after 1970: ``seconds`` turned round."""
    return F.expr("TIMESTAMP_NTZ'1970-01-01'") + F.make_dt_interval(secs=count)


def hour_start(time: Column) -> Column:
    """The full hour of a time without zone."""
    return time.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(time))


def instant(time: Column) -> Column:
    """A time without zone, read as UTC, as an instant (event times of streams)."""
    return F.timestamp_seconds(seconds(time))


def hours_between(later: Column, earlier: Column) -> Column:
    return (seconds(later) - seconds(earlier)) / 3600


def midpoint(start: Column, end: Column) -> Column:
    """The time half-way, to the second."""
    return moment(F.floor((seconds(start) + seconds(end)) / 2))


def percentile_rank(value: str, *groups: str) -> Column:
    """Rank within the group by ``value``, ties averaged, over the number of non-null values; null stays null."""
    value_in = Window.partitionBy(*groups)
    rank = F.rank().over(value_in.orderBy(F.col(value).asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(*groups, value))
    return F.when(F.col(value).isNotNull(), (rank + (ties - 1) / 2) / F.count(value).over(value_in))


def day_start(date: Column, days: int = 0) -> Column:
    """Midnight of a date, some days on."""
    return F.date_add(date, days).cast("timestamp_ntz")


def hashed_order(*keys: Column, seed: int = 0) -> Column:
    """A reproducible random order: the MD5 digest of the keys as text, and a seed."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))))


def first_not_below(values: Column, v: Column) -> Column:
    """Place (from 0) of the first entry of a sorted array that isn't below ``v``, by halving; the array's size if all are."""
    half = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")

    def step(s: Column, _: Column) -> Column:
        less = F.get(values, half(s)) < v
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(less, half(s) + 1).otherwise(s["low"]).alias("low"), F.when(less, s["high"]).otherwise(half(s)).alias("high")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1.0))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(values).alias("high")), step)["low"]
