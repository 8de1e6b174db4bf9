"""Statistics of a growing archive that take one more month without reading the others.

The state of a month has, per cell, the number of hours, their mean and sum of squared deviations, and counts of values in fixed ranges. States
of months merge: moments by the usual formula for two parts, counts by adding. A quantile's place falls into one range of the merged counts;
only values of that range are then read, from all months, to find it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values: a sixteenth of a doubling each, from 2^-10 on; smaller values are range 0.
STEPS, LEAST_POWER = 16, -10


def value_range(value: Column) -> Column:
    return F.when(value < 2.0**LEAST_POWER, 0).otherwise(1 + F.floor((F.log2(value) - LEAST_POWER) * STEPS)).cast("int")


def month_states(precip: DataFrame) -> DataFrame:
    """(month, cid, n, mean, m2, ranges): one row per cell and month; ``ranges`` maps a range to its number of values."""
    rows = precip.filter("precip IS NOT NULL").select(F.trunc("time", "month").alias("month"), "cid", "precip", value_range(F.col("precip")).alias("range"))
    per_range = rows.groupBy("month", "cid", "range").agg(F.count("*").alias("k"), F.sum("precip").alias("s"), F.var_pop("precip").alias("v"))
    whole = Window.partitionBy("month", "cid")
    mean = F.sum("s").over(whole) / F.sum("k").over(whole)
    parts = per_range.withColumn("mean", mean)
    inner = F.col("k") * (F.col("v") + F.pow(F.col("s") / F.col("k") - F.col("mean"), F.lit(2.0)))
    counts = F.map_from_entries(F.collect_list(F.struct("range", "k")))  # at most some hundred ranges
    return parts.groupBy("month", "cid").agg(F.sum("k").alias("n"), F.first("mean").alias("mean"), F.sum(inner).alias("m2"), counts.alias("ranges"))


def merged_moments(states: DataFrame) -> DataFrame:
    """(cid, n, mean, sd) of all months."""
    whole = Window.partitionBy("cid")
    rows = states.withColumn("all", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole))
    spread = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("all"), F.lit(2.0)))
    return rows.groupBy("cid").agg(F.sum("n").alias("n"), F.first("all").alias("mean"), F.sqrt(spread / F.sum("n")).alias("sd"))


def quantile_ranges(states: DataFrame, level: float) -> DataFrame:
    """(cid, low, high, before, at): the ranges that hold the two values beside the quantile's place, and the values before them."""
    counts = states.select("cid", F.explode("ranges").alias("range", "k")).groupBy("cid", "range").agg(F.sum("k").alias("k"))
    so_far, whole = Window.partitionBy("cid").orderBy("range"), Window.partitionBy("cid")
    rows = counts.withColumns({"end": F.sum("k").over(so_far), "at": level * (F.sum("k").over(whole) - 1)})
    holds = lambda place: (place >= F.col("end") - F.col("k")) & (place < F.col("end"))
    rows = rows.filter(holds(F.floor("at")) | holds(F.ceil("at")))
    return rows.groupBy("cid").agg(F.min("range").alias("low"), F.max("range").alias("high"), F.min(F.col("end") - F.col("k")).alias("before"), F.first("at").alias("at"))


def archive_quantile(states: DataFrame, precip: DataFrame, level: float) -> DataFrame:
    """(cid, value): the exact quantile, on the line between two values; reads of ``precip`` only values in the ranges that hold it.

    The ranges' least and largest bound go to the scan as a filter, and each cell's own range is checked behind it.
    """
    asked = quantile_ranges(states, level)
    bounds = asked.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    if bounds["low"] is None:
        return asked.select("cid", F.lit(None).cast("double").alias("value"))
    bound = lambda r: 2.0 ** (LEAST_POWER + (r - 1) / STEPS) if r > 0 else float("-inf")
    slack = 1 + 1e-9
    rows = precip.filter((F.col("precip") >= bound(bounds["low"]) / slack) & (F.col("precip") < bound(bounds["high"] + 1) * slack))
    met = rows.select("cid", "precip", value_range(F.col("precip")).alias("range")).join(asked, "cid").filter("range BETWEEN low AND high")
    counts = met.groupBy("cid", "precip", "before", "at").agg(F.count("*").alias("k"))
    ends = counts.withColumn("end", F.col("before") + F.sum("k").over(Window.partitionBy("cid").orderBy("precip")))
    holds = lambda place: (place >= F.col("end") - F.col("k")) & (place < F.col("end"))
    pick = lambda place: F.max(F.when(holds(place), F.col("precip")))
    share = F.first(F.col("at") - F.floor("at"))
    low, high = pick(F.floor("at")), pick(F.ceil("at"))
    return ends.groupBy("cid").agg((low + (high - low) * share).alias("value"))
