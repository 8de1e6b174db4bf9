"""Gridded series and static attributes: neighbours, windows around samples, blocks, feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import seconds


def neighbours(cells: DataFrame, size: int = 3, step: float = 1000.0) -> DataFrame:
    """(cid, nbr_cid, weight): the cells of a ``size`` x ``size`` square around each cell.

    Squares that reach over the grid's edge repeat the cells along it, which gives them a larger weight. A place
    that the grid has no cell for is left out.
    """
    half = size // 2
    box = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))  # one row
    shift = lambda name: F.explode(F.sequence(F.lit(-half), F.lit(half))).alias(name)
    spread = cells.select("cid", "x", "y", shift("i")).select("*", shift("j")).join(F.broadcast(box))
    inside = lambda v, low, high: F.least(F.greatest(v, F.col(low)), F.col(high))
    moved = spread.select("cid", inside(F.col("x") + F.col("i") * step, "x0", "x1").alias("x"), inside(F.col("y") + F.col("j") * step, "y0", "y1").alias("y"))
    met = moved.join(cells.select(F.col("cid").alias("nbr_cid"), "x", "y"), ["x", "y"])
    return met.groupBy("cid", "nbr_cid").agg(F.count("*").alias("weight"))


#: Cells along a tile's side, and days of a tile's part, in ``smooth``.
TILE, TILE_DAYS = 16, 8


def smooth(precip: DataFrame, cells: DataFrame, size: int = 3, step: float = 1000.0, tile: int = TILE) -> DataFrame:
    """Mean over the square around each cell per hour; nulls, and places that the grid has no cell for, count as 0.

    The grid is cut into tiles of ``tile`` x ``tile`` cells. Cells near a border are copied to the tiles that they are seen from, so that
    about ``1 + 4 * (size // 2) / tile`` rows are shuffled for each one, and each tile finds its own sums: an hour's value is
    added to all cells around it, the edge cells' as often as the square repeats them, and where an edge is. A cell has a
    mean for each hour that any cell around it has a row for.
    """
    half = size // 2
    place = {"col": F.floor(F.col("x") / step), "row": F.floor(F.col("y") / step)}
    box = cells.agg(*[f(c).alias(f"{n}_{k}") for k, c in place.items() for n, f in (("low", F.min), ("high", F.max))])  # one row
    rows = precip.select("cid", "time", F.coalesce("precip", F.lit(0.0)).alias("precip"), *[c for c in ("x", "y") if c in precip.columns])
    rows = rows if "x" in rows.columns else rows.join(cells.select("cid", "x", "y"), "cid")
    tiles = lambda k: F.array_distinct(F.array(*[F.floor((F.col(k) + i) / tile) for i in range(-half, half + 1)]))
    part = F.floor(F.datediff("time", F.lit("1970-01-01")) / TILE_DAYS).alias("part")
    seen = rows.select("time", "precip", part, *[c.alias(k) for k, c in place.items()])
    seen = seen.withColumn("tx", F.explode(tiles("col"))).withColumn("ty", F.explode(tiles("row"))).repartition("tx", "ty", "part").join(F.broadcast(box))

    def spread(rows: DataFrame, k: str, t: str, to: str) -> DataFrame:
        """Each place's value to the cells of its tile on this axis that see it, times as often as their squares hold it."""
        low, high, at = F.col(f"low_{k}"), F.col(f"high_{k}"), F.col(to)
        near = rows.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(-half, half + 1)]))).withColumn(to, F.col(k) + F.col("i"))
        near = near.filter((at >= low) & (at <= high) & (F.floor(at / tile) == F.col(t)))
        times = reduce(lambda a, b: a + b, [(F.least(F.greatest(at + i, low), high) == F.col(k)).cast("int") for i in range(-half, half + 1)])
        return near.withColumn("precip", F.col("precip") * times).drop("i", k)

    own = ["tx", "ty", "part", "time"]  # the shuffle's keys lead every grouping, so that none shuffles again
    lines = spread(seen, "col", "tx", "c").groupBy(*own, "c", "row", "low_row", "high_row").agg(F.sum("precip").alias("precip"))
    sums = spread(lines, "row", "ty", "r").groupBy(*own, F.col("c").alias("col"), F.col("r").alias("row"))
    means = sums.agg((F.sum("precip") / float(size * size)).alias("precip"))
    return means.join(cells.select("cid", *[c.alias(k) for k, c in place.items()]), ["col", "row"]).select("cid", "time", "precip")


def hours_around(samples: DataFrame, precip: DataFrame, before_days: int, after_days: int) -> DataFrame:
    """Hours from some days before each sample's ``ref`` to some days after it, in its cell.

    Samples and hours meet by cell and by day, so a long series isn't compared as a whole.
    """
    start, end = F.expr(f"ref - INTERVAL {before_days} DAYS"), F.expr(f"ref + INTERVAL {after_days} DAYS")
    days = F.explode(F.sequence(F.to_date(start), F.to_date(end), F.expr("INTERVAL 1 DAY")))
    asked = samples.withColumns({"from": start, "to": end}).withColumn("day", days)
    met = asked.join(precip.select("cid", "time", "precip", F.to_date("time").alias("day")), ["cid", "day"])
    return met.filter(F.col("time").between(F.col("from"), F.col("to"))).drop("day", "from", "to")


#: Default features of each static class.
FEATURES = {"customer": ["c_acctbal", "seg_building"], "part": ["p_size", "p_retailprice"], "runoff_coeff": []}


def chosen_features(wanted: list[str]) -> dict[str, list[str]]:
    """Feature lists of classes: ``class`` takes its default list, ``class:feature`` items replace it."""
    out: dict[str, list[str]] = {}
    for item in wanted:
        name, _, feature = item.partition(":")
        if name not in FEATURES or item.count(":") > 1 or item.endswith(":"):
            raise ValueError(f"unknown class or bad format: {item}")
        if feature:
            out[name] = [*(out.get(name, []) if any(w.startswith(f"{name}:") for w in wanted[: wanted.index(item)]) else []), feature]
        else:
            out.setdefault(name, FEATURES[name])
    return out


def feature_table(events: DataFrame, static: dict[str, DataFrame], wanted: list[str]) -> DataFrame:
    """Events with the chosen columns of each static class, which Catalyst broadcasts if they are small enough."""
    classes = chosen_features(wanted)
    return reduce(lambda rows, c: rows.join(static[c].select("cid", *classes[c]), "cid", "left"), classes, events)


def block_mean(rows: DataFrame, k: int, step: float = 1000.0) -> DataFrame:
    """Mean of k x k blocks of cells per time; blocks that the grid's far edges cut are left out."""
    column, line = F.floor(F.col("x") / step), F.floor(F.col("y") / step)
    size = rows.agg((F.max(column) + 1).alias("nx"), (F.max(line) + 1).alias("ny"))  # one row
    whole = rows.withColumns({"column": column, "line": line}).join(F.broadcast(size))
    whole = whole.filter((F.col("column") < F.floor(F.col("nx") / k) * k) & (F.col("line") < F.floor(F.col("ny") / k) * k))
    return whole.groupBy(F.floor(F.col("column") / k).alias("bx"), F.floor(F.col("line") / k).alias("by"), "time").agg(F.avg("precip").alias("precip"))


def fill_gaps(observed: DataFrame) -> DataFrame:
    """A full hourly calendar per cell and month; missing hours between two known ones lie on the line between them, others are 0."""
    month = F.trunc("time", "month")
    rows = observed.withColumn("month", month)
    first = F.expr("CAST(month AS TIMESTAMP_NTZ)")
    last = F.expr("CAST(last_day(month) AS TIMESTAMP_NTZ) + INTERVAL 23 HOURS")
    calendar = rows.select("cid", "month").distinct().select("cid", "month", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))).alias("time"))
    full = calendar.join(rows.select("cid", "time", "precip"), ["cid", "time"], "left")
    known = F.when(F.col("precip").isNotNull(), F.struct("time", "precip"))
    ahead = Window.partitionBy("cid", "month").orderBy("time")
    back = Window.partitionBy("cid", "month").orderBy(F.desc("time"))
    full = full.withColumn("a", F.last(known, ignorenulls=True).over(ahead)).withColumn("b", F.last(known, ignorenulls=True).over(back))
    share = (seconds(F.col("time")) - seconds(F.col("a.time"))) / (seconds(F.col("b.time")) - seconds(F.col("a.time")))
    line = F.col("a.precip") + (F.col("b.precip") - F.col("a.precip")) * share
    return full.select("cid", "time", F.coalesce("precip", line, F.lit(0.0)).alias("precip"))


def first_per_time(rows: DataFrame, *order: Column) -> DataFrame:
    """One row per cell and time: the first in the given order."""
    nth = F.row_number().over(Window.partitionBy("cid", "time").orderBy(*order))
    return rows.withColumn("nth", nth).filter("nth = 1").drop("nth")


def zonal_stats(pixels: DataFrame) -> DataFrame:
    """Statistics of the valid pixels in each cell; cells without one are left out."""
    valid = pixels.filter("value IS NOT NULL AND value <> -9999")
    return valid.groupBy("cid").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.median("value").alias("median"))


def zonal_fractions(pixels: DataFrame, classes: list[int]) -> DataFrame:
    """Share of each class among all pixels of a cell; pixels without a class count as another one."""
    share = lambda k: F.avg(F.when(F.col("class") == k, 1.0).otherwise(0.0)).alias(f"cat_{k}")
    return pixels.groupBy("cid").agg(*[share(k) for k in classes])
