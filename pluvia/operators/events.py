"""Rain events: sessions of wet hours per cell, their characteristics, antecedent precipitation and ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import hours_between, percentile_rank, seconds
from ..sources.files import stored

WET = 0.1
GAP_HOURS = 8
LEAST_SUM = 10.0
API_HOURS = 720
API_DECAY = 0.8
CELL_BLOCK = 10_000
RANKED = ["duration", "p_sum", "i_max", "i_mean", "i_sd", "api"]


def sessionise(precip: DataFrame, wet: float = WET, gap_hours: int = GAP_HOURS) -> DataFrame:
    """Hours that belong to an event, with its number ``gid`` in the cell and its ``e_start`` and ``e_end``.

    A wet hour more than ``gap_hours`` after the last wet one begins an event; dry hours between two wet hours of
    one event belong to it. One exchange and one sort by cell and time serve all windows.
    """
    by_time = Window.partitionBy("cid").orderBy("time")
    is_wet = F.col("precip") >= wet
    wet_time = F.when(is_wet, F.col("time"))
    before = F.last(wet_time, ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    rows = precip.withColumn("before", before)
    begins = is_wet & (F.col("before").isNull() | (seconds(F.col("time")) - seconds(F.col("before")) > gap_hours * 3600))
    rows = rows.withColumn("gid", F.sum(begins.cast("long")).over(by_time)).filter("gid > 0")
    of_event = Window.partitionBy("cid", "gid")
    rows = rows.withColumns({"e_start": F.min(wet_time).over(of_event), "e_end": F.max(wet_time).over(of_event)})
    return rows.filter("time <= e_end").drop("before")


def sparse_sessions(rain: DataFrame, wet: float = WET, gap_hours: int = GAP_HOURS) -> DataFrame:
    """What ``sessionise`` gives of a full hourly series, less its hours without precipitation, from a table that may lack those.

    ``rain`` has at most one row for each cell and full hour; an hour without a row is dry. Rows are as many as rainy hours, whatever the period.
    """
    return sessionise(rain.filter("precip <> 0"), wet, gap_hours)


def with_dry_hours(hours: DataFrame) -> DataFrame:
    """Rows of ``sparse_sessions`` with the dry hours of each event: each row brings those up to the event's next one."""
    after = F.lead("time").over(Window.partitionBy("cid").orderBy("time"))
    last = F.when(F.col("time") < F.col("e_end"), after - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("time"))
    rows = hours.withColumn("last", last).withColumn("hour", F.explode(F.sequence("time", "last", F.expr("INTERVAL 1 HOUR"))))
    return rows.withColumn("precip", F.when(F.col("hour") == F.col("time"), F.col("precip")).otherwise(0.0)).withColumn("time", F.col("hour")).drop("hour", "last")


def sparse_event_sums(hours: DataFrame, least_sum: float = LEAST_SUM) -> DataFrame:
    """``event_sums`` of rows from ``sparse_sessions``: an event's other hours count as 0 in duration, mean and deviation."""
    out = hours.groupBy("cid", "gid", "e_start", "e_end").agg(
        F.count("*").alias("rows"),
        F.sum("precip").alias("p_sum"),
        F.max("precip").alias("i_max"),
        F.var_pop("precip").alias("var"),
        F.min_by("time", F.struct(-F.col("precip"), F.col("time"))).alias("i_max_date"),
    )
    n, rows = F.col("duration"), F.col("rows")
    # moments of the rainy hours and of n - rows zeros, merged
    spread = F.col("var") * rows + F.pow(F.col("p_sum") / rows, F.lit(2.0)) * rows * (n - rows) / n
    out = out.filter(F.round("p_sum", 6) >= least_sum).withColumn("duration", (hours_between(F.col("e_end"), F.col("e_start")) + 1).cast("int"))
    out = out.withColumns({"i_mean": F.col("p_sum") / n, "i_sd": F.when(n > 1, F.sqrt(spread / (n - 1)))})
    return out.select("cid", "gid", "e_start", "e_end", "duration", "p_sum", "i_max", "i_mean", "i_sd", "i_max_date")


def event_sums(hours: DataFrame, least_sum: float = LEAST_SUM) -> DataFrame:
    """One row per event of ``least_sum`` mm at least; ``duration`` counts dry hours too, ``i_max_date`` is the first maximum."""
    out = hours.groupBy("cid", "gid", "e_start", "e_end").agg(
        F.count("*").cast("int").alias("duration"),
        F.sum("precip").alias("p_sum"),
        F.max("precip").alias("i_max"),
        F.avg("precip").alias("i_mean"),
        F.stddev_samp("precip").alias("i_sd"),
        F.min_by("time", F.struct(-F.col("precip"), F.col("time"))).alias("i_max_date"),
    )
    return out.filter(F.round("p_sum", 6) >= least_sum)


def antecedent_index(starts: DataFrame, precip: DataFrame, hours: int = API_HOURS, decay: float = API_DECAY) -> DataFrame:
    """(cid, e_start, api): decayed precipitation of the hours before each start; missing history counts as 0.

    Time is cut into blocks of the history's length, so that a start's history is its own block up to it and the rest of the block
    before. Running sums of a cell's rainy hours, decayed to the block's begin or end, give both: the sum in its own block, the whole block before
    decayed to the start, less that block's part up to ``hours`` before the start. Rainy hours and two marks for each start pass
    through one sort by cell and time; no start meets the hours of its history one by one.
    """
    per_hour = decay ** (1 / 24)
    hour = lambda c: F.floor(seconds(F.col(c)) / 3600)
    asked = starts.select("cid", "e_start").distinct()
    none = F.lit(None).cast("timestamp_ntz")
    rain = precip.filter("precip > 0").select("cid", hour("time").alias("h"), F.col("precip").alias("p"), none.alias("e_start"), F.lit(0).alias("back"))
    marks = asked.select("cid", F.explode(F.array(F.lit(0), F.lit(1))).alias("back"), hour("e_start").alias("begin"), "e_start")
    marks = marks.select("cid", (F.col("begin") - hours * F.col("back")).alias("h"), F.lit(0.0).alias("p"), "e_start", "back")
    rows = rain.unionByName(marks).withColumn("block", F.floor(F.col("h") / hours)).withColumn("o", F.col("h") - F.col("block") * hours)
    power = lambda n: F.pow(F.lit(per_hour), n)
    inner = F.sum(F.col("p") * power(-F.col("o"))).over(Window.partitionBy("cid", "block").orderBy("h").rangeBetween(Window.unboundedPreceding, -1))
    before = F.sum(F.col("p") * power(hours - 1 - F.col("o"))).over(Window.partitionBy("cid").orderBy("block").rangeBetween(-1, -1))
    rows = rows.withColumns({"inner": F.coalesce(inner, F.lit(0.0)) * power(F.col("o") - 1), "before": F.coalesce(before, F.lit(0.0)) * power(F.col("o"))})
    part = F.when(F.col("back") == 0, F.col("inner") + F.col("before")).otherwise(-F.col("inner") * per_hour**hours)
    return rows.filter("e_start IS NOT NULL").groupBy("cid", "e_start").agg(F.greatest(F.lit(0.0), F.sum(part)).alias("api"))


def with_ranks(events: DataFrame) -> DataFrame:
    """``<name>_q``: percentile rank of each characteristic within the cell."""
    return events.withColumns({f"{c}_q": F.round(percentile_rank(c, "cid"), 5) for c in RANKED})


def extract_events(precip: DataFrame, sparse: bool = False) -> DataFrame:
    """All events of all cells, with antecedent precipitation and ranks, rounded to 5 decimals.

    ``sparse``: hours without a row are dry, so a table of rainy hours is enough; otherwise only hours that have a row count.
    """
    sums = sparse_event_sums(sparse_sessions(precip)) if sparse else event_sums(sessionise(precip))
    full = sums.join(antecedent_index(sums, precip), ["cid", "e_start"], "left").withColumn("api", F.coalesce("api", F.lit(0.0)))
    # the nudge makes decimal ties round up, in whatever order a sum was added
    full = full.withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in ("p_sum", "i_max", "i_mean", "i_sd", "api")})
    return with_ranks(full).drop("gid")


def with_event_ids(events: DataFrame) -> DataFrame:
    """``eid`` from 1 on, by cell and start: the place in the cell after the events of all cells before it.

    Cells' counts are summed per block of cells, and only the blocks' sums in one place.
    """
    counts = events.groupBy("cid").agg(F.count("*").alias("own")).withColumn("block", F.floor(F.col("cid") / CELL_BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("own").alias("all"))
    start = blocks.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("start"))  # one row per block of cells
    inner = (F.sum("own").over(Window.partitionBy("block").orderBy("cid")) - F.col("own")).alias("inner")
    before = counts.select("cid", "block", inner).join(start, "block").select("cid", (F.col("start") + F.col("inner")).alias("before"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy("e_start"))
    return events.withColumn("place", place).join(before, "cid").withColumn("eid", (F.col("before") + F.col("place")).cast("long")).drop("place", "before")


EVENT_COLUMNS = ["eid", "cid", "x", "y", "e_start", "e_end", "duration", "p_sum", "i_max", "i_mean", "i_sd", "api", "i_max_date", *[f"{c}_q" for c in RANKED]]


def overlapping_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_eid, right_eid) of events of one cell whose spans overlap, where no two events of one set overlap.

    A sweep over each cell's starts: an event overlaps the other set's last event begun before it, or none begun before it. So every pair
    is found at its later start, in one pass over the sorted events of both sets.
    """
    keys = ["eid", "cid", "e_start", "e_end"]
    both = left.select(*keys, F.lit(0).alias("side")).unionByName(right.select(*keys, F.lit(1).alias("side")))
    so_far = Window.partitionBy("cid").orderBy("e_start", "side", "eid").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda side: F.last(F.when(F.col("side") == side, F.struct("eid", "e_start", "e_end")), ignorenulls=True).over(so_far)
    met = both.withColumn("other", F.when(F.col("side") == 1, last(0)).otherwise(last(1))).filter("other.e_end > e_start AND other.e_start < e_end")
    pick = lambda side: F.when(F.col("side") == side, F.col("eid")).otherwise(F.col("other.eid"))
    return met.select(pick(0).alias("left_eid"), pick(1).alias("right_eid"))


def compare_event_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of events of two sets, with the step that matched them: the same span, start, end, or overlapping spans.

    Each step works on the events that no step before has matched; a row is (step, left eid, right eid). Both sets should be
    written tables; each step's matches are written, since later steps read them twice.
    """
    steps = [
        ("same", ["cid", "e_start", "e_end"]),
        ("start", ["cid", "e_start"]),
        ("end", ["cid", "e_end"]),
        ("overlap", None),
    ]
    keys = ["eid", "cid", "e_start", "e_end"]
    a, b, found = left.select(*keys), right.select(*keys), []
    for name, equal in steps:
        if equal is None:
            met = overlapping_pairs(a, b)
        else:
            on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in equal]
            met = a.alias("l").join(b.alias("r"), reduce(lambda p, q: p & q, on)).select(F.col("l.eid").alias("left_eid"), F.col("r.eid").alias("right_eid"))
        met = stored(met.select(F.lit(name).alias("step"), "left_eid", "right_eid"), "matches")
        found.append(met)
        a = a.join(met.select(F.col("left_eid").alias("eid")), "eid", "left_anti")
        b = b.join(met.select(F.col("right_eid").alias("eid")), "eid", "left_anti")
    return reduce(DataFrame.unionByName, found)
