"""Links from claims to the rain events that most likely caused them.

An interval join finds the events of a claim's cell that overlap its widest search window; for every window and
criterion the best candidates get a vote; the most votes win, ties going to the votes in the narrowest windows
and then to the first event. All votes are window functions over one partitioning by claim.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import day_start, hours_between, seconds

WINDOWS = (5, 3, 1)
CRITERIA = ("prior", "i_mean", "i_max", "p_sum", "r_ts_win", "r_ts_evt")
SUB_CRITERIA = ("i_mean", "i_max", "p_sum")
CLAIM = ("date_claim", "cid")

#: Named sets of criteria and windows, for the sensitivity of links to them.
SWEEP = {
    "v1": (("i_max",), (5, 3, 1)),
    "v2": (("p_sum",), (5, 3, 1)),
    "v3": (("i_max", "p_sum"), (5, 3, 1)),
    "v4": (("i_max", "p_sum", "i_mean"), (5, 3, 1)),
    "v5": (("i_max", "p_sum", "r_ts_evt"), (5, 3, 1)),
    "v6": (("i_max", "p_sum", "r_ts_win", "r_ts_evt"), (5, 3, 1)),
    "v7": (("i_mean", "i_max", "p_sum", "r_ts_win", "r_ts_evt"), (5, 3, 1)),
    "v8": (("prior", "i_max", "p_sum", "r_ts_win", "r_ts_evt"), (5, 3, 1)),
    "v9": (("prior", "i_mean", "i_max", "p_sum", "r_ts_win", "r_ts_evt"), (5, 3, 1)),
}


def window_start(date: Column, window: int) -> Column:
    """Odd windows are centred on the day, even ones on the day and the one before."""
    return day_start(date, -((window - 1) // 2) if window % 2 else -(window // 2))


def window_end(date: Column, window: int) -> Column:
    """The midnight that ends the window's last day."""
    return day_start(date, (window - 1) // 2 + 1)


def overlaps(window: int) -> Column:
    return (F.col("e_start") < window_end(F.col("date_claim"), window)) & (F.col("e_end") > window_start(F.col("date_claim"), window))


def candidates(claims: DataFrame, events: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Events of the claim's cell that overlap its widest window, with the narrowest window they overlap."""
    side = events.select("cid", "eid", "e_start", "e_end", "duration", "i_mean", "i_max", "p_sum")
    return _with_min_window(claims.select(*CLAIM, "selection").join(side, "cid").filter(overlaps(max(windows))), windows)


def candidates_by_day(claims: DataFrame, events: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """The same rows by a join on cell and day, for cells with very many events.

    A claim stands on each day of its widest window and an event on each day it lasts; a pair counts on its first
    common day only, so that no pass over all pairs has to remove repeats.
    """
    widest, date = max(windows), F.col("date_claim")
    first = window_start(date, widest).cast("date")
    days = F.sequence(first, F.date_sub(window_end(date, widest).cast("date"), 1), F.expr("INTERVAL 1 DAY"))
    left = claims.select(*CLAIM, "selection", F.explode(days).alias("day"), first.alias("first_day"))
    start = F.to_date("e_start")
    side = events.select("cid", "eid", "e_start", "e_end", "duration", "i_mean", "i_max", "p_sum", F.explode(F.sequence(start, F.to_date("e_end"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    met = left.join(side, ["cid", "day"]).filter(F.col("day") == F.greatest("first_day", F.to_date("e_start"))).filter(overlaps(widest))
    return _with_min_window(met.drop("day", "first_day"), windows)


def _with_min_window(pairs: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    narrowest = reduce(lambda other, w: F.when(overlaps(w), w).otherwise(other), sorted(windows, reverse=True)[1:], F.lit(max(windows)))
    return pairs.withColumn("min_window", narrowest.cast("int"))


def overlap_hours(window: int) -> Column:
    """Hours that the event, begun an hour early, shares with the window, rounded half to even."""
    end = F.least(window_end(F.col("date_claim"), window), F.col("e_end"))
    start = F.greatest(window_start(F.col("date_claim"), window), F.expr("e_start - INTERVAL 1 HOUR"))
    return F.bround(F.greatest(F.lit(0.0), hours_between(end, start)), 0)


def is_prior() -> Column:
    return (F.col("e_start") < day_start(F.col("date_claim"), 1)).cast("int")


def with_votes(pairs: DataFrame, windows: tuple[int, ...], criteria: tuple[str, ...]) -> tuple[DataFrame, dict[tuple[int, str], str]]:
    """Candidates with a column of 0 or 1 for each window and criterion, and the columns' names.

    In each window only candidates that overlap it compete, and all that have the largest value get the vote.
    """
    rows = pairs
    for w in windows:
        rows = rows.withColumns({f"r_ts_win_{w}": overlap_hours(w) / (24.0 * w), f"r_ts_evt_{w}": overlap_hours(w) / F.col("duration")})
    claim = Window.partitionBy(*CLAIM)
    votes = {}
    for w in windows:
        for c in criteria:
            if c != "prior":
                value = F.when(F.col("min_window") <= w, F.col(f"{c}_{w}" if c.startswith("r_ts") else c))
                votes[w, c] = F.coalesce((value == F.max(value).over(claim)).cast("int"), F.lit(0))
    return rows.withColumns({"prior": is_prior(), **{f"vote_{c}_{w}": v for (w, c), v in votes.items()}}), {k: f"vote_{k[1]}_{k[0]}" for k in votes}


def sums_of_votes(votes: dict[tuple[int, str], str], windows: tuple[int, ...], criteria: tuple[str, ...]) -> dict[str, Column]:
    """``score`` (all votes) and ``sub_<window>`` (votes for intensity and amount) by a set of criteria."""
    add = lambda keys: reduce(lambda a, b: a + b, [F.col(votes[k]) for k in keys if k[1] in criteria], F.lit(0))
    score = add(votes) + (F.col("prior") if "prior" in criteria else F.lit(0))
    return {"score": score, **{f"sub_{w}": add([(w, c) for c in SUB_CRITERIA if (w, c) in votes]) for w in windows}}


def scored_candidates(pairs: DataFrame, windows: tuple[int, ...] = WINDOWS, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    rows, votes = with_votes(pairs, windows, criteria)
    return rows.withColumns(sums_of_votes(votes, windows, criteria)).drop(*votes.values())


def ranked_candidates(pairs: DataFrame, windows: tuple[int, ...] = WINDOWS, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """With ``rn`` (1: the best) and ``n_candidates`` of the claim."""
    order = [F.desc("score"), *[F.desc(f"sub_{w}") for w in sorted(windows)], F.asc("eid")]
    claim = Window.partitionBy(*CLAIM)
    return scored_candidates(pairs, windows, criteria).withColumns({"rn": F.row_number().over(claim.orderBy(*order)), "n_candidates": F.count("*").over(claim)})


def linked_claims(ranked: DataFrame) -> DataFrame:
    return ranked.filter("rn = 1").select(*CLAIM, "selection", "eid", F.col("min_window").alias("e_search_window"), F.col("score").alias("e_match_score"))


def losers(ranked: DataFrame, key: tuple[str, ...] = ("eid",)) -> DataFrame:
    """Events that were a candidate beside another one and that no claim chose. The key may hold the cell too, for tables stored by cell."""
    return ranked.filter("rn > 1").select(*key).distinct().join(ranked.filter("rn = 1").select(*key), list(key), "left_anti")


def link_stats(claims: DataFrame, ranked: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Numbers of claims by number of candidates; of ties for the top score; and of ties that only event order settled."""
    top = Window.partitionBy(*CLAIM)
    best = F.col("score") == F.max("score").over(top)
    first = F.max(F.struct("score", *[f"sub_{w}" for w in sorted(windows)])).over(top)
    same = F.struct("score", *[f"sub_{w}" for w in sorted(windows)]) == first
    per_claim = ranked.withColumns({"best": best, "same": same}).groupBy(*CLAIM).agg(
        F.count("*").alias("n"), F.count_if("best").alias("n_best"), F.count_if("same").alias("n_same")
    )
    full = claims.select(*CLAIM).join(per_claim, list(CLAIM), "left").fillna(0)
    count = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return full.agg(
        count("n = 0", "none"), count("n = 1", "single"), count("n = 2", "two"), count("n = 3", "three"),
        count("n > 3", "multiple"), count("n_best > 1", "conflicts"), count("n_same > 1", "unresolved"),
    )


def sweep(claims: DataFrame, events: DataFrame, sets: dict = SWEEP) -> DataFrame:
    """(run, date_claim, cid, eid) for each named set of criteria and windows.

    Sets with the same windows share one pass: votes are counted once, and every candidate then stands in each run with the
    run's own score, still partitioned by claim.
    """
    runs = []
    for windows in dict.fromkeys(w for _, w in sets.values()):
        own = {name: c for name, (c, w) in sets.items() if w == windows}
        rows, votes = with_votes(candidates(claims, events, windows), windows, tuple(dict.fromkeys(c for cs in own.values() for c in cs)))
        of_run = [F.struct(F.lit(name).alias("run"), *[v.cast("int").alias(k) for k, v in sums_of_votes(votes, windows, c).items()]) for name, c in own.items()]
        rows = rows.select(*CLAIM, "eid", F.inline(F.array(*of_run)))
        order = [F.desc("score"), *[F.desc(f"sub_{w}") for w in sorted(windows)], F.asc("eid")]
        nth = F.row_number().over(Window.partitionBy(*CLAIM, "run").orderBy(*order))
        runs.append(rows.withColumn("rn", nth).filter("rn = 1").select("run", *CLAIM, "eid"))
    return reduce(DataFrame.unionByName, runs)


def disagreements(runs: DataFrame) -> DataFrame:
    """Per pair of runs, the claims that one of them links to another event, or that only the larger run links."""
    sizes = runs.groupBy("run").agg(F.count("*").alias("n"))
    a, b = sizes.select(F.col("run").alias("run_a"), F.col("n").alias("n_a")), sizes.select(F.col("run").alias("run_b"), F.col("n").alias("n_b"))
    pairs = a.join(b, F.col("run_a") < F.col("run_b"))  # runs, not claims
    larger = F.when(F.col("n_a") >= F.col("n_b"), F.col("run_a")).otherwise(F.col("run_b"))
    smaller = F.when(F.col("n_a") >= F.col("n_b"), F.col("run_b")).otherwise(F.col("run_a"))
    pairs = pairs.withColumns({"larger": larger, "smaller": smaller})
    left = runs.withColumnRenamed("run", "larger").join(F.broadcast(pairs), "larger")
    right = runs.select(F.col("run").alias("smaller"), *CLAIM, F.col("eid").alias("other"))
    met = left.join(right, ["smaller", *CLAIM], "left")
    return met.groupBy("run_a", "run_b", "n_a", "n_b").agg(F.count_if(~F.col("eid").eqNullSafe(F.col("other"))).alias("n_diff"))


def set_targets(events: DataFrame, linked: DataFrame, key: tuple[str, ...] = ("eid",)) -> DataFrame:
    """Events with ``target`` and ``nb_claims``, 0 without a claim; an event with several claims has a row for each."""
    side = linked.select(*key, "selection", "date_claim")
    full = events.join(side, list(key), "left")
    return full.withColumns({"target": F.when(F.col("selection").isNull(), 0).otherwise(1), "nb_claims": F.coalesce("selection", F.lit(0))}).drop("selection")


def set_contracts(events: DataFrame, exposure: DataFrame) -> DataFrame:
    side = exposure.select("cid", "year", F.col("selection").alias("nb_contracts"))
    return events.withColumn("year", F.year("e_start")).join(side, ["cid", "year"], "left").drop("year")


def events_of_removed_claims(events: DataFrame, removed: DataFrame, linked: DataFrame, hours: int = 48) -> DataFrame:
    """Ids of events whose middle is within two days of a claim that the selection dropped, unless a kept claim has them.

    A sweep over each cell's middles and claims in order of time: the nearest claim is the last one before a middle or the first
    one after it, so no event meets all claims of its cell.
    """
    none = F.lit(None).cast("long")
    middles = events.select("cid", "eid", F.floor((seconds(F.col("e_start")) + seconds(F.col("e_end"))) / 2).alias("at"), none.alias("claim"))
    day = seconds(F.col("date_claim").cast("timestamp_ntz"))
    rows = middles.unionByName(removed.select("cid", none.alias("eid"), day.alias("at"), day.alias("claim")))
    by_time = Window.partitionBy("cid").orderBy("at")
    before = F.last("claim", ignorenulls=True).over(by_time.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("claim", ignorenulls=True).over(by_time.rangeBetween(0, Window.unboundedFollowing))
    distance = F.least(F.col("at") - before, after - F.col("at"))  # of those that there are
    near = rows.withColumn("distance", distance).filter(F.col("eid").isNotNull() & (F.col("distance") <= hours * 3600))
    return near.select("eid").join(linked.select("eid"), "eid", "left_anti")


def events_with_target(events: DataFrame, ranked: DataFrame, exposure: DataFrame, key: tuple[str, ...] = ("eid",)) -> DataFrame:
    """Events with target and contracts; without events that lost to another, and without those of cells with no contract."""
    full = set_contracts(set_targets(events, linked_claims(ranked), key), exposure)
    return full.join(losers(ranked, key), list(key), "left_anti").dropna(subset=["nb_contracts"])
