"""Links of claims to events, step by step and as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import RUNS
from ..operators import linking
from .base import query


@query("link_windows", "SELECT date_claim, cid, date_claim - INTERVAL 2 DAY AS start_5, date_claim + INTERVAL 3 DAY AS end_5, date_claim - INTERVAL 2 DAY AS start_4, date_claim + INTERVAL 2 DAY AS end_4 FROM claims")
def link_windows(d) -> DataFrame:
    """First moment and end (the next midnight) of an odd and an even window."""
    day = F.col("date_claim")
    return d.claims.select("date_claim", "cid", *[f(day, w).alias(f"{n}_{w}") for w in (5, 4) for f, n in ((linking.window_start, "start"), (linking.window_end, "end"))])


@query("link_min_window", "SELECT date_claim, cid, eid, min_window FROM candidates")
def link_min_window(d) -> DataFrame:
    return d.candidates.select("date_claim", "cid", "eid", "min_window")


@query("link_overlap", """
SELECT date_claim, cid, eid, o5 AS overlap_5, o3 AS overlap_3, o1 AS overlap_1, round(o5 / 120.0, 6) AS r_ts_win_5, round(o5 / duration, 6) AS r_ts_evt_5 FROM windowed""")
def link_overlap(d) -> DataFrame:
    hours = {f"overlap_{w}": linking.overlap_hours(w) for w in linking.WINDOWS}
    rows = d.candidates.withColumns(hours)
    return rows.select("date_claim", "cid", "eid", *hours, F.round(F.col("overlap_5") / 120.0, 6).alias("r_ts_win_5"), F.round(F.col("overlap_5") / F.col("duration"), 6).alias("r_ts_evt_5"))


@query("link_prior", "SELECT date_claim, cid, eid, prior FROM windowed")
def link_prior(d) -> DataFrame:
    return d.candidates.select("date_claim", "cid", "eid", linking.is_prior().alias("prior"))


@query("link_votes", "SELECT date_claim, cid, eid, score, sub_1, sub_3, sub_5 FROM scored")
def link_votes(d) -> DataFrame:
    return linking.scored_candidates(d.candidates).select("date_claim", "cid", "eid", "score", "sub_1", "sub_3", "sub_5")


@query("link_best", "SELECT date_claim, cid, eid, score, CAST(rn AS INTEGER) AS rn FROM ranked")
def link_best(d) -> DataFrame:
    return d.ranked.select("date_claim", "cid", "eid", "score", "rn")


@query("link_result", "SELECT date_claim, cid, selection, eid, e_search_window, e_match_score FROM linked")
def link_result(d) -> DataFrame:
    return d.linked


@query("link_losers", "SELECT eid FROM losers")
def link_losers(d) -> DataFrame:
    return linking.losers(d.ranked)


@query("link_stats", """
, per AS (SELECT c.date_claim, c.cid, count(r.eid) AS n, count(*) FILTER (r.score = b.score) AS n_best, count(*) FILTER (r.score = b.score AND r.sub_1 = b.sub_1 AND r.sub_3 = b.sub_3 AND r.sub_5 = b.sub_5) AS n_same
  FROM claims c LEFT JOIN ranked r ON r.date_claim = c.date_claim AND r.cid = c.cid LEFT JOIN ranked b ON b.date_claim = c.date_claim AND b.cid = c.cid AND b.rn = 1 GROUP BY ALL)
SELECT count(*) FILTER (n = 0) AS none, count(*) FILTER (n = 1) AS single, count(*) FILTER (n = 2) AS two, count(*) FILTER (n = 3) AS three, count(*) FILTER (n > 3) AS multiple,
  count(*) FILTER (n_best > 1) AS conflicts, count(*) FILTER (n_same > 1) AS unresolved FROM per""")
def link_stats(d) -> DataFrame:
    return linking.link_stats(d.claims, d.ranked)


@query("link_sweep", RUNS + " SELECT run, count(*) AS n, CAST(sum(eid) AS BIGINT) AS eids FROM runs GROUP BY run")
def link_sweep(d) -> DataFrame:
    """Number of links and sum of event ids of each run."""
    return d.runs.groupBy("run").agg(F.count("*").alias("n"), F.sum("eid").alias("eids"))


@query("link_sweep_runs", RUNS + " SELECT run, date_claim, cid, eid FROM runs")
def link_sweep_runs(d) -> DataFrame:
    return d.runs


@query("events_with_target", "SELECT eid, cid, e_start, target, nb_claims, date_claim, nb_contracts FROM targets")
def events_with_target(d) -> DataFrame:
    return d.targets.select("eid", "cid", "e_start", "target", "nb_claims", "date_claim", "nb_contracts")
