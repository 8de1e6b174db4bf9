"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import SELECTED
from ..functions.expressions import midpoint, moment, seconds
from ..operators import claims
from .base import query

#: Periods without usable data, for the driver's month (start, end); callers widen them by days before and after.
MISSING = [("2024-01-06", "2024-01-06"), ("2024-01-19", "2024-01-20")]


def missing_periods(d, before: int = 0, after: int = 0) -> DataFrame:
    rows = d.spark.createDataFrame(MISSING, "start string, end string")
    return rows.select(F.date_sub(F.col("start").cast("date"), before).cast("timestamp_ntz").alias("start"), F.date_add(F.col("end").cast("date"), after).cast("timestamp_ntz").alias("end"))


@query("filter_period", """
SELECT date_claim, cid, A, B, C, D, E FROM (SELECT *, try_cast(CASE WHEN cid % 7 = 0 THEN 'unknown' ELSE CAST(date_claim AS VARCHAR) END AS DATE) AS day FROM claims_wide) WHERE year(day) BETWEEN 2013 AND 2024""")
def filter_period(d) -> DataFrame:
    """Claims of the given years; claims whose date can't be read are dropped."""
    text = F.when(F.col("cid") % 7 == 0, "unknown").otherwise(F.col("date_claim").cast("string"))
    return d.claims_wide.filter(F.year(F.try_to_date(text)).between(2013, 2024))


@query("events_in_years", "SELECT eid, cid, e_start FROM rain_events WHERE year(e_start) BETWEEN 2013 AND 2024")
def events_in_years(d) -> DataFrame:
    return d.rain_events.filter(F.year("e_start").between(2013, 2024)).select("eid", "cid", "e_start")


@query("remove_periods", """
SELECT eid, cid, e_start, e_end FROM rain_events
WHERE NOT (e_end BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-08' OR e_end BETWEEN TIMESTAMP '2024-01-17' AND TIMESTAMP '2024-01-22')""")
def remove_periods(d) -> DataFrame:
    """Events without those that end in a missing period, widened by two days."""
    gone = F.broadcast(missing_periods(d, 2, 2))
    return d.rain_events.select("eid", "cid", "e_start", "e_end").join(gone, F.col("e_end").between(F.col("start"), F.col("end")), "left_anti")


@query("remove_events", "SELECT eid, cid FROM rain_events WHERE eid NOT IN (SELECT eid FROM losers)")
def remove_events(d) -> DataFrame:
    from ..operators.linking import losers

    return d.rain_events.select("eid", "cid").join(losers(d.ranked), "eid", "left_anti")


WITH_CONTRACTS = ", full_events AS (SELECT e.eid, e.cid, x.selection AS nb_contracts FROM rain_events e LEFT JOIN exposure x ON x.cid = e.cid AND x.year = year(e.e_start))"


def with_contracts(d) -> DataFrame:
    from ..operators.linking import set_contracts

    return set_contracts(d.rain_events, d.exposure).select("eid", "cid", "nb_contracts")


@query("drop_without_contracts", WITH_CONTRACTS + " SELECT * FROM full_events WHERE nb_contracts IS NOT NULL")
def drop_without_contracts(d) -> DataFrame:
    return with_contracts(d).dropna(subset=["nb_contracts"])


@query("min_contracts", WITH_CONTRACTS + " SELECT * FROM full_events WHERE nb_contracts >= 3")
def min_contracts(d) -> DataFrame:
    return with_contracts(d).filter("nb_contracts >= 3")


@query("min_claims", "SELECT eid, cid, nb_claims FROM targets WHERE nb_claims = 0 OR nb_claims >= 2")
def min_claims(d) -> DataFrame:
    return d.targets.filter("nb_claims = 0 OR nb_claims >= 2").select("eid", "cid", "nb_claims")


@query("crop_domain", """
, box AS (SELECT min(x) - 1000 AS x0, max(x) + 1000 AS x1, min(y) - 1000 AS y0, max(y) + 1000 AS y1 FROM targets WHERE target = 1)
SELECT cid, cells.x, cells.y FROM cells, box WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def crop_domain(d) -> DataFrame:
    """Cells inside the bounding box of the events with claims, padded by 1 km."""
    hit = d.targets.filter("target = 1")
    box = hit.agg((F.min("x") - 1000).alias("x0"), (F.max("x") + 1000).alias("x1"), (F.min("y") - 1000).alias("y0"), (F.max("y") + 1000).alias("y1"))  # one row
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return d.cells.join(F.broadcast(box), inside).select("cid", "x", "y")


MIDDLE = "to_timestamp((epoch(e_start) + epoch(e_end)) // 2) AT TIME ZONE 'UTC'"


@query("drop_period_edges", f"""
, span AS (SELECT CAST(min(time) AS DATE) + 3 AS first, CAST(max(time) AS DATE) - 1 AS last FROM precip)
SELECT eid, date FROM (SELECT eid, coalesce(date_claim, CAST({MIDDLE} AS DATE)) AS date FROM targets), span WHERE date > first AND date < last""")
def drop_period_edges(d) -> DataFrame:
    """Events whose day has enough series before and after it."""
    span = d.span.select(F.date_add("first", 3).alias("first"), F.date_sub("last", 1).alias("last"))  # one row
    day = F.coalesce("date_claim", F.to_date(midpoint(F.col("e_start"), F.col("e_end"))))
    rows = d.targets.select("eid", day.alias("date")).join(F.broadcast(span))
    return rows.filter("date > first AND date < last").select("eid", "date")


@query("claims_of_type", """
SELECT 'pluvial' AS word, category, CAST(sum(n) AS BIGINT) AS n FROM claims_long WHERE category IN ('A', 'B') GROUP BY category
UNION ALL SELECT 'fluvial', category, CAST(sum(n) AS BIGINT) FROM claims_long WHERE category = 'D' GROUP BY category
UNION ALL SELECT 'sme internal pluvial', c, 1 FROM (SELECT unnest(['sme_int_cont', 'sme_int_struc']) AS c)
UNION ALL SELECT 'private structure pluvial', c, 1 FROM (SELECT unnest(['priv_ext_struc_pluv', 'priv_int_struc']) AS c)""")
def claims_of_type(d) -> DataFrame:
    """Claims of type words in the second dataset, and the first dataset's categories of two lists of words."""
    dim = d.spark.createDataFrame(claims.CATEGORY_ROWS, claims.CATEGORY_COLUMNS)
    parts = [claims.claims_of_type(d.claims_long, w).groupBy("category").agg(F.sum("n").alias("n")).select(F.lit(w).alias("word"), "category", "n") for w in ("pluvial", "fluvial")]
    parts += [claims.categories_of_types(dim, w.split()).select(F.lit(w).alias("word"), "category", F.lit(1).cast("long").alias("n")) for w in ("sme internal pluvial", "private structure pluvial")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("select_claims", "SELECT date_claim, cid, selection, TRUE AS kept FROM claims UNION ALL SELECT date_claim, cid, selection, FALSE FROM removed_claims")
def select_claims(d) -> DataFrame:
    kept, removed = claims.select_claims(d.claims_wide, SELECTED)
    part = lambda rows, flag: rows.select("date_claim", "cid", "selection", F.lit(flag).alias("kept"))
    return part(kept, True).unionByName(part(removed, False))


@query("target_occurrence", "SELECT date_claim, cid, CASE WHEN A + B > 0 THEN 1 ELSE 0 END AS target FROM claims_wide")
def target_occurrence(d) -> DataFrame:
    return d.claims_wide.select("date_claim", "cid", F.when(claims.row_sum(SELECTED) > 0, 1).otherwise(0).alias("target"))


@query("target_damage_ratio", """
SELECT date_claim, c.cid, round(CASE WHEN c.selection / x.selection > 1 THEN 1.0 ELSE c.selection / x.selection END, 6) AS target
FROM claims c LEFT JOIN exposure x ON x.cid = c.cid AND x.year = year(date_claim)""")
def target_damage_ratio(d) -> DataFrame:
    return claims.damage_ratio(d.claims, d.exposure).select("date_claim", "cid", F.round("target", 6).alias("target"))


def reference_date(events: DataFrame, mode: str = "i_max") -> DataFrame:
    """With ``ref_date``: 18:00 of the claim's day, else the time of the maximum, the middle or the end; ``i_max_only`` ignores claims."""
    claim = F.expr("CAST(date_claim AS TIMESTAMP_NTZ) + INTERVAL 18 HOURS")
    other = {"i_max": F.col("i_max_date"), "i_max_only": F.col("i_max_date"), "middle": midpoint(F.col("e_start"), F.col("e_end")), "end": F.col("e_end")}[mode]
    return events.withColumn("ref_date", other if mode == "i_max_only" else F.coalesce(claim, other))


@query("reference_date", f"""
SELECT eid, date_claim, coalesce(date_claim + INTERVAL 18 HOUR, i_max_date) AS i_max, coalesce(date_claim + INTERVAL 18 HOUR, {MIDDLE}) AS middle,
  coalesce(date_claim + INTERVAL 18 HOUR, e_end) AS "end", i_max_date AS i_max_only FROM targets""")
def reference_dates(d) -> DataFrame:
    rows = d.targets
    for mode in ("i_max", "middle", "end", "i_max_only"):
        rows = reference_date(rows, mode).withColumnRenamed("ref_date", f"ref_{mode}")
    return rows.select("eid", "date_claim", *[F.col(f"ref_{m}").alias(m) for m in ("i_max", "middle", "end", "i_max_only")])


@query("drop_null_features", "SELECT eid, i_max, i_sd FROM targets WHERE i_max IS NOT NULL AND i_sd IS NOT NULL")
def drop_null_features(d) -> DataFrame:
    return d.targets.select("eid", "i_max", "i_sd").dropna(subset=["i_max", "i_sd"])


@query("cell_lookup", "SELECT date_claim, cid, x, y FROM claims JOIN cells USING (cid)")
def cell_lookup(d) -> DataFrame:
    return d.claims.select("date_claim", "cid").join(d.cells, "cid")


@query("round_to_step", f"""
SELECT eid, to_timestamp(CAST(round_even(epoch({MIDDLE}) / 21600.0, 0) * 21600 AS BIGINT)) AT TIME ZONE 'UTC' AS step_time FROM rain_events""")
def round_to_step(d) -> DataFrame:
    """The middle of each event rounded to 6 hours, halves to the even step."""
    middle = seconds(midpoint(F.col("e_start"), F.col("e_end")))
    step = F.bround(middle / 21600.0, 0).cast("long") * 21600
    return d.rain_events.select("eid", moment(step).alias("step_time"))


@query("log1p_precip", "SELECT cid, time, round(ln(1 + precip), 6) AS precip FROM precip WHERE precip > 0")
def log1p_precip(d) -> DataFrame:
    return d.precip.filter("precip > 0").select("cid", "time", F.round(F.log1p("precip"), 6).alias("precip"))


PIXEL_LAYERS = ", layers AS (SELECT px, py, round(avg(area), 4) AS area, round(avg(slope), 4) AS slope, max(value) AS value FROM pixels GROUP BY px, py)"


def pixel_layers(d) -> DataFrame:
    """Flow area, slope and a value per pixel."""
    return d.pixels.groupBy("px", "py").agg(F.round(F.avg("area"), 4).alias("area"), F.round(F.avg("slope"), 4).alias("slope"), F.max("value").alias("value"))


def wetness_index(area, slope):
    """ln(area / tan(atan(slope))) between 0 and 30; a flat pixel has 30; no area on a flat pixel is NaN."""
    index = F.ln(area / F.tan(F.atan(slope)))
    flat = F.when(area > 0, F.lit(30.0)).otherwise(F.lit(float("nan")))
    inside = F.when(area <= 0, 0.0).when(index < 0, 0.0).when(index > 30, 30.0).otherwise(index)
    return F.when(slope == 0, flat).otherwise(inside)


@query("twi", PIXEL_LAYERS + """
SELECT px, py, round(CASE WHEN slope = 0 THEN 30.0 ELSE least(30.0, greatest(0.0, ln(area / tan(atan(slope))))) END, 6) AS twi FROM layers""")
def twi(d) -> DataFrame:
    return pixel_layers(d).select("px", "py", F.round(wetness_index(F.col("area"), F.col("slope")), 6).alias("twi"))


@query("mask_rivers", PIXEL_LAYERS + " SELECT px, py, CASE WHEN value < 50000 THEN value END AS value FROM layers")
def mask_rivers(d) -> DataFrame:
    return pixel_layers(d).select("px", "py", F.when(F.col("value") < 50000, F.col("value")).alias("value"))
