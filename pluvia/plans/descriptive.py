"""Descriptive analyses: seasonality, distributions, sensitivity of links, statistics by zone and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import RUNS, STATUSES
from ..operators import claims, events, grid, linking
from ..sources.files import stored
from .base import query
from .joins import DIFF, MATCHES


def share(value: Column) -> Column:
    return F.round(value / F.sum(value).over(Window.partitionBy()), 6)  # over one row per group


@query("exposed_cells", "SELECT DISTINCT cid FROM exposure_long WHERE n > 0")
def exposed_cells(d) -> DataFrame:
    return claims.exposed_cells(d.exposure_long)


@query("exposure_table", """
, years AS (SELECT DISTINCT year FROM exposure_long), exposed AS (SELECT DISTINCT cid FROM exposure_long WHERE n > 0)
SELECT e.cid, y.year, CAST(coalesce(sum(n) FILTER (category = 'F'), 0) AS BIGINT) AS F, CAST(coalesce(sum(n) FILTER (category = 'O'), 0) AS BIGINT) AS O, CAST(coalesce(sum(n) FILTER (category = 'P'), 0) AS BIGINT) AS P
FROM exposed e CROSS JOIN years y LEFT JOIN exposure_long x ON x.cid = e.cid AND x.year = y.year GROUP BY e.cid, y.year""")
def exposure_table(d) -> DataFrame:
    return claims.exposure_table(d.exposure_long, STATUSES)


@query("monthly_claims", """
, by_month AS (SELECT month(date_claim) AS month, CAST(sum(A) AS BIGINT) AS A, CAST(sum(B) AS BIGINT) AS B, CAST(sum(C) AS BIGINT) AS C FROM claims_wide GROUP BY 1)
SELECT CAST(month AS INTEGER) AS month, A, B, C, round(A / sum(A) OVER (), 6) AS share_a, round(B / sum(B) OVER (), 6) AS share_b, round(C / sum(C) OVER (), 6) AS share_c FROM by_month""")
def monthly_claims(d) -> DataFrame:
    sums = d.claims_wide.groupBy(F.month("date_claim").alias("month")).agg(*[F.sum(c).alias(c) for c in "ABC"])
    return sums.select("month", *"ABC", *[share(F.col(c)).alias(f"share_{c.lower()}") for c in "ABC"])


@query("mean_claims_per_event_day", """
SELECT CAST(month(date_claim) AS INTEGER) AS month, round(avg(n), 6) AS mean, count(*) AS n_days FROM (SELECT date_claim, sum(A) AS n FROM claims_wide GROUP BY 1 HAVING sum(A) > 0) GROUP BY 1""")
def mean_claims_per_event_day(d) -> DataFrame:
    days = d.claims_wide.groupBy("date_claim").agg(F.sum("A").alias("n")).filter("n > 0")
    return days.groupBy(F.month("date_claim").alias("month")).agg(F.round(F.avg("n"), 6).alias("mean"), F.count("*").alias("n_days"))


@query("claims_per_cell_hist", "SELECT selection, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM claims GROUP BY selection")
def claims_per_cell_hist(d) -> DataFrame:
    counts = d.claims.groupBy("selection").agg(F.count("*").alias("n"))
    return counts.select("selection", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


@query("selected_seasonality", "SELECT CAST(month(date_claim) AS INTEGER) AS month, round(sum(selection) / sum(sum(selection)) OVER (), 6) AS share FROM claims GROUP BY 1")
def selected_seasonality(d) -> DataFrame:
    sums = d.claims.groupBy(F.month("date_claim").alias("month")).agg(F.sum("selection").alias("n"))
    return sums.select("month", share(F.col("n")).alias("share"))


@query("structure_vs_content", """
SELECT CAST(sum(least(C, D)) AS BIGINT) AS both, CAST(sum(C - least(C, D)) AS BIGINT) AS only_structure, CAST(sum(D - least(C, D)) AS BIGINT) AS only_content,
  round(100.0 * sum(least(C, D)) / sum(C + D - least(C, D)), 6) AS percent_both FROM claims_wide""")
def structure_vs_content(d) -> DataFrame:
    """Claims of two categories in the same place and day, and of only one of them."""
    both = F.least("C", "D")
    return d.claims_wide.agg(
        F.sum(both).alias("both"), F.sum(F.col("C") - both).alias("only_structure"), F.sum(F.col("D") - both).alias("only_content"),
        F.round(100.0 * F.sum(both) / F.sum(F.col("C") + F.col("D") - both), 6).alias("percent_both"),
    )


@query("mean_contracts", "SELECT cid, round(avg(n), 6) AS mean FROM (SELECT cid, year, sum(n) AS n FROM exposure_long GROUP BY ALL) GROUP BY cid")
def mean_contracts(d) -> DataFrame:
    return d.exposure_long.groupBy("cid", "year").agg(F.sum("n").alias("n")).groupBy("cid").agg(F.round(F.avg("n"), 6).alias("mean"))


@query("annual_claims", "SELECT cid, round(sum(selection) / (SELECT count(DISTINCT year(date_claim)) FROM claims), 6) AS annual FROM claims GROUP BY cid")
def annual_claims(d) -> DataFrame:
    years = d.claims.agg(F.countDistinct(F.year("date_claim")).alias("years"))  # one row
    sums = d.claims.groupBy("cid").agg(F.sum("selection").alias("n"))
    return sums.join(F.broadcast(years)).select("cid", F.round(F.col("n") / F.col("years"), 6).alias("annual"))


ATTRIBUTES = ["duration", "p_sum", "i_max", "i_mean", "api"]


@query("describe_events", " UNION ALL ".join(f"""
SELECT '{a}' AS attribute, count({a}) AS n, round(avg({a}), 4) AS mean, round(stddev_samp({a}), 4) AS sd, CAST(min({a}) AS DOUBLE) AS min, round(quantile_cont(CAST({a} AS DOUBLE), 0.25) + 1e-9, 4) AS q25,
  round(quantile_cont(CAST({a} AS DOUBLE), 0.5) + 1e-9, 4) AS q50, round(quantile_cont(CAST({a} AS DOUBLE), 0.75) + 1e-9, 4) AS q75, round(quantile_cont(CAST({a} AS DOUBLE), 0.9) + 1e-9, 4) AS q90,
  round(quantile_cont(CAST({a} AS DOUBLE), 0.95) + 1e-9, 4) AS q95, round(quantile_cont(CAST({a} AS DOUBLE), 0.99) + 1e-9, 4) AS q99, CAST(max({a}) AS DOUBLE) AS max FROM rain_events""" for a in ATTRIBUTES))
def describe_events(d) -> DataFrame:
    """Numbers, moments and quantiles of five attributes."""
    levels = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    long = d.rain_events.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("v")) for a in ATTRIBUTES])).alias("s")).select("s.*")
    out = long.groupBy("attribute").agg(
        F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"),
    )
    found = exact_quantiles(long, "attribute", levels).groupBy("attribute").pivot("level", levels).agg(F.first("value"))
    named = found.select("attribute", *[F.round(F.col(f"`{q}`") + 1e-9, 4).alias(f"q{int(q * 100)}") for q in levels])
    return out.join(named, "attribute", "left")


def exact_quantiles(long: DataFrame, by: str, levels: list[float], ranges: int = 200) -> DataFrame:
    """(by, level, value): quantiles of column v in each group, on the line between the two values at a level's place.

    Estimated quantiles cut a group's distinct values into ranges; counts are summed over the ranges, and within each range on
    its own, so that no task holds all values of a group. Nulls don't count; a group without values has no rows.
    """
    counts = long.filter("v IS NOT NULL").groupBy(by, "v").agg(F.count("*").alias("n"))
    cuts = counts.groupBy(by).agg(F.percentile_approx("v", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(10 * ranges)).alias("cuts"))
    placed = counts.join(F.broadcast(cuts), by)  # one row per group
    placed = placed.withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sums = placed.groupBy(by, "range").agg(F.sum("n").alias("own"))
    before = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select(by, "range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"), F.sum("own").over(Window.partitionBy(by)).alias("all"))
    inner = Window.partitionBy(by, "range").orderBy("v")
    ends = placed.join(offset, [by, "range"]).withColumn("end", F.col("offset") + F.sum("n").over(inner))
    level = F.explode(F.array(*[F.lit(q) for q in levels])).alias("level")
    asked = ends.select(by, "v", "n", "end", "all", level).withColumn("at", F.col("level") * (F.col("all") - 1))
    holds = lambda place: (place >= F.col("end") - F.col("n")) & (place < F.col("end"))
    low, high = F.max(F.when(holds(F.floor("at")), F.col("v"))), F.max(F.when(holds(F.ceil("at")), F.col("v")))
    share = F.first(F.col("at") - F.floor("at"))
    met = asked.filter(holds(F.floor("at")) | holds(F.ceil("at"))).groupBy(by, "level")
    return met.agg((low + (high - low) * share).alias("value"))


def histogram(values: DataFrame, column: str, bins: int, low: Column, high: Column) -> DataFrame:
    """Counts and densities of equal bins between two bounds; the last bin holds its right edge."""
    width = (high - low) / bins
    inside = values.filter((F.col(column) >= low) & (F.col(column) <= high))
    index = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
    counts = inside.groupBy(index.cast("int").alias("bin"), width.alias("width")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the bins
    return counts.select("bin", "n", F.round(F.col("n") / (total * F.col("width")), 6).alias("density"))


@query("histogram", """
, two AS (SELECT target, p_sum FROM targets), edges AS (SELECT min(p_sum) AS low, 100.0 AS high FROM two),
binned AS (SELECT target, least(CAST(floor((p_sum - low) / ((high - low) / 49)) AS INTEGER), 48) AS bin, (high - low) / 49 AS width FROM two, edges WHERE p_sum BETWEEN low AND high)
SELECT target, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY target) * min(width)), 6) AS density FROM binned GROUP BY target, bin""")
def histograms(d) -> DataFrame:
    """Events with and without claims over the same bin edges: 50 edges make 49 bins."""
    rows = d.targets.select("target", "p_sum")
    edges = rows.agg(F.min("p_sum").alias("low"))  # one row
    rows = rows.join(F.broadcast(edges))
    part = lambda t: histogram(rows.filter(f"target = {t}"), "p_sum", 49, F.col("low"), F.lit(100.0)).withColumn("target", F.lit(t))
    return part(0).unionByName(part(1)).select("target", "bin", "n", "density")


COMPARED = ["p_sum", "i_mean", "i_max", "api", "p_sum_q", "i_mean_q", "i_max_q", "api_q"]


@query("smoothing_stats", MATCHES + """
, met AS (SELECT step, l.*, r.duration AS r_duration, """ + ", ".join(f"r.{c} AS r_{c}" for c in COMPARED) + """ FROM matches JOIN rain_events l ON l.eid = left_eid JOIN s_rain_events r ON r.eid = right_eid),
long AS (SELECT step, 'duration' AS attribute, CAST(duration AS DOUBLE) AS a, CAST(r_duration AS DOUBLE) AS b FROM met""" + "".join(f" UNION ALL SELECT step, '{c}', {c}, r_{c} FROM met WHERE step = 'same'" for c in COMPARED) + """),
size AS (SELECT count(*) AS total FROM rain_events)
SELECT step, attribute, count(*) AS n, round(100.0 * count(*) / max(total) + 1e-9, 4) AS percent, round(avg(a) + 1e-9, 4) AS mean_raw, round(avg(b) + 1e-9, 4) AS mean_smoothed, max(a) AS max_raw, max(b) AS max_smoothed,
  round(avg(b - a) + 1e-9, 4) AS mean_diff, round(avg(100.0 * (b - a) / nullif(a, 0)) + 1e-9, 4) AS mean_rel_diff FROM long, size GROUP BY step, attribute
UNION ALL SELECT 'rest', NULL, count(*), round(100.0 * count(*) / (SELECT total FROM size) + 1e-9, 4), NULL, NULL, NULL, NULL, NULL, NULL FROM rain_events WHERE eid NOT IN (SELECT left_eid FROM matches)""")
def smoothing_stats(d) -> DataFrame:
    """What smoothing does to events: durations of the pairs that each step matched, eight attributes of equal spans, and what no step matched.

    Differences are smoothed less raw; relative ones leave out raw values of 0.
    """
    met = stored(events.compare_event_sets(d.rain_events, d.smoothed_events), "matches")
    side = lambda rows, eid, name: rows.select(F.col("eid").alias(eid), F.struct(F.col("duration").cast("double").alias("duration"), *COMPARED).alias(name))
    rows = met.join(side(d.rain_events, "left_eid", "a"), "left_eid").join(side(d.smoothed_events, "right_eid", "b"), "right_eid")
    kept = lambda c: (F.col("step") == "same") | F.lit(c == "duration")
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"a.{c}").alias("a"), F.col(f"b.{c}").alias("b"), kept(c).alias("kept")) for c in ["duration", *COMPARED]])
    long = rows.select("step", F.inline(pairs)).filter("kept")
    total = d.rain_events.agg(F.count("*").alias("total"))  # one row
    r = lambda c: F.round(c + 1e-9, 4)
    diff = F.col("b") - F.col("a")
    out = long.groupBy("step", "attribute").agg(
        F.count("*").alias("n"), r(F.avg("a")).alias("mean_raw"), r(F.avg("b")).alias("mean_smoothed"), F.max("a").alias("max_raw"), F.max("b").alias("max_smoothed"),
        r(F.avg(diff)).alias("mean_diff"), r(F.avg(F.try_divide(100.0 * diff, F.col("a")))).alias("mean_rel_diff"),
    )
    rest = d.rain_events.join(met.select(F.col("left_eid").alias("eid")), "eid", "left_anti").agg(F.count("*").alias("n")).withColumn("step", F.lit("rest"))
    both = out.unionByName(rest, allowMissingColumns=True).join(F.broadcast(total))
    return both.withColumn("percent", r(100.0 * F.col("n") / F.col("total"))).drop("total")


@query("time_difference_hist", """
, dts AS (SELECT CAST(floor((epoch(e_start) - epoch(CAST(date_claim AS TIMESTAMP))) / 86400) AS BIGINT) AS dt FROM linked JOIN rain_events USING (eid)),
span AS (SELECT unnest(range((SELECT min(dt) FROM dts), (SELECT max(dt) FROM dts) + 1)) AS dt)
SELECT s.dt, count(d.dt) AS n FROM span s LEFT JOIN dts d USING (dt) GROUP BY s.dt""")
def time_difference_hist(d) -> DataFrame:
    from .series import days_to_event

    counts = days_to_event(d).groupBy(F.col("dt_start").alias("dt")).agg(F.count("*").alias("n"))
    days = counts.agg(F.explode(F.sequence(F.min("dt"), F.max("dt"))).alias("dt"))
    return days.join(counts, "dt", "left").fillna(0, subset=["n"])


@query("disagreement_matrix", DIFF + """
SELECT run_a AS run_row, run_b AS run_col, CAST(n_diff AS DOUBLE) AS value FROM diffs UNION ALL SELECT run_b, run_a, round(100.0 * n_diff / n_b, 4) FROM diffs""")
def disagreement_matrix(d) -> DataFrame:
    """Above the diagonal numbers of claims that two runs link differently, below it the percentage of the row's links."""
    diffs = linking.disagreements(d.runs)
    upper = diffs.select(F.col("run_a").alias("run_row"), F.col("run_b").alias("run_col"), F.col("n_diff").cast("double").alias("value"))
    return upper.unionByName(diffs.select(F.col("run_b").alias("run_row"), F.col("run_a").alias("run_col"), F.round(100.0 * F.col("n_diff") / F.col("n_b"), 4).alias("value")))


@query("zonal_stats", "SELECT cid, min(value) AS min, max(value) AS max, round(avg(value) + 1e-9, 4) AS mean, round(stddev_pop(value) + 1e-9, 4) AS sd, round(median(value) + 1e-9, 4) AS median FROM pixels GROUP BY cid")
def zonal_stats(d) -> DataFrame:
    return grid.zonal_stats(d.pixels).withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("mean", "sd", "median")})


@query("zonal_fractions", "SELECT cid, " + ", ".join(f"round(avg(CASE WHEN class = {k} THEN 1.0 ELSE 0.0 END), 6) AS cat_{k}" for k in range(1, 8)) + " FROM pixels GROUP BY cid")
def zonal_fractions(d) -> DataFrame:
    return grid.zonal_fractions(d.pixels, list(range(1, 8))).withColumns({f"cat_{k}": F.round(f"cat_{k}", 6) for k in range(1, 8)})


@query("zone_max", ", members AS (SELECT DISTINCT px % 50 AS zone_id, px, py FROM pixels WHERE class = 1) SELECT zone_id, max(value) AS value FROM members JOIN pixels USING (px, py) GROUP BY zone_id")
def zone_max(d) -> DataFrame:
    """Largest value in each zone, zones given as a table of their pixels."""
    members = d.pixels.filter("class = 1").select((F.col("px") % 50).alias("zone_id"), "px", "py").distinct()
    return members.join(d.pixels.select("px", "py", "value"), ["px", "py"]).groupBy("zone_id").agg(F.max("value").alias("value"))


@query("scores_by_model", """
, hits AS (SELECT month(e_start) * 100 + day(e_start) % 5 AS part, 'or' AS model, target, i_max_q >= 0.9 OR p_sum_q >= 0.98 AS p FROM targets
  UNION ALL SELECT month(e_start) * 100 + day(e_start) % 5, 'and', target, i_max_q >= 0.9 AND p_sum_q >= 0.98 FROM targets),
f1s AS (SELECT model, part, 2.0 * count(*) FILTER (p AND target = 1) / (2 * count(*) FILTER (p AND target = 1) + count(*) FILTER (p AND target = 0) + count(*) FILTER (NOT p AND target = 1)) AS f1 FROM hits GROUP BY model, part)
SELECT model, count(f1) AS n, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS sd, round(min(f1), 6) AS min, round(median(f1), 6) AS q50, round(max(f1), 6) AS max FROM f1s GROUP BY model""")
def scores_by_model(d) -> DataFrame:
    """Distribution of a score over parts of the data, per model."""
    from .verification import confusion_counts

    part = F.month("e_start") * 100 + F.day("e_start") % 5
    a, b = F.col("i_max_q") >= 0.9, F.col("p_sum_q") >= 0.98
    rows = [d.targets.select(F.lit(m).alias("model"), part.alias("part"), "target", p.cast("int").alias("pred")) for m, p in (("or", a | b), ("and", a & b))]
    counts = confusion_counts(rows[0].unionByName(rows[1]), ["model", "part"])
    f1 = counts.withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    r = lambda c, name: F.round(c, 6).alias(name)
    return f1.groupBy("model").agg(F.count("f1").alias("n"), r(F.avg("f1"), "mean"), r(F.stddev_samp("f1"), "sd"), r(F.min("f1"), "min"), r(F.median("f1"), "q50"), r(F.max("f1"), "max"))


@query("distinct_cells", RUNS + " SELECT DISTINCT cid FROM runs")
def distinct_cells(d) -> DataFrame:
    return d.runs.select("cid").distinct()


@query("impact_subsets", """
SELECT 'hit' AS subset, count(*) AS n, round(avg(p_sum), 4) AS p_sum FROM targets WHERE target > 0 UNION ALL SELECT 'none', count(*), round(avg(p_sum), 4) FROM targets WHERE target = 0
UNION ALL SELECT 'heavy', count(*), round(avg(p_sum), 4) FROM targets WHERE i_max > 0 AND i_max_q > 0.98""")
def impact_subsets(d) -> DataFrame:
    parts = {"hit": "target > 0", "none": "target = 0", "heavy": "i_max > 0 AND i_max_q > 0.98"}
    own = [F.struct(F.lit(name).alias("subset"), F.count_if(F.expr(c)).alias("n"), F.round(F.avg(F.when(F.expr(c), F.col("p_sum"))), 4).alias("p_sum")) for name, c in parts.items()]
    return d.targets.agg(F.array(*own).alias("own")).select(F.inline("own"))  # one pass over the events


@query("dem_stats", ", s AS (SELECT avg(value) AS mean, stddev_pop(value) AS sd FROM pixels) SELECT px, py, round(max((value - mean) / sd), 5) AS dem FROM pixels, s GROUP BY px, py")
def dem_stats(d) -> DataFrame:
    """The value layer in units of its standard deviation over the whole grid."""
    stats = d.pixels.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))  # one row
    rows = d.pixels.join(F.broadcast(stats))
    return rows.groupBy("px", "py").agg(F.round(F.max((F.col("value") - F.col("mean")) / F.col("sd")), 5).alias("dem"))
