"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import linking
from ..functions.expressions import day_start
from ..operators.events import EVENT_COLUMNS
from ..sources import files
from .base import query

_EVENTS = ", ".join(EVENT_COLUMNS)


def scratch(d, name: str) -> str:
    return files.scratch(d.spark, name)


@query("scan_events", f"SELECT {_EVENTS} FROM rain_events")
def scan_events(d) -> DataFrame:
    return d.rain_events.select(*EVENT_COLUMNS)


@query("scan_static_attributes", "SELECT cid, c_acctbal FROM static_a")
def scan_static_attributes(d) -> DataFrame:
    path = scratch(d, "static")
    files.write_csv(d.static_a.select("cid", "c_mktsegment", "c_acctbal", "seg_building"), path)
    return files.read_static_attributes(d.spark, path, "cid int, c_mktsegment string, c_acctbal double, seg_building int", ["c_acctbal"])


SOURCE_SQL = ", sources AS (SELECT *, 'CPC_' || strftime(date_trunc('week', ts), '%Y%m%d') || '.nc' AS source FROM events)"


def with_source(d) -> DataFrame:
    """Raw rows with the name of the weekly file that they stand for."""
    return d.table("events").withColumn("source", F.concat(F.lit("CPC_"), F.date_format(F.trunc("ts", "week"), "yyyyMMdd"), F.lit(".nc")))


@query("rows_with_source", SOURCE_SQL + """
SELECT regexp_extract(source, '([A-Za-z]+)_\\d{8}', 1) AS tag, CAST(strptime(regexp_extract(source, '_(\\d{8})', 1), '%Y%m%d') AS DATE) AS date,
  count(*) AS n, count(DISTINCT source) AS n_files FROM sources GROUP BY 1, 2""")
def rows_with_source(d) -> DataFrame:
    """Tag and date of every row, read from the name of the weekly folder that its file lies in."""
    path = scratch(d, "weeks")
    with_source(d).write.partitionBy("source").parquet(path)
    rows = files.read_with_source(d.spark, path)
    return rows.groupBy("tag", "date").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_files"))


@query("source_overlap", SOURCE_SQL + """
, periods AS (SELECT source, min(ts) AS first, max(ts) AS last FROM (SELECT source, ts FROM sources UNION ALL SELECT 'CPC_copy', ts FROM sources WHERE user_id < 3) GROUP BY source)
SELECT source, first, last, before FROM (SELECT *, lag(last) OVER (ORDER BY first, source) AS before FROM periods) WHERE before >= first""")
def source_overlap(d) -> DataFrame:
    """Sources that begin before the one before them has ended; a copy of a few users' rows is one."""
    rows = with_source(d).select("source", "ts")
    rows = rows.unionByName(d.table("events").filter("user_id < 3").select(F.lit("CPC_copy").alias("source"), "ts"))
    periods = rows.groupBy("source").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return periods.withColumn("before", F.lag("last").over(Window.orderBy("first", "source"))).filter("before >= first")  # one row per source


@query("precip_long", "SELECT cid, x, y, time, precip FROM precip WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-20'")
def precip_long(d) -> DataFrame:
    return d.precip.filter("time >= TIMESTAMP_NTZ'2024-01-10' AND time < TIMESTAMP_NTZ'2024-01-20'")


@query("cells", "SELECT cid, x, y FROM cells WHERE cid <> 0 AND cid IS NOT NULL")
def cells(d) -> DataFrame:
    return d.cells.filter("cid <> 0 AND cid IS NOT NULL")


@query("sparse_claims", """
, inside AS (SELECT date_claim, cid, n FROM claims_long WHERE n <> 0 AND cid IN (SELECT cid FROM exposure_long))
SELECT 'all' AS part, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_rows FROM claims_long UNION ALL SELECT 'inside', CAST(sum(n) AS BIGINT), count(*) FROM inside""")
def sparse_claims(d) -> DataFrame:
    """Non-zero claims of exposed cells beside all claims: equal sums mean that no claim lies outside."""
    inside = d.claims_long.filter("n <> 0").join(d.exposure_long.select("cid"), "cid", "left_semi")
    total = lambda rows, part: rows.agg(F.lit(part).alias("part"), F.sum("n").alias("n"), F.count("*").alias("n_rows"))
    return total(d.claims_long, "all").unionByName(total(inside, "inside"))


@query("write_events", f"SELECT {_EVENTS} FROM rain_events")
def write_events(d) -> DataFrame:
    path = scratch(d, "events")
    files.write_events(d.rain_events.select(*EVENT_COLUMNS), path)
    return d.spark.read.parquet(path)


@query("write_checked", """
, bounds AS (SELECT date_trunc('day', min(time)) AS a, date_trunc('day', max(time)) + INTERVAL 1 DAY AS b FROM precip), grouped_starts AS (SELECT cid, e_start, count(*) AS k FROM targets GROUP BY cid, e_start)
SELECT 'n_rows' AS name, count(*) AS n FROM targets UNION ALL SELECT 'duplicate_times', CAST(coalesce(sum(k - 1), 0) AS BIGINT) FROM grouped_starts
UNION ALL SELECT 'outside', count(*) FILTER (e_start < a OR e_end >= b) FROM targets, bounds UNION ALL SELECT 'no_contracts', count(*) FILTER (coalesce(nb_contracts, 0) = 0) FROM targets
UNION ALL SELECT 'long', count(*) FILTER (duration > 24) FROM targets""")
def write_checked(d) -> DataFrame:
    """Events with targets written and checked in one job (an event has a row per claim); events over a day long are counted too."""
    bounds = d.span.select(day_start(F.col("first")).alias("a"), day_start(F.col("last"), 1).alias("b"))
    rows = d.targets.join(F.broadcast(bounds))  # one row
    checks = {"outside": (F.col("e_start") < F.col("a")) | (F.col("e_end") >= F.col("b")), "no_contracts": F.coalesce("nb_contracts", F.lit(0)) == 0, "long": F.col("duration") > 24}
    found = files.write_checked(rows, scratch(d, "checked"), checks)
    return d.spark.createDataFrame(list(found.items()), "name string, n bigint")


@query("write_results", "SELECT date_claim, cid, eid, e_search_window, e_match_score FROM linked")
def write_results(d) -> DataFrame:
    path = scratch(d, "links")
    rows = d.linked.select("date_claim", "cid", "eid", "e_search_window", "e_match_score")
    files.write_csv(rows, path)
    return d.spark.read.schema(rows.schema).option("header", True).csv(path)


_STATISTICS = {"n_events": "rain_events", "n_claims": "claims", "n_links": "linked", "n_losers": "losers"}


@query("write_statistics", "SELECT 'option' AS kind, 'windows' AS key, '5,3,1' AS value UNION ALL SELECT 'option', 'criteria', 'prior,i_mean,i_max,p_sum,r_ts_win,r_ts_evt'" + "".join(f" UNION ALL SELECT 'statistic', '{k}', CAST((SELECT count(*) FROM {t}) AS VARCHAR)" for k, t in _STATISTICS.items()))
def write_statistics(d) -> DataFrame:
    """Options and statistics of a linking run as rows of keys and values, written as CSV and read again."""
    options = {"windows": ",".join(map(str, linking.WINDOWS)), "criteria": ",".join(linking.CRITERIA)}
    rows = d.spark.createDataFrame([("option", k, v) for k, v in options.items()], "kind string, key string, value string")
    tables = {"rain_events": d.rain_events, "claims": d.claims, "linked": d.linked, "losers": linking.losers(d.ranked)}
    for key, name in _STATISTICS.items():
        rows = rows.unionByName(tables[name].agg(F.lit("statistic").alias("kind"), F.lit(key).alias("key"), F.count("*").cast("string").alias("value")))
    path = scratch(d, "statistics")
    files.write_csv(rows, path)
    return d.spark.read.schema(rows.schema).option("header", True).csv(path)


@query("series_per_cell", "SELECT cid, time, precip FROM precip WHERE cid BETWEEN 5 AND 9")
def series_per_cell(d) -> DataFrame:
    path = scratch(d, "series")
    files.write_series_per_cell(d.precip.select("cid", "time", "precip"), path, 5, 9)
    return d.spark.read.parquet(path).withColumn("cid", F.col("cid").cast("int"))


@query("scan_scores", """
SELECT 'thresholds' AS model, 'all' AS split, count(*) FILTER (target = 1 AND hit) AS tp, count(*) FILTER (target = 0 AND hit) AS fp FROM (
  SELECT target, i_max_q >= 0.9 OR p_sum_q >= 0.98 AS hit FROM targets)
UNION ALL SELECT 'constant', 'all', count(*) FILTER (target = 1), count(*) FILTER (target = 0) FROM targets""")
def scan_scores(d) -> DataFrame:
    root = scratch(d, "scores")
    hit = (F.col("i_max_q") >= 0.9) | (F.col("p_sum_q") >= 0.98)
    for name, chosen in (("thr_run", hit), ("always_true", F.lit(True))):
        counts = d.targets.agg(F.lit("all").alias("split"), F.count_if((F.col("target") == 1) & chosen).alias("tp"), F.count_if((F.col("target") == 0) & chosen).alias("fp"))
        _write_named(d, counts, f"{root}/{name}", f"{name}.csv")
        _write_named(d, d.spark.range(1).select(F.lit("x").alias("split"), F.lit(0).alias("tp"), F.lit(0).alias("fp")), f"{root}/{name}", f"{name}_options.csv")
    return files.read_scores(d.spark, root, "split string, tp bigint, fp bigint").select("model", "split", "tp", "fp")


def _write_named(d, rows: DataFrame, folder: str, name: str) -> None:
    """One CSV file of a few rows under a given name, by Hadoop's own file system calls."""
    part = scratch(d, "part")
    files.write_csv(rows.coalesce(1), part)
    jvm, conf = d.spark._jvm, d.spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(part).getFileSystem(conf)
    fs.mkdirs(path(folder))
    (found,) = [f.getPath() for f in fs.globStatus(path(f"{part}/part-*.csv"))]
    fs.rename(found, path(f"{folder}/{name}"))


