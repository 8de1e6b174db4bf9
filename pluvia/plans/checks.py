"""Data-quality checks: each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.claims import duplicated
from .base import query


@query("check_grid", """
, steps AS (SELECT source, min(d) AS step FROM (SELECT source, x - lag(x) OVER (PARTITION BY source ORDER BY x) AS d FROM (
  SELECT DISTINCT 'claims' AS source, x FROM claims_wide JOIN cells USING (cid) UNION SELECT DISTINCT 'contracts', x FROM exposure JOIN cells USING (cid) UNION SELECT DISTINCT 'precip', x FROM precip)) GROUP BY source),
grids AS (SELECT source, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(DISTINCT cid) AS n_cells FROM (
  SELECT 'claims' AS source, cid, x, y FROM claims_wide JOIN cells USING (cid) UNION ALL SELECT 'contracts', cid, x, y FROM exposure JOIN cells USING (cid) UNION ALL SELECT 'precip', cid, x, y FROM precip) GROUP BY source)
SELECT g.source, g.x0, g.x1, g.y0, g.y1, g.n_cells, s.step, g.x0 = p.x0 AND g.x1 = p.x1 AND g.y0 = p.y0 AND g.y1 = p.y1 AND s.step = q.step AS same
FROM grids g JOIN steps s USING (source), (SELECT * FROM grids WHERE source = 'precip') p, (SELECT * FROM steps WHERE source = 'precip') q""")
def check_grid(d) -> DataFrame:
    """Extent, step and cells of each source, compared with the precipitation grid."""
    places = lambda rows, name: rows.select(F.lit(name).alias("source"), "cid").distinct().join(d.cells, "cid")
    rows = places(d.claims_wide, "claims").unionByName(places(d.exposure, "contracts")).unionByName(places(d.precip, "precip"))
    grids = rows.groupBy("source").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.countDistinct("cid").alias("n_cells"))
    gaps = rows.select("source", "x").distinct().withColumn("gap", F.col("x") - F.lag("x").over(Window.partitionBy("source").orderBy("x")))
    full = grids.join(gaps.groupBy("source").agg(F.min("gap").alias("step")), "source")
    shape = ["x0", "x1", "y0", "y1", "step"]
    first = full.filter("source = 'precip'").select(F.struct(*shape).alias("first"))  # one row
    return full.join(F.broadcast(first)).withColumn("same", F.struct(*shape) == F.col("first")).drop("first")


@query("check_unique_keys", """
SELECT 'exposure' AS source, cid, count(*) AS n FROM (SELECT cid, year FROM exposure UNION ALL SELECT cid, year FROM exposure WHERE cid <= 3) GROUP BY cid, year HAVING count(*) > 1""")
def check_unique_keys(d) -> DataFrame:
    """Repeated (year, cell) keys; the first cells' rows are given twice."""
    rows = d.exposure.unionByName(d.exposure.filter("cid <= 3"))
    return duplicated(rows, ["cid", "year"]).select(F.lit("exposure").alias("source"), "cid", "n")


@query("check_period", """
SELECT 1990 AS year_start, 2001 AS year_end, min(year) AS first, max(year) AS last, 1990 >= min(year) AND 2001 <= max(year) AS covered FROM exposure_long""")
def check_period(d) -> DataFrame:
    """Whether the years asked for lie inside the data's years."""
    years = d.exposure_long.agg(F.min("year").alias("first"), F.max("year").alias("last"))
    covered = (F.lit(1990) >= F.col("first")) & (F.lit(2001) <= F.col("last"))
    return years.select(F.lit(1990).alias("year_start"), F.lit(2001).alias("year_end"), "first", "last", covered.alias("covered"))


@query("check_no_zero_contracts", "SELECT eid, cid, nb_contracts FROM targets WHERE nb_contracts = 0")
def check_no_zero_contracts(d) -> DataFrame:
    return d.targets.filter("nb_contracts = 0").select("eid", "cid", "nb_contracts")


@query("check_duplicate_times", """
SELECT cid, time, count(*) AS n FROM (SELECT cid, time FROM observed UNION ALL SELECT cid, time FROM observed WHERE precip > 9) GROUP BY cid, time HAVING count(*) > 1""")
def check_duplicate_times(d) -> DataFrame:
    """Repeated hours; hours of more than 9 mm are given twice."""
    return duplicated(d.observed.unionByName(d.observed.filter("precip > 9")), ["cid", "time"])
