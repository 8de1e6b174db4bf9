"""Splits, scaling, weights and sampling; sorts, limits and set operations."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import epochs, linking, samples
from ..sources.files import stored
from .base import query
from .filters import reference_date

FEATURES = ["i_max_q", "p_sum_q", "duration", "c_acctbal", "p_retailprice"]

SPLIT = """
, sampled AS (SELECT t.eid, t.cid, x, y, coalesce(date_claim + INTERVAL 18 HOUR, i_max_date) AS ref_date, target, nb_claims, i_max_q, p_sum_q, duration, c_acctbal, p_retailprice
  FROM targets t LEFT JOIN static_a USING (cid) LEFT JOIN static_b USING (cid)),
clean AS (SELECT * FROM sampled WHERE i_max_q IS NOT NULL AND p_sum_q IS NOT NULL AND duration IS NOT NULL AND c_acctbal IS NOT NULL AND p_retailprice IS NOT NULL),
dates AS (SELECT ref_date, max(CASE WHEN target > 0 THEN 1 ELSE 0 END) AS class FROM clean GROUP BY ref_date),
placed_dates AS (SELECT ref_date, (row_number() OVER (PARTITION BY class ORDER BY md5(strftime(ref_date, '%Y-%m-%d %H:%M:%S') || '|42'), ref_date) - 1) / count(*) OVER (PARTITION BY class) AS s FROM dates),
parts AS (SELECT ref_date, CASE WHEN s < 0.7 THEN 'train' WHEN s < 0.85 THEN 'valid' ELSE 'test' END AS split FROM placed_dates),
split_rows AS (SELECT c.*, p.split FROM clean c JOIN parts p USING (ref_date))"""


def sampled(d) -> DataFrame:
    """Events with their reference date and features, without those that lack a feature."""
    rows = reference_date(d.targets).join(d.static_a.select("cid", "c_acctbal"), "cid", "left").join(d.static_b.select("cid", "p_retailprice"), "cid", "left")
    return rows.select("eid", "cid", "x", "y", "ref_date", "target", "nb_claims", *FEATURES).dropna(subset=FEATURES)


def split_rows(d) -> DataFrame:
    return samples.split_by_date(sampled(d))


@query("split_by_date", SPLIT + " SELECT eid, ref_date, target, split FROM split_rows")
def split_by_date(d) -> DataFrame:
    return split_rows(d).select("eid", "ref_date", "target", "split")


@query("split_by_month", """
, sampled AS (SELECT o_orderkey AS eid, o_orderdate AS ref_date, CASE WHEN o_totalprice > 350000 THEN 1 ELSE 0 END AS target FROM orders),
months AS (SELECT strftime(ref_date, '%Y-%m') AS key, avg(target) AS ratio FROM sampled GROUP BY 1),
ranks AS (SELECT key, row_number() OVER (ORDER BY ratio, key) AS r, count(*) OVER () AS n FROM months),
strata AS (SELECT key, CAST(greatest(1, least(5, ceil((r - 1) / greatest((n - 1) / 5, 1e-9)))) AS BIGINT) AS class FROM ranks),
placed AS (SELECT key, (row_number() OVER (PARTITION BY class ORDER BY md5(key || '|42'), key) - 1) / count(*) OVER (PARTITION BY class) AS s FROM strata)
SELECT split, count(*) AS n, CAST(sum(target) AS BIGINT) AS positives, count(DISTINCT strftime(ref_date, '%Y-%m')) AS months
FROM sampled JOIN (SELECT key, CASE WHEN s < 0.7 THEN 'train' WHEN s < 0.85 THEN 'valid' ELSE 'test' END AS split FROM placed) ON key = strftime(ref_date, '%Y-%m') GROUP BY split""")
def split_by_month(d) -> DataFrame:
    """Months of many years: orders stand for samples, large ones for positives."""
    rows = d.table("orders").select(F.col("o_orderkey").alias("eid"), F.col("o_orderdate").alias("ref_date"), F.when(F.col("o_totalprice") > 350000, 1).otherwise(0).alias("target"))
    parts = samples.split_by_month(rows)
    return parts.groupBy("split").agg(F.count("*").alias("n"), F.sum("target").alias("positives"), F.countDistinct(F.date_format("ref_date", "yyyy-MM")).alias("months"))


@query("zscore_features", SPLIT + """
, st AS (SELECT avg(p_sum_q) AS a, stddev_pop(p_sum_q) + 1e-8 AS b, avg(c_acctbal) AS c, stddev_pop(c_acctbal) + 1e-8 AS d FROM split_rows WHERE split = 'train')
SELECT eid, ref_date, split, round((p_sum_q - a) / b, 5) AS p_sum_q, round((c_acctbal - c) / d, 5) AS c_acctbal FROM split_rows, st""")
def zscore_features(d) -> DataFrame:
    out = samples.scaled(split_rows(d), ["p_sum_q", "c_acctbal"])
    return out.select("eid", "ref_date", "split", F.round("p_sum_q", 5).alias("p_sum_q"), F.round("c_acctbal", 5).alias("c_acctbal"))


@query("minmax_static", SPLIT + """
, st AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM split_rows WHERE split = 'train') SELECT eid, ref_date, split, round((c_acctbal - a) / (b - a), 6) AS c_acctbal FROM split_rows, st""")
def minmax_static(d) -> DataFrame:
    return samples.scaled(split_rows(d), ["c_acctbal"], "minmax").select("eid", "ref_date", "split", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("class_weights", SPLIT + """
, c AS (SELECT target AS label, count(*) AS n FROM split_rows WHERE split = 'train' GROUP BY target)
SELECT label, round(sum(n) OVER () / (count(*) OVER () * n) / CASE WHEN label = 1 THEN 2.0 ELSE 1.0 END, 6) AS weight FROM c""")
def class_weights(d) -> DataFrame:
    return samples.class_weights(split_rows(d).filter("split = 'train'"), denominator=2.0).withColumn("weight", F.round("weight", 6))


@query("downsample_negatives", SPLIT + """
, neg AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(eid AS VARCHAR) || '|42'), eid) AS rn, count(*) OVER () AS n FROM split_rows WHERE target = 0 AND split = 'train')
SELECT eid, target, split FROM neg WHERE rn <= n // 4 UNION ALL SELECT eid, target, split FROM split_rows WHERE NOT (target = 0 AND split = 'train')""")
def downsample_negatives(d) -> DataFrame:
    return samples.downsampled(split_rows(d), 4).select("eid", "target", "split")


@query("fixed_negatives", SPLIT + """
, neg AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(eid AS VARCHAR) || '|42'), eid) AS rn FROM split_rows WHERE target = 0 AND split = 'train')
SELECT eid, target, split FROM neg WHERE rn <= 40 UNION ALL SELECT eid, target, split FROM split_rows WHERE NOT (target = 0 AND split = 'train')""")
def fixed_negatives(d) -> DataFrame:
    return samples.downsampled(split_rows(d), number=40).select("eid", "target", "split")


@query("shuffle", SPLIT + " SELECT eid, ref_date FROM split_rows ORDER BY md5(CAST(eid AS VARCHAR) || '|42')")
def shuffle(d) -> DataFrame:
    return samples.shuffled(split_rows(d)).select("eid", "ref_date")


@query("epoch_batches", """
, sizes AS (SELECT count(DISTINCT eid) AS n FROM split_rows WHERE split = 'train')
SELECT CAST(e AS INTEGER) AS epoch, k AS batch, least(64, n - 64 * k) AS n_rows, least(64, n - 64 * k) AS n_events, n AS n_all
FROM sizes, (SELECT unnest(range(3)) AS e), (SELECT unnest(range(100000)) AS k) WHERE 64 * k < n""".join([SPLIT, ""]))
def epoch_batches(d) -> DataFrame:
    """Sizes of three epochs' batches of 64 training events; tests hold the orders themselves."""
    train = stored(split_rows(d).filter("split = 'train'").select("eid").distinct(), "train")
    rows = epochs.epoch_batches(train, "eid", 64, 3)
    out = rows.groupBy("epoch", "batch").agg(F.count("*").alias("n_rows"), F.countDistinct("eid").alias("n_events"))
    total = rows.groupBy("epoch").agg(F.countDistinct("eid").alias("n_all"))
    return out.join(F.broadcast(total), "epoch")  # one row per epoch


def vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


@query("feature_vectors", SPLIT + " SELECT eid, ref_date AS date, x, y, cid, split, target AS label, round(i_max_q + p_sum_q + duration + c_acctbal + p_retailprice + 1e-7, 4) AS total FROM split_rows")
def feature_vectors(d) -> DataFrame:
    """Samples as vectors with their keys; the vector's sum stands for it in comparisons."""
    rows = vectors(split_rows(d)).withColumn("values", vector_to_array("features"))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rows.select("eid", F.col("ref_date").alias("date"), "x", "y", "cid", "split", F.col("target").alias("label"), F.round(total + 1e-7, 4).alias("total"))


@query("target_stats", SPLIT + """
SELECT split, count(*) AS n, count(*) FILTER (target > 0) AS positives, round(100.0 * count(*) FILTER (target > 0) / count(*), 4) AS percent, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM split_rows GROUP BY split""")
def target_stats(d) -> DataFrame:
    from .descriptive import share

    counts = split_rows(d).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("target") > 0).alias("positives"))
    return counts.select("split", "n", "positives", F.round(100.0 * F.col("positives") / F.col("n"), 4).alias("percent"), share(F.col("n")).alias("share"))


@query("sort_claims", "SELECT date_claim, cid, selection FROM claims ORDER BY date_claim, cid")
def sort_claims(d) -> DataFrame:
    return d.claims.select("date_claim", "cid", "selection").orderBy("date_claim", "cid")


@query("head_events", "SELECT eid, cid, e_start FROM rain_events ORDER BY eid LIMIT 100")
def head_events(d) -> DataFrame:
    return d.rain_events.select("eid", "cid", "e_start").orderBy("eid").limit(100)


@query("union_parts", "SELECT eid, target FROM targets WHERE target > 0 UNION ALL SELECT eid, target FROM targets WHERE target = 0")
def union_parts(d) -> DataFrame:
    rows = d.targets.select("eid", "target")
    return rows.filter("target > 0").unionByName(rows.filter("target = 0"))


@query("distinct_ids", """
SELECT eid FROM losers UNION SELECT DISTINCT e.eid FROM rain_events e JOIN removed_claims r ON r.cid = e.cid AND abs((epoch(e.e_start) + epoch(e.e_end)) // 2 - epoch(CAST(r.date_claim AS TIMESTAMP))) <= 172800
WHERE e.eid NOT IN (SELECT eid FROM linked)""")
def distinct_ids(d) -> DataFrame:
    """Events to leave out: those that lost to another, and those of claims that the selection dropped."""
    return linking.losers(d.ranked).unionByName(linking.events_of_removed_claims(d.rain_events, d.removed_claims, d.linked)).distinct()
