"""Samples for models: splits that keep a date together, scaling by training statistics, class weights, negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import hashed_order

VALID_TEST = 0.3
TEST_OF_REST = 0.5


def split_keys(keys: DataFrame, seed: int = 42, valid_test: float = VALID_TEST, test: float = TEST_OF_REST) -> DataFrame:
    """``split`` of each key: 70/15/15 within each ``class``, in hashed order.

    A class's keys are the distinct dates (or months) of a table, not its rows.
    """
    order = Window.partitionBy("class").orderBy(hashed_order(F.col("key"), seed=seed), "key")
    share = (F.row_number().over(order) - 1) / F.count("*").over(Window.partitionBy("class"))
    valid = 1 - valid_test
    split = F.when(share < valid, "train").when(share < valid + valid_test * (1 - test), "valid").otherwise("test")
    return keys.withColumn("split", split)


def split_by_date(samples: DataFrame, seed: int = 42) -> DataFrame:
    """With ``split``; all samples of one ``ref_date`` are in one part, dates with a positive are spread like those without."""
    dates = samples.groupBy(F.col("ref_date").alias("key")).agg(F.max((F.col("target") > 0).cast("int")).alias("class"))
    parts = split_keys(dates, seed).select(F.col("key").alias("ref_date"), "split")
    return samples.join(parts, "ref_date")


def split_by_month(samples: DataFrame, strata: int = 5, seed: int = 42) -> DataFrame:
    """With ``split``; months are ranked by their ratio of positives, cut into strata of equal width, and split within them."""
    month = F.date_format("ref_date", "yyyy-MM")
    months = samples.groupBy(month.alias("key")).agg(F.avg((F.col("target") > 0).cast("int")).alias("ratio"))
    rank = F.row_number().over(Window.orderBy("ratio", "key"))  # one row per month
    n = F.count("*").over(Window.partitionBy())
    stratum = F.least(F.ceil((rank - 1) / F.greatest((n - 1) / strata, F.lit(1e-9))), F.lit(strata))
    parts = split_keys(months.withColumn("class", F.greatest(stratum, F.lit(1))), seed).select(F.col("key").alias("month"), "split")
    return samples.withColumn("month", month).join(F.broadcast(parts), "month").drop("month")  # one row per month


def scaled(samples: DataFrame, features: list[str], kind: str = "zscore") -> DataFrame:
    """Features scaled by statistics of the training part only: one row, sent to every task."""
    train = samples.filter("split = 'train'")
    if kind == "zscore":
        stats = train.agg(*[x for f in features for x in (F.avg(f).alias(f"a_{f}"), (F.stddev_pop(f) + 1e-8).alias(f"b_{f}"))])
    else:
        stats = train.agg(*[x for f in features for x in (F.min(f).alias(f"a_{f}"), (F.max(f) - F.min(f)).alias(f"b_{f}"))])
    rows = samples.join(F.broadcast(stats))
    return rows.withColumns({f: F.try_divide(F.col(f) - F.col(f"a_{f}"), F.col(f"b_{f}")) for f in features}).drop(*[f"{p}_{f}" for f in features for p in "ab"])


def class_weights(samples: DataFrame, denominator: float = 1.0, reduction: float = 1.0) -> DataFrame:
    """(label, weight): rows over classes times the class's rows, the positives' lessened by two divisors."""
    counts = samples.groupBy(F.col("target").alias("label")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # one row per class
    weight = F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n"))
    less = F.when(F.col("label") == 1, F.lit(max(reduction, 1.0) * denominator)).otherwise(1.0)
    return counts.select("label", (weight / less).alias("weight"))


def downsampled(samples: DataFrame, factor: float | None = None, key: str = "eid", seed: int = 42, number: int | None = None) -> DataFrame:
    """All positives, and exactly a ``factor``-th or a fixed ``number`` of the training negatives (all if they are fewer), in hashed order.

    The cut is found among digests by their leading digits first: counts per prefix say which prefix holds it, and
    only that prefix's rows are ranked.
    """
    order = hashed_order(F.col(key), seed=seed)
    negative = (F.col("target") == 0) & (F.col("split") == "train")
    rows = samples.withColumns({"digest": order, "prefix": F.substring(order, 1, 3)})
    counts = rows.filter(negative).groupBy("prefix").agg(F.count("*").alias("n"))  # at most 4096 rows
    upto = F.sum("n").over(Window.orderBy("prefix"))
    cuts = counts.withColumns({"upto": upto, "keep": F.lit(number) if number is not None else F.floor(F.sum("n").over(Window.partitionBy()) / factor)})
    quota = cuts.select("prefix", F.greatest(F.lit(0), F.least("n", F.col("keep") - F.col("upto") + F.col("n"))).alias("quota"))
    place = F.row_number().over(Window.partitionBy("prefix").orderBy("digest", key))
    kept = rows.filter(negative).join(F.broadcast(quota), "prefix").filter("quota > 0").withColumn("place", place).filter("place <= quota")
    return kept.select(*samples.columns).unionByName(samples.filter(~negative))


def shuffled(samples: DataFrame, key: str = "eid", seed: int = 42) -> DataFrame:
    return samples.orderBy(hashed_order(F.col(key), seed=seed))


def threshold_prediction(a: float = 0.9, b: float = 0.98, both: bool = False) -> Column:
    """1 where the largest intensity's rank or (``both``: and) the sum's rank reaches its threshold."""
    x, y = F.col("i_max_q") >= a, F.col("p_sum_q") >= b
    return F.when((x & y) if both else (x | y), 1).otherwise(0)
