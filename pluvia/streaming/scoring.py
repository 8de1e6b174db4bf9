"""Scores of arriving events by a stored model and archived distributions.

The archive has a row per cell: for each attribute its sorted distinct values and how many events lie below each. A new event is looked up
there by binary search, so a batch costs in proportion to its own events, not to the archive's. The model is a stored ``PipelineModel``
that puts together, scales and weighs the features. Each micro-batch writes a folder named by its number and replaces it when the
batch runs again, so that a restart after any failure scores nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import first_not_below


def archived_ranks(events: DataFrame, attributes: list[str]) -> DataFrame:
    """(cid, <attribute>_archive): struct of the sorted distinct ``values``, the number of events ``below`` each, and ``n``, per cell.

    Nulls are left out. An archive can be added to: counts of old and new values are summed up by ``merged_ranks``.
    """
    counts = [_counted(events.filter(F.col(a).isNotNull()).groupBy("cid", F.col(a).alias("v")).agg(F.count("*").alias("n")), a) for a in attributes]
    out = counts[0]
    for other in counts[1:]:
        out = out.join(other, "cid", "full")
    return out


def _counted(counts: DataFrame, attribute: str) -> DataFrame:
    below = F.sum("n").over(Window.partitionBy("cid").orderBy("v")) - F.col("n")
    rows = counts.withColumn("below", below).groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("v", "below"))).alias("s"), F.sum("n").alias("n"))
    of = F.struct(F.transform("s", lambda x: x["v"]).alias("values"), F.transform("s", lambda x: x["below"]).alias("below"), "n")
    return rows.select("cid", of.alias(f"{attribute}_archive"))


def merged_ranks(archive: DataFrame, events: DataFrame, attributes: list[str]) -> DataFrame:
    """The archive with more events in it, from the archive and those events alone."""
    out = None
    for a in attributes:
        s = F.col(f"{a}_archive")
        ends = F.concat(F.slice(s["below"], 2, F.size(s["below"])), F.array(s["n"]))
        old = archive.filter(s.isNotNull()).select("cid", F.inline(F.arrays_zip(s["values"].alias("v"), s["below"].alias("b"), ends.alias("e"))))
        both = old.select("cid", "v", (F.col("e") - F.col("b")).alias("n")).unionByName(events.filter(F.col(a).isNotNull()).select("cid", F.col(a).alias("v"), F.lit(1).cast("long").alias("n")))
        own = _counted(both.groupBy("cid", "v").agg(F.sum("n").alias("n")), a)
        out = own if out is None else out.join(own, "cid", "full")
    return out


def archived_rank(archive: Column, v: Column) -> Column:
    """Percentile rank that ``v`` has among archived values, ties averaged: that of an archived event is what a batch gives it.

    A value between two archived ones ranks half an event above the lower; none ranks above 1; null without an archive or value.
    """
    at = first_not_below(archive["values"], v)
    upto = F.coalesce(F.get(archive["below"], at + 1), archive["n"])
    below = F.coalesce(F.get(archive["below"], at), archive["n"])
    ties = F.when(F.get(archive["values"], at) == v, upto - below).otherwise(0)
    return F.when(v.isNotNull() & archive["n"].isNotNull(), F.least(F.lit(1.0), (below + (ties + 1) / 2) / archive["n"]))


def with_archived_ranks(events: DataFrame, archive: DataFrame, attributes: list[str]) -> DataFrame:
    """Events with ``<attribute>_q`` from the archive; ``events`` may be a stream (then the archive is the static side)."""
    rows = events.join(archive, "cid", "left")
    ranks = {f"{a}_q": F.round(archived_rank(F.col(f"{a}_archive"), F.col(a)), 5) for a in attributes}
    return rows.withColumns(ranks).drop(*[f"{a}_archive" for a in attributes])


def fit_pipeline(rows: DataFrame, features: list[str], max_iter: int = 1000) -> PipelineModel:
    """One pipeline from columns to probabilities: features as a vector, scaled to mean 0 and deviation 1, logistic regression.

    ``rows`` has ``label`` and ``weight``; the penalty is the usual one of 1 in terms of the weights' sum.
    """
    total = rows.agg(F.sum("weight")).first()[0] or 1.0
    stages = [
        VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(weightCol="weight", maxIter=max_iter, standardization=False, elasticNetParam=0.0, regParam=1.0 / total),
    ]
    return Pipeline(stages=stages).fit(rows)


def scored(model: PipelineModel, rows: DataFrame, *keep: str) -> DataFrame:
    prob = vector_to_array("probability")[1]
    return model.transform(rows).select(*keep, prob.alias("prob"), (prob > 0.5).cast("int").alias("pred"))


def score_stream(events: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Scores all batches that are there, and stops. Each goes to ``path/batch=<number>`` and replaces what an earlier try left there."""

    def write(rows: DataFrame, number: int) -> None:
        score(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
