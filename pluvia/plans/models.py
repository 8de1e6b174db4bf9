"""Impact models: thresholds, logistic regression, forests, benchmarks, tuning (Spark ML)."""

from __future__ import annotations

import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..operators import forest, samples, search
from ..sources.files import stored
from .base import query
from .features import FEATURES, sampled, split_rows, vectors
from .verification import confusion_counts, predicted, roc_area

TREES, DEPTH, LEAF, SHARE = 800, 30, 90, "0.3"

#: Rows of one task of a forest's fit at most, each with a weight per tree.
ROWS_A_TASK = 50_000

#: The seeds of a sweep's eleven splits, and its weight denominator.
SEEDS, DENOMINATORS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 42), (30.0,)


@query("thresholds", """
SELECT eid, target, CASE WHEN i_max_q >= 0.9 OR p_sum_q >= 0.98 THEN 1 ELSE 0 END AS union_pred, CASE WHEN i_max_q >= 0.9 AND p_sum_q >= 0.98 THEN 1 ELSE 0 END AS intersection_pred FROM targets""")
def thresholds(d) -> DataFrame:
    return d.targets.select("eid", "target", samples.threshold_prediction().alias("union_pred"), samples.threshold_prediction(both=True).alias("intersection_pred"))


def weighted(d, denominator: float = 2.0) -> DataFrame:
    """Samples as vectors, scaled by the training part, with the weight of their class."""
    return with_weights(stored(samples.scaled(stored(split_rows(d), "samples"), FEATURES), "scaled"), denominator)


def with_weights(rows: DataFrame, denominator: float) -> DataFrame:
    weights = samples.class_weights(rows.filter("split = 'train'"), denominator).withColumnRenamed("label", "target")
    return vectors(rows.join(F.broadcast(weights), "target")).withColumn("label", F.col("target").cast("double"))  # one row per class


def fit_logistic(rows: DataFrame, max_iter: int = 1000):
    """Logistic regression with the usual L2 penalty of one, in terms of the weights' sum."""
    train = rows.filter("split = 'train'")
    total = train.agg(F.sum("weight")).first()[0] or 1.0
    return LogisticRegression(weightCol="weight", maxIter=max_iter, standardization=False, elasticNetParam=0.0, regParam=1.0 / total).fit(train)


def dealt(rows: DataFrame, side_by_side: int = 1) -> DataFrame:
    """Rows dealt to all cores by event: a small table is one file, which one task would read. Sorted, so that a forest doesn't depend on files.

    The rows of one event are alike in all that a forest reads. Of fits ``side_by_side`` each takes its share of the cores: every task of a level
    has statistics of all its nodes, so that more tasks than cores make work, not speed.
    """
    tasks = max(-(-rows.sparkSession.sparkContext.defaultParallelism // side_by_side), -(-rows.count() // ROWS_A_TASK))
    return rows.repartition(tasks, "eid").sortWithinPartitions("eid")


def fit_forest(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, features: str = SHARE, seed: int = 42, impurity: str = "gini", side_by_side: int = 1):
    """A forest of the training part; each row's nodes are kept from level to level, so that no level walks the trees from their roots."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=min(depth, 30), minInstancesPerNode=leaf, featureSubsetStrategy=features, weightCol="weight", seed=seed, impurity=impurity, cacheNodeIds=True)
    return forest.fit(dealt(rows.filter("split = 'train'").select("eid", "features", "label", "weight"), side_by_side))


def scored(model, rows: DataFrame) -> DataFrame:
    prob = vector_to_array("probability")[1]
    return model.transform(rows).select("eid", "split", "target", prob.alias("prob"), (prob > 0.5).cast("int").alias("pred"))


def summary(rows: DataFrame) -> DataFrame:
    """Counts and ROC area per split."""
    return confusion_counts(rows, ["split"]).join(roc_area(rows, ["split"]), "split")


@query("logistic_regression")
def logistic_regression(d) -> DataFrame:
    rows = weighted(d)
    return summary(scored(fit_logistic(rows), rows))


def celled(rows: DataFrame, wanted: str = "true") -> tuple[DataFrame, DataFrame | None]:
    """Rows (split, label and features) with the code of their bins, and their cells for a forest, or none if a task could not hold these.

    Rows of the condition ``wanted`` get predictions.
    """
    coded = stored(forest.coded(rows, FEATURES, forest.cuts(rows.filter("split = 'train'"), FEATURES)), "coded")
    cells = stored(forest.cells(coded, F.expr(wanted)), "cells")
    return coded, cells if cells.count() <= forest.MOST_CELLS else None


def class_weights_of(rows: DataFrame) -> tuple[float, float]:
    found = {r["target"]: r["weight"] for r in rows.select("target", "weight").distinct().collect()}  # one row per class
    return found.get(0, 1.0), found.get(1, 1.0)


@query("random_forest")
def random_forest(d) -> DataFrame:
    """Trees are dealt over the tasks where those can hold the cells; else rows are (``fit_forest``)."""
    rows = weighted(d)
    coded, cells = celled(rows.drop("features"))
    if cells is None:
        return summary(stored(scored(fit_forest(rows), dealt(rows)), "scored"))
    found = forest.predictions(cells, forest.Settings(TREES, DEPTH, LEAF, SHARE, weights=class_weights_of(rows)), len(FEATURES))
    prob = F.col("prediction")
    return summary(stored(coded.join(found, "code").select("eid", "split", "target", prob.alias("prob"), (prob > 0.5).cast("int").alias("pred")), "scored"))


@query("random_forest_ratio")
def random_forest_ratio(d) -> DataFrame:
    """A forest for the ratio of claims to contracts."""
    ratio = d.targets.select("eid", F.least(F.lit(1.0), F.col("nb_claims") / F.col("nb_contracts")).alias("label")).groupBy("eid").agg(F.max("label").alias("label"))
    rows = vectors(stored(split_rows(d).join(ratio, "eid"), "samples"))
    coded, cells = celled(rows.drop("features"))
    if cells is None:
        regressor = RandomForestRegressor(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF, featureSubsetStrategy=SHARE, seed=42, cacheNodeIds=True)
        found = regressor.fit(dealt(rows.filter("split = 'train'").select("eid", "features", "label"))).transform(dealt(rows))
    else:
        found = coded.join(forest.predictions(cells, forest.Settings(TREES, DEPTH, LEAF, SHARE, "variance"), len(FEATURES)), "code")
    error = F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("label"), F.lit(2.0))))
    return found.groupBy("split").agg(error.alias("rmse"), F.count("*").alias("n"))


@query("feature_importance")
def feature_importance(d) -> DataFrame:
    """The twenty most important features of a forest, with the spread over its trees."""
    rows = weighted(d)
    cells = celled(rows.drop("features"), "false")[1]
    if cells is None:
        shares = [t.featureImportances.toArray() for t in fit_forest(rows).trees]
        long = d.spark.createDataFrame([(i, float(t[i])) for t in shares for i in range(len(FEATURES))], "i int, v double")
    else:
        long = forest.importances(cells, forest.Settings(TREES, DEPTH, LEAF, SHARE, weights=class_weights_of(rows)), len(FEATURES))
    per = long.groupBy("i").agg(F.sum("v").alias("sum"), F.stddev_pop("v").alias("sd"))  # one row per feature
    share = F.coalesce(F.try_divide(F.col("sum"), F.sum("sum").over(Window.partitionBy())), F.lit(0.0))
    names = d.spark.createDataFrame(list(enumerate(FEATURES)), "i int, feature string")
    return names.join(F.broadcast(per), "i").select("feature", share.alias("importance"), "sd").orderBy(F.desc("importance"), "feature").limit(20)


@query("benchmarks", "SELECT eid, target, 1 AS always_true, 0 AS always_false FROM targets")
def benchmarks(d) -> DataFrame:
    return d.targets.select("eid", "target", F.lit(1).alias("always_true"), F.lit(0).alias("always_false"))


@query("benchmark_random", """
, drawn AS (SELECT CASE day(e_start) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, target, CAST('0x' || substr(md5(CAST(eid AS VARCHAR)), 1, 7) AS BIGINT) / 268435456.0 AS prob FROM targets),
r AS (SELECT split, target, prob, rank() OVER (PARTITION BY split ORDER BY prob) + (count(*) OVER (PARTITION BY split, prob) - 1) / 2.0 AS rk FROM drawn),
g AS (SELECT split, count(*) FILTER (target = 1 AND prob > 0.5) AS tp, count(*) FILTER (target = 0 AND prob <= 0.5) AS tn, count(*) FILTER (target = 0 AND prob > 0.5) AS fp, count(*) FILTER (target = 1 AND prob <= 0.5) AS fn,
  sum(rk) FILTER (target = 1) AS s, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM r GROUP BY split)
SELECT split, tp, tn, fp, fn, round((s - p * (p + 1) / 2.0) / (p * n), 6) AS roc_auc FROM g""")
def benchmark_random(d) -> DataFrame:
    """Random probabilities from a digest of the event, so that they stay the same when a task runs again."""
    prob = F.conv(F.substring(F.md5(F.col("eid").cast("string")), 1, 7), 16, 10).cast("long") / float(1 << 28)
    rows = predicted(d).select("split", "target", prob.alias("prob"))
    return summary(rows.withColumn("pred", (F.col("prob") > 0.5).cast("int"))).withColumn("roc_auc", F.round("roc_auc", 6))


@query("score_batch")
def score_batch(d) -> DataFrame:
    """Class and probability of every sample of every split, by a model that is written and read again."""
    from pyspark.ml.classification import LogisticRegressionModel

    from .scans import scratch

    rows, path = weighted(d), scratch(d, "model")
    fit_logistic(rows).write().overwrite().save(path)
    return scored(LogisticRegressionModel.load(path), rows)


def weight_sweep(d, seeds: Sequence[int] = SEEDS, denominators: Sequence[float] = DENOMINATORS, max_iter: int = 1000) -> DataFrame:
    """Scores of logistic regressions for several splits (seeds) and weight denominators; all fits read one written table.

    Seeds are worked on side by side: a fit is many short jobs one after another, which alone leave most cores idle.
    """
    base = stored(sampled(d), "samples")

    def run(seed: int) -> list[DataFrame]:
        rows = stored(samples.scaled(samples.split_by_date(base, seed), FEATURES), "scaled")
        parts = []
        for denominator in denominators:
            full = with_weights(rows, denominator)
            found = summary(stored(scored(fit_logistic(full, max_iter), full), "scored"))
            parts.append(stored(found.select(F.lit(seed).alias("seed"), F.lit(denominator).alias("denominator"), "*"), "scores"))
        return parts

    scopes = [copy_context() for _ in seeds]  # tables made in a thread belong to the caller's scratch scope
    with ThreadPoolExecutor(search.PARALLEL) as pool:
        parts = [x for own in pool.map(lambda scope, seed: scope.run(inheritable_thread_target(d.spark)(run), seed), scopes, seeds) for x in own]
    return reduce(DataFrame.unionByName, parts)


def forest_trials(d, trials: int = 100, trees: tuple[int, int] = (50, 1000), depth: tuple[int, int] = (5, 100), leaf: tuple[int, int] = (1, 100), features: tuple[float, float] = (0.1, 1.0), denominator: tuple[int, int] = (1, 100), seed: int = 42) -> DataFrame:
    """Random trials over a forest's parameters and the weight denominator, scored by F1 on the validation part; the best comes first.

    Spark's trees end at depth 30, which is what deeper settings get. A node's least size for a split follows from the leaf's.
    """
    draw, parts = random.Random(seed), []
    base = stored(samples.scaled(stored(split_rows(d), "samples"), FEATURES), "scaled")
    for trial in range(trials):
        setting = {"trees": draw.randint(*trees), "depth": draw.randint(*depth), "leaf": draw.randint(*leaf), "features": str(round(draw.uniform(*features), 2))}
        weight = draw.randint(*denominator)
        rows = with_weights(base, float(weight))
        counts = confusion_counts(scored(fit_forest(rows, **setting), rows.filter("split = 'valid'")), ["split"])
        f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + 1e-7)
        parts.append(counts.select(F.lit(trial).alias("trial"), *[F.lit(v).alias(k) for k, v in setting.items()], F.lit(weight).alias("denominator"), f1.alias("f1")))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("f1"), "trial")


@query("seed_weight_sweep")
def seed_weight_sweep(d) -> DataFrame:
    """All seeds with one denominator and full iterations, as in the studied sweep."""
    return weight_sweep(d)


def forest_search(d, settings: list[dict] | None = None, path: str | None = None, **options) -> DataFrame:
    """All settings of a forest on their full budget, scored by F1 on the validation part, the best first; fewer go on if ``budgets`` are given."""
    from .scans import scratch

    base = stored(samples.scaled(stored(split_rows(d), "samples"), FEATURES), "scaled")
    even = with_weights(base, 1.0)
    weights = class_weights_of(even)
    coded, cells = celled(even.drop("features"), "split = 'valid'")
    counts = stored(coded.filter("split = 'valid'").groupBy("code", "target").agg(F.count("*").alias("n")), "counts")

    def by_trees(own: dict, denominator: float, side_by_side: int) -> Row:
        found = forest.predictions(cells, forest.Settings(**own, weights=(weights[0], weights[1] / denominator)), len(FEATURES), side_by_side)
        n = lambda t, p: F.coalesce(F.sum(F.when((F.col("target") == t) & ((F.col("prediction") > 0.5) == bool(p)), F.col("n"))), F.lit(0))
        return counts.join(found, "code").agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn")).first()

    def by_rows(own: dict, denominator: float, side_by_side: int) -> Row:
        rows = with_weights(base, denominator)
        return confusion_counts(scored(fit_forest(rows, **own, side_by_side=side_by_side), dealt(rows.filter("split = 'valid'"), side_by_side)), []).first()

    def fit_and_score(setting: dict, side_by_side: int) -> float:
        own = dict(setting)
        n = (by_rows if cells is None else by_trees)(own, float(own.pop("denominator")), side_by_side)
        return 2 * n["tp"] / (2 * n["tp"] + n["fp"] + n["fn"] + 1e-7)

    found = search.halving_search(d.spark, path or scratch(d, "trials"), search.forest_settings() if settings is None else settings, fit_and_score, told=True, **options)
    return found.orderBy(F.desc("rung"), F.desc("score"), "trial")


@query("tune_forest")
def tune_forest(d) -> DataFrame:
    """The whole space with 100 trials, each fitted with all its trees."""
    return forest_search(d)
