"""Settings of the registered models, and models against what they should find."""

import inspect
import os

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pluvia.operators import grid, search
from pluvia.plans import descriptive, models, verification


def test_forests_have_the_reference_size():
    found = {k: p.default for k, p in inspect.signature(models.fit_forest).parameters.items()}
    assert (found["trees"], found["depth"], found["leaf"], found["features"]) == (800, 30, 90, "0.3")
    assert models.TREES == 800 and models.DEPTH == 30 and models.LEAF == 90


@pytest.fixture(scope="module")
def made(spark):
    """Samples of two features, of which the first decides; the other is noise."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=600) > 0.4).astype(int)
    w = np.where(y == 1, 2.0, 0.7)
    rows = [(i, "train" if i < 400 else "valid", int(y[i]), float(y[i]), float(w[i]), Vectors.dense(x[i])) for i in range(600)]
    table = spark.createDataFrame(rows, ["eid", "split", "target", "label", "weight", "features"]).cache()
    return table, x[:400], y[:400], w[:400]


def test_logistic_regression_equals_newton_steps(made):
    table, x, y, w = made
    model = models.fit_logistic(table)
    a, beta = np.c_[x, np.ones(len(x))], np.zeros(3)
    penalty = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        beta -= np.linalg.solve((a.T * (w * p * (1 - p))) @ a + penalty, a.T @ (w * (p - y)) + penalty @ beta)
    assert [*model.coefficients, model.intercept] == pytest.approx(beta, rel=1e-3)


def test_scores_are_the_same_after_loading(made, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    table = made[0]
    model = models.fit_logistic(table)
    model.write().overwrite().save(str(tmp_path / "model"))
    pick = lambda m: {r["eid"]: r["prob"] for r in models.scored(m, table).collect()}
    assert pick(model) == pick(LogisticRegressionModel.load(str(tmp_path / "model")))


def test_forest_is_reproducible_and_finds_the_feature(made):
    table = made[0]
    one, two = (models.fit_forest(table, trees=12, depth=5, leaf=5, features="1.0") for _ in range(2))
    assert list(one.featureImportances.toArray()) == list(two.featureImportances.toArray())
    assert sum(one.featureImportances.toArray()) == pytest.approx(1) and one.featureImportances[0] > 0.7
    area = {r["split"]: r["roc_auc"] for r in models.summary(models.scored(one, table)).collect()}
    assert area["valid"] > 0.8


def test_roc_area_against_ranks(spark):
    rng = np.random.default_rng(6)
    for scale in (1.0, 1e-6):  # spread over the buckets, and all in one
        prob, y = np.round(rng.random(500), 2) * scale, rng.integers(0, 2, 500)
        rows = spark.createDataFrame([("a", int(t), float(p)) for t, p in zip(y, prob, strict=True)], "split string, target int, prob double")
        higher = [(p > q) + 0.5 * (p == q) for p in prob[y == 1] for q in prob[y == 0]]
        assert verification.roc_area(rows, ["split"]).first()["roc_auc"] == pytest.approx(np.mean(higher))
    one = spark.createDataFrame([("a", 1, 1.0)], "split string, target int, prob double")
    assert verification.roc_area(one, ["split"]).first()["roc_auc"] is None


def test_search_settings_are_the_reference_ones():
    found = {k: p.default for k, p in inspect.signature(models.forest_trials).parameters.items()}
    assert (found["trials"], found["trees"], found["depth"], found["leaf"], found["denominator"]) == (100, (50, 1000), (5, 100), (1, 100), (1, 100))
    assert len(models.SEEDS) == 11 and inspect.signature(models.weight_sweep).parameters["max_iter"].default == 1000


def test_smoothing_counts_missing_places_as_dry(spark):
    cells = spark.createDataFrame([(i + 1, 1000.0 * (i % 10) + 500, 1000.0 * (i // 10) + 500) for i in range(15)], "cid int, x double, y double")
    rain = cells.select("cid", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("time"), F.lit(9.0).alias("precip"))
    got = {r["cid"]: r["precip"] for r in grid.smooth(rain, cells).collect()}
    assert got == pytest.approx({**{i: 9.0 for i in range(1, 15)}, 5: 8.0, 6: 7.0, 7: 6.0, 8: 6.0, 9: 6.0, 10: 6.0, 15: 7.0})


def test_exact_quantiles_equal_numpy(spark):
    rng, levels = np.random.default_rng(7), [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    groups = {"few": [3.0], "ties": [1.0] * 50 + [2.0] * 3, "wide": list(rng.normal(size=999)), "skewed": list(np.round(rng.exponential(size=400), 1))}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("none", None)], "g string, v double")
    got = {(r["g"], r["level"]): r["value"] for r in descriptive.exact_quantiles(rows, "g", levels, ranges=7).collect()}
    assert got == pytest.approx({(g, q): np.quantile(vs, q) for g, vs in groups.items() for q in levels})


def test_stream_drops_late_rows(spark, tmp_path):
    """A wet day, days long after it that close it, and a late hour of the first day, which no longer counts."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType, TimestampNTZType

    from pluvia.streaming.events import run_to_table, stream_events

    schema = StructType([StructField("cid", IntegerType()), StructField("time", TimestampNTZType()), StructField("precip", DoubleType())])
    hours = lambda rows: spark.createDataFrame(rows, "cid int, t string, precip double").select("cid", F.col("t").cast("timestamp_ntz").alias("time"), "precip")
    batches = [
        [(1, "2024-01-01 05:00:00", 6.0), (1, "2024-01-01 13:00:00", 7.0)],
        [(1, "2024-01-10 00:00:00", 20.0)],
        [(1, "2024-01-20 00:00:00", 1.0)],
        [(1, "2024-01-01 14:00:00", 50.0), (1, "2024-01-30 00:00:00", 1.0)],
        [(1, "2024-02-28 00:00:00", 1.0)],
    ]
    for k, rows in enumerate(batches):
        known = set((tmp_path / "feed").glob("*.parquet"))
        hours(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        for new in set((tmp_path / "feed").glob("*.parquet")) - known:
            os.utime(new, (1_700_000_000 + 60 * k,) * 2)  # files arrive in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    found = stream_events(stream)
    run_to_table(found, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out")).orderBy("e_start").collect()
    assert [(r["duration"], r["p_wet"], r["i_max"]) for r in got] == [(9, 13.0, 7.0), (1, 20.0, 20.0)]


def test_halving_keeps_the_best_and_goes_on_after_a_loss(spark, tmp_path):
    """Scores that grow with the budget by a known order; the driver is lost in the second rung, and no trial is fitted twice."""
    settings, calls = search.forest_settings(20), []
    good = {k: (k * 7) % 20 for k in range(20)}
    number = {(s["depth"], s["leaf"], s["features"], s["denominator"]): k for k, s in enumerate(settings)}

    def score(own, fail=None):
        k = number[own["depth"], own["leaf"], own["features"], own["denominator"]]
        if fail is not None and own["trees"] > settings[k]["trees"] / 10 and k == fail:
            raise RuntimeError("lost")
        calls.append((k, own["trees"]))
        return good[k] / 20 + own["trees"] / 1e6

    options = {"budgets": (1 / 16, 1 / 4, 1.0), "keep": 4, "parallel": 3}
    second = sorted(good, key=lambda k: -good[k])[:5]
    with pytest.raises(RuntimeError, match="lost"):
        search.halving_search(spark, str(tmp_path / "t"), settings, lambda s: score(s, fail=second[0]), **options)
    found = search.halving_search(spark, str(tmp_path / "t"), settings, score, **options).collect()
    assert len(calls) == len(set(calls)) == len(found) == 20 + 5 + 2
    last = [r for r in found if r["rung"] == 2]
    assert sorted(r["trial"] for r in last) == sorted(second[:2]) and all(r["trees"] == settings[r["trial"]]["trees"] for r in last)


def test_settings_fill_the_space():
    own = search.forest_settings(2000)
    assert own == search.forest_settings(2000) and own[:100] == search.forest_settings()
    for name, (low, high) in {"trees": (50, 1000), "leaf": (1, 100), "denominator": (1, 100)}.items():
        values = [s[name] for s in own]
        assert min(values) < low + 0.02 * (high - low) + 1 and max(values) > high - 0.02 * (high - low) - 1 and min(values) >= low and max(values) <= high
    assert {s["impurity"] for s in own} == {"gini", "entropy"} and max(s["depth"] for s in own) == 30 and min(s["depth"] for s in own) == 5


def test_search_finds_the_best_of_all_full_runs(spark):
    """Eight settings of small forests: those that go on score as they do in a full run, and the winner is the best of all."""
    from pluvia.adapters import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    settings = [{**s, "trees": 24, "depth": 6} for s in search.forest_settings(8)]
    full = {r["trial"]: r["score"] for r in models.forest_search(d, settings, budgets=(1.0,)).collect()}
    found = models.forest_search(d, settings, budgets=(1 / 2, 1.0), keep=2).collect()
    last = {r["trial"]: r["score"] for r in found if r["rung"] == 1}
    assert len(last) == 4 and last == {t: full[t] for t in last}
    assert found[0]["rung"] == 1 and found[0]["score"] == max(full.values()) > 0.1


def test_ratio_forest_against_the_mean(spark, monkeypatch):
    """The ratio's forest: as many rows per part as the split has, and on its training part no worse than the part's mean."""
    from pluvia.adapters import Domain
    from pluvia.plans import features

    monkeypatch.setattr(models, "TREES", 30)
    monkeypatch.setattr(models, "LEAF", 5)
    d = Domain(spark, "/root/testdata/sf0.001")
    got = {r["split"]: r for r in models.random_forest_ratio(d).collect()}
    ratio = d.targets.groupBy("eid").agg(F.max(F.least(F.lit(1.0), F.col("nb_claims") / F.col("nb_contracts"))).alias("ratio"))
    want = {r["split"]: r for r in features.split_rows(d).join(ratio, "eid").groupBy("split").agg(F.count("*").alias("n"), F.stddev_pop("ratio").alias("sd")).collect()}
    assert {k: r["n"] for k, r in got.items()} == {k: r["n"] for k, r in want.items()}
    assert got["train"]["rmse"] <= want["train"]["sd"] and all(0 <= r["rmse"] <= 1 for r in got.values())


def test_forests_read_a_small_table_in_all_tasks(spark, monkeypatch):
    """A table of one file is dealt over the cores before a forest reads it, for the fit and for scores, with all its rows."""
    rows = spark.createDataFrame([(i, "train" if i % 3 else "valid", i % 2, float(i % 7), float(i % 2), 1.0) for i in range(600)], "eid long, split string, target int, v double, label double, weight double")
    rows = rows.coalesce(1)
    seen = []

    def spy(self, train):
        seen.append((train.rdd.getNumPartitions(), train.count(), self.getCacheNodeIds()))
        return None

    monkeypatch.setattr(models.RandomForestClassifier, "fit", spy)
    models.fit_forest(rows.withColumn("features", F.col("v")))
    assert seen == [(4, 400, True)]
    got = models.dealt(rows)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 600 and got.exceptAll(rows).isEmpty()
    monkeypatch.setattr(models, "ROWS_A_TASK", 50)
    assert models.dealt(rows).rdd.getNumPartitions() == 12


def test_fits_side_by_side_share_the_cores(spark, tmp_path, monkeypatch):
    """Fits of a search that run at once get a part of the cores each, and all rows; a table of many rows is still dealt to more tasks."""
    rows = spark.createDataFrame([(i, float(i)) for i in range(600)], "eid long, v double").coalesce(1)
    assert [models.dealt(rows, n).rdd.getNumPartitions() for n in (1, 2, 3, 8)] == [4, 2, 2, 1]
    assert models.dealt(rows, 8).exceptAll(rows).isEmpty() and models.dealt(rows, 8).count() == 600
    monkeypatch.setattr(models, "ROWS_A_TASK", 50)
    assert models.dealt(rows, 8).rdd.getNumPartitions() == 12
    told = []
    search.halving_search(spark, str(tmp_path / "t"), search.forest_settings(8), lambda own, n: told.append(n) or own["trees"] / 1e4, budgets=(1 / 2, 1.0), told=True)
    assert told == [8] * 8 + [2] * 2
