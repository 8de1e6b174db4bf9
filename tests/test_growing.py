"""Epochs, archives that grow by a month, and checks within a write."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.operators import archive, epochs
from pluvia.sources import files


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1001])
def test_permutations_are_permutations(spark, n):
    rows = spark.range(n).select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(7))).alias("epoch"))
    got = rows.select("epoch", epochs.permuted(F.col("id"), n, F.col("epoch"), seed=3).alias("at"), "id").collect()
    order = {e: [r["at"] for r in sorted(got, key=lambda r: r["id"]) if r["epoch"] == e] for e in (0, 1, 7)}
    assert all(sorted(x) == list(range(n)) for x in order.values())
    if n > 50:
        moved = np.array(order[0])
        assert order[0] != order[1] != order[7]
        assert abs(np.corrcoef(moved, np.arange(n))[0, 1]) < 0.35 and (np.diff(moved) == 1).mean() < 0.1


def test_every_row_once_an_epoch(spark, tmp_path):
    rows = spark.range(1003).select(F.col("id").alias("eid"), F.lit("x").alias("v"))
    one = epochs.epoch_batches(rows, "eid", 64, 3).collect()
    again = epochs.epoch_batches(rows.repartition(7), "eid", 64, 3).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, again))
    for epoch in range(3):
        own = [r for r in one if r["epoch"] == epoch]
        assert sorted(r["eid"] for r in own) == list(range(1003))
        sizes = {b: sum(r["batch"] == b for r in own) for b in range(16)}
        assert sizes == {**dict.fromkeys(range(15), 64), 15: 1003 - 15 * 64}
        assert all(sorted(r["place"] for r in own if r["batch"] == b) == list(range(k)) for b, k in sizes.items())
    assert epochs.epoch_batches(rows.limit(0), "eid", 64, 3).count() == 0


@pytest.fixture(scope="module")
def hourly(spark):
    rng = np.random.default_rng(8)
    rows = [(c, dt.datetime(2024, m, d, h), (float(np.round(rng.exponential(2), 2)) if rng.random() < 0.3 else 0.0)) for c in range(1, 6) for m in (1, 2, 3) for d in range(1, 20) for h in range(0, 24, 3) if (c, m) != (4, 2)]
    return spark.createDataFrame([*rows, (9, dt.datetime(2024, 3, 1), None), (10, dt.datetime(2024, 3, 1), 5.0)], "cid int, time timestamp_ntz, precip double")


def test_an_archive_takes_one_more_month(spark, hourly, tmp_path):
    """States of two months, then a third one's: the same as all months at once, and only one range of values is read again."""
    new = F.col("time") >= F.lit(dt.datetime(2024, 3, 1))
    for part in (hourly.filter(~new), hourly.filter(new)):
        archive.month_states(part).write.mode("append").parquet(str(tmp_path / "states"))
    states = spark.read.parquet(str(tmp_path / "states"))
    got = {r["cid"]: (r["n"], r["mean"], r["sd"]) for r in archive.merged_moments(states).collect()}
    values = {}
    for r in hourly.collect():
        if r["precip"] is not None:
            values.setdefault(r["cid"], []).append(r["precip"])
    assert set(got) == set(values)
    for c, v in values.items():
        assert got[c] == pytest.approx((len(v), np.mean(v), np.std(v)))
    for level in (0.0, 0.5, 0.9, 0.99, 1.0):
        found = {r["cid"]: r["value"] for r in archive.archive_quantile(states, hourly, level).collect()}
        assert found == pytest.approx({c: np.quantile(v, level) for c, v in values.items()})
    hourly.write.parquet(str(tmp_path / "hours"))
    plan = archive.archive_quantile(states, spark.read.parquet(str(tmp_path / "hours")), 0.99)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(precip" in plan and "LessThan(precip" in plan


def test_checks_within_a_write(spark, tmp_path):
    """Each check fails on its own rows, in the job that writes; the table is whole, and sorted within cells."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, 1, at(0), 5), (2, 1, at(9), 5), (3, 1, at(9), 5), (4, 2, at(0), 0), (5, 2, at(900), None), (5, 3, at(1), 2)]
    events = spark.createDataFrame(rows, "eid bigint, cid int, e_start timestamp_ntz, nb_contracts int")
    checks = {"period": F.col("e_start") > F.lit(at(800)), "no_contracts": F.coalesce("nb_contracts", F.lit(0)) == 0}
    found = files.write_checked(events, str(tmp_path / "out"), checks)
    assert found == {"n_rows": 6, "duplicate_times": 1, "period": 1, "no_contracts": 2}
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == sorted(rows, key=str)
    assert files.write_checked(events.limit(0), str(tmp_path / "none"), checks) == {"n_rows": 0, "duplicate_times": 0, "period": 0, "no_contracts": 0}
