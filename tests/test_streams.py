"""Streams against batches: events with all characteristics, archived ranks, scores by a stored pipeline, restarts."""

import os

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType, TimestampNTZType

from pluvia.functions.expressions import first_not_below, percentile_rank
from pluvia.operators import events
from pluvia.streaming import scoring
from pluvia.streaming.events import full_stream_events, run_to_table

HOURS = StructType([StructField("cid", IntegerType()), StructField("time", TimestampNTZType()), StructField("precip", DoubleType())])


def put(rows, folder, k):
    """One file more, which arrives after those before it."""
    known = set(folder.glob("*.parquet")) if folder.exists() else set()
    rows.coalesce(1).write.mode("append").parquet(str(folder))
    for new in set(folder.glob("*.parquet")) - known:
        os.utime(new, (1_700_000_000 + 60 * k,) * 2)


def hours_of(spark, rows):
    return spark.createDataFrame(rows, "cid int, h long, precip double").select("cid", F.timestamp_seconds(F.lit(1704067200) + F.col("h") * 3600).cast("timestamp_ntz").alias("time"), "precip")


def test_full_events_equal_the_batch(spark, tmp_path):
    """Files of six days each, hours shuffled up to a day back; a late hour doesn't count; state goes when nothing can look back to it."""
    rng = np.random.default_rng(4)
    rain = [(c, h, round(float(rng.exponential(3)), 1)) for c in range(1, 6) for h in range(24 * 60) if rng.random() < 0.06]
    rain = [r for r in rain if r[2] > 0]
    arrives = {r: (r[1] + rng.integers(0, 24)) // 144 for r in rain}
    for k in range(max(arrives.values()) + 1):
        put(hours_of(spark, [r for r in rain if arrives[r] == k]), tmp_path / "feed", k)
    put(hours_of(spark, [(1, 30, 77.0), (9, 24 * 65, 1.0)]), tmp_path / "feed", 90)  # long behind the watermark
    put(hours_of(spark, [(9, 24 * 140, 1.0)]), tmp_path / "feed", 91)
    put(hours_of(spark, [(9, 24 * 200, 1.0)]), tmp_path / "feed", 92)
    stream = spark.readStream.schema(HOURS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    found = full_stream_events(stream)
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) == 6 and kept[-1] <= 1
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    calendar = spark.range(24 * 61).select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("cid"), F.col("id").alias("h"))
    series = calendar.join(spark.createDataFrame(rain, "cid int, h long, precip double"), ["cid", "h"], "left").fillna(0.0, ["precip"])
    series = series.select("cid", F.timestamp_seconds(F.lit(1704067200) + F.col("h") * 3600).cast("timestamp_ntz").alias("time"), "precip")
    batch = events.extract_events(series).select(*got.columns)
    key = ["cid", "e_start"]
    one, two = (x.orderBy(*key).toArrow().to_pandas() for x in (got, batch))
    assert len(one) > 20 and one.equals(two)


def test_halving_finds_what_binary_search_finds(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in [0, 1, 2, 3, 7, 8, 9, 33]:
        values = np.unique(rng.integers(0, 40, n)).astype(float).tolist()
        rows += [(values, float(v), int(np.searchsorted(values, v))) for v in rng.integers(-2, 43, 12)]
    got = spark.createDataFrame(rows, "values array<double>, v double, place int").withColumn("found", first_not_below(F.col("values"), F.col("v")))
    assert got.filter("found <> place").count() == 0


@pytest.fixture(scope="module")
def past(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(c), float(np.round(rng.exponential(9), 0)), float(np.round(rng.random(), 1)) if rng.random() < 0.9 else None) for i, c in enumerate(rng.integers(1, 9, 400))]
    return spark.createDataFrame(rows, "eid bigint, cid int, p_sum double, i_max double").cache()


def test_archived_ranks_of_archived_events(spark, past):
    names = ["p_sum", "i_max"]
    ranked = scoring.with_archived_ranks(past, scoring.archived_ranks(past, names), names)
    batch = past.withColumns({f"{c}_q": F.round(percentile_rank(c, "cid"), 5) for c in names})
    assert sorted(ranked.select(*batch.columns).collect(), key=lambda r: r["eid"]) == sorted(batch.collect(), key=lambda r: r["eid"])
    none = spark.createDataFrame([(1, 99, 1.0, 1.0), (2, 1, None, 5.0), (3, 1, 1e9, -1.0)], past.schema)
    got = {r["eid"]: r for r in scoring.with_archived_ranks(none, scoring.archived_ranks(past, names), names).collect()}
    assert got[1]["p_sum_q"] is None and got[2]["p_sum_q"] is None and got[3]["p_sum_q"] == 1.0 and 0 < got[3]["i_max_q"] < 0.02


def test_an_archive_can_be_added_to(spark, past):
    names = ["p_sum", "i_max"]
    old, new = past.filter("eid < 150 AND cid < 7"), past.filter("NOT (eid < 150 AND cid < 7)")
    merged = scoring.merged_ranks(scoring.archived_ranks(old, names), new, names)
    rows = lambda x: sorted(x.select("cid", "p_sum_archive", "i_max_archive").collect())
    assert rows(merged) == rows(scoring.archived_ranks(past, names))


def test_a_stream_that_fails_scores_nothing_twice(spark, past, tmp_path):
    """A batch that is written and then fails is written again in its own place; a later start goes on behind it."""
    samples = past.dropna().withColumns({"label": (F.col("p_sum") > 8).cast("double"), "weight": F.lit(1.0)})
    scoring.fit_pipeline(samples, ["p_sum", "i_max"]).write().overwrite().save(str(tmp_path / "model"))
    model = PipelineModel.load(str(tmp_path / "model"))
    feed, out, state = tmp_path / "feed", str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(3):
        put(past.filter(F.col("eid") % 4 == k), feed, k)
    stream = lambda: spark.readStream.schema(past.schema).option("maxFilesPerTrigger", 1).parquet(str(feed))
    calls = []

    def failing(rows):
        calls.append(1)
        if len(calls) == 2:
            scoring.scored(model, rows, "eid").write.mode("overwrite").parquet(f"{out}/batch=1")
            raise RuntimeError("lost")
        return scoring.scored(model, rows, "eid")

    with pytest.raises(Exception, match="lost"):
        scoring.score_stream(stream(), failing, out, state)
    scoring.score_stream(stream(), lambda rows: scoring.scored(model, rows, "eid"), out, state)
    put(past.filter(F.col("eid") % 4 == 3), feed, 3)
    scoring.score_stream(stream(), lambda rows: scoring.scored(model, rows, "eid"), out, state)
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 4
    want = scoring.scored(model, past, "eid")
    assert sorted(map(tuple, got.select("eid", "prob", "pred").collect())) == sorted(map(tuple, want.collect()))
    assert want.filter("pred = 1").count() > 20
