"""Streams: event extraction from a feed, and scoring of arriving events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import day_start, hour_start
from ..operators import samples
from ..operators.samples import threshold_prediction
from ..sources.files import stored
from ..streaming import scoring
from ..streaming.events import full_stream_events, run_to_table, stream_events
from .base import query
from .features import sampled
from .scans import scratch


def feed(d, least: float = 0.1) -> DataFrame:
    """The observed hours as a stream of files, closed by one far-future row that lets the watermark pass all others."""
    path = scratch(d, "feed")
    rows = d.observed.filter(F.col("precip") >= least)
    rows.write.parquet(path)
    newest = d.table("events").agg(F.max(hour_start(F.col("ts"))).alias("time"))
    end = newest.select(F.lit(-1).alias("cid"), F.expr("time + INTERVAL 30 DAYS").alias("time"), F.lit(99.0).alias("precip"))
    end.select("cid", "time", "precip").write.mode("append").parquet(path)
    return d.spark.readStream.schema(rows.schema).parquet(path)


@query("stream_events", """
SELECT cid, min(time) AS e_start, max(time) AS e_end, CAST(date_diff('hour', min(time), max(time)) + 1 AS INTEGER) AS duration, round(sum(precip), 3) AS p_wet, max(precip) AS i_max,
  arg_min(time, {'a': -precip, 'b': time}) AS i_max_date FROM wet GROUP BY cid, gid HAVING round(sum(precip), 3) >= 10""")
def streamed_events(d) -> DataFrame:
    """Events of the feed; the batch result over wet hours is the same."""
    out, state = scratch(d, "stream-out"), scratch(d, "stream-state")
    stream = stream_events(feed(d))
    run_to_table(stream, out, state)
    # the closing row goes here: a filter before the sink would move below the watermark and take it away too early
    return d.spark.read.schema(stream.schema).parquet(out).filter("cid >= 0")


@query("stream_full_events", "SELECT cid, e_start, e_end, duration, p_sum, i_max, i_mean, i_sd, api, i_max_date FROM rain_events")
def streamed_full_events(d) -> DataFrame:
    """Events of the feed with all characteristics, by state per cell; the batch result is the same."""
    out, state = scratch(d, "stream-out"), scratch(d, "stream-state")
    stream = full_stream_events(feed(d, 1e-9))
    run_to_table(stream, out, state)
    return d.spark.read.schema(stream.schema).parquet(out).filter("cid >= 0")


@query("score_forecast", """
SELECT eid, CASE WHEN i_max_q >= 0.9 OR p_sum_q >= 0.98 THEN 1 ELSE 0 END AS pred FROM rain_events""")
def score_forecast(d) -> DataFrame:
    """Arriving events scored by the threshold model, batch by batch."""
    path, out, state = scratch(d, "new-events"), scratch(d, "scored"), scratch(d, "scored-state")
    d.rain_events.select("eid", "i_max_q", "p_sum_q").write.parquet(path)
    stream = d.spark.readStream.schema("eid bigint, i_max_q double, p_sum_q double").parquet(path)
    scored = stream.select("eid", threshold_prediction().alias("pred"))
    run_to_table(scored, out, state)
    return d.spark.read.schema(scored.schema).parquet(out)


#: Events that begin before the 20th day of the given month are archived; later ones arrive.
ARCHIVED_DAYS = 19
RANKS = ["i_max", "p_sum"]
PIPELINE_FEATURES = ["i_max_q", "p_sum_q", "duration", "c_acctbal", "p_retailprice"]

ARRIVED = """
, cut AS (SELECT date_trunc('day', min(time)) + INTERVAL 19 DAY AS t FROM precip),
arrived AS (SELECT e.* FROM rain_events e, cut WHERE e_start >= t),
archive AS (SELECT e.* FROM rain_events e, cut WHERE e_start < t),
placed AS (
  SELECT n.eid, round(least(1.0, (count(*) FILTER (a.i_max < n.i_max) + (count(*) FILTER (a.i_max = n.i_max) + 1) / 2.0) / count(*)), 5) AS i_max_q,
    round(least(1.0, (count(*) FILTER (a.p_sum < n.p_sum) + (count(*) FILTER (a.p_sum = n.p_sum) + 1) / 2.0) / count(*)), 5) AS p_sum_q
  FROM arrived n JOIN archive a USING (cid) GROUP BY n.eid)"""


class Forecast:
    """Archive of past events, a pipeline fitted on them and stored, and a stream of the events since."""

    def __init__(self, d) -> None:
        self.d = d
        cut = d.span.select(day_start(F.col("first"), ARCHIVED_DAYS).alias("cut"))
        self.past = d.rain_events.join(F.broadcast(cut), F.col("e_start") < F.col("cut")).drop("cut")  # one row
        self.new = d.rain_events.join(F.broadcast(cut), F.col("e_start") >= F.col("cut")).drop("cut")
        self.archive = stored(scoring.archived_ranks(self.past, RANKS), "archive")

    def stream(self) -> DataFrame:
        path = scratch(self.d, "arriving")
        self.new.select("eid", "cid", "duration", *RANKS).write.parquet(path)
        return self.d.spark.readStream.schema("eid bigint, cid int, duration int, i_max double, p_sum double").parquet(path)

    def ranked(self, rows: DataFrame) -> DataFrame:
        return scoring.with_archived_ranks(rows, self.archive, RANKS)

    def model_path(self) -> str:
        """Fits the pipeline on past events, whose ranks come from the archive too, and stores it."""
        past = sampled(self.d).join(self.past.select("eid", *RANKS), "eid").drop("i_max_q", "p_sum_q")
        rows = stored(self.ranked(past), "samples")
        weights = samples.class_weights(rows, 2.0).withColumnRenamed("label", "target")
        full = rows.join(F.broadcast(weights), "target").withColumn("label", F.col("target").cast("double"))  # one row per class
        path = scratch(self.d, "pipeline")
        scoring.fit_pipeline(full, PIPELINE_FEATURES).write().overwrite().save(path)
        return path

    def with_static(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.d.static_a.select("cid", "c_acctbal"), "cid", "left").join(self.d.static_b.select("cid", "p_retailprice"), "cid", "left")


@query("score_stream", ARRIVED + """
SELECT n.eid, p.i_max_q, p.p_sum_q, CASE WHEN p.i_max_q >= 0.9 OR p.p_sum_q >= 0.98 THEN 1 ELSE 0 END AS pred FROM arrived n LEFT JOIN placed p USING (eid)""")
def score_stream(d) -> DataFrame:
    """Arriving events with their ranks in the archive and the threshold rule's class, batch by batch."""
    cast = Forecast(d)
    out, state = scratch(d, "scored"), scratch(d, "scored-state")
    score = lambda rows: cast.ranked(rows).select("eid", "i_max_q", "p_sum_q", threshold_prediction().alias("pred"))
    scoring.score_stream(cast.stream(), score, out, state)
    return d.spark.read.parquet(out).drop("batch")


@query("score_stream_model")
def score_stream_model(d) -> DataFrame:
    """Arriving events scored by the stored pipeline, read again for the stream; events that lack a feature have no score."""
    from pyspark.ml import PipelineModel

    cast = Forecast(d)
    model = PipelineModel.load(cast.model_path())
    out, state = scratch(d, "scored"), scratch(d, "scored-state")
    scoring.score_stream(cast.stream(), lambda rows: scoring.scored(model, cast.with_static(cast.ranked(rows)), "eid"), out, state)
    return d.spark.read.parquet(out).drop("batch")
