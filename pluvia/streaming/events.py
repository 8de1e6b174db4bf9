"""Rain events from an arriving hourly feed (Structured Streaming).

``stream_events`` has what session windows give; ``full_stream_events`` keeps each cell's rainy hours as state and gives all
characteristics of the events that batches extract, antecedent precipitation and deviation too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.expressions import instant, moment
from ..operators.events import API_DECAY, API_HOURS, GAP_HOURS, LEAST_SUM, WET

HOUR_MS = 3_600_000


def stream_events(hours: DataFrame, late: str = "2 days", wet: float = WET, gap_hours: int = GAP_HOURS, least_sum: float = LEAST_SUM) -> DataFrame:
    """Events that the watermark has closed, from a stream of (cid, time, precip).

    Rows later than ``late`` are dropped. Two wet hours belong together up to a gap of exactly ``gap_hours``: a
    session window ends at its last time plus the gap and merges with one that begins there. Dry hours never
    arrive, so the duration follows from start and end.
    """
    rows = hours.filter(F.col("precip") >= wet).withColumn("time", instant(F.col("time"))).withWatermark("time", late)
    # a session ends before its last time plus the gap; a second more lets a gap of exactly that length merge
    session = F.session_window("time", f"{gap_hours * 3600 + 1} seconds")
    sums = rows.groupBy("cid", session.alias("session")).agg(
        F.sum("precip").alias("p_wet"), F.max("precip").alias("i_max"), F.max("time").alias("last"), F.min_by("time", F.struct(-F.col("precip"), F.col("time"))).alias("first_max")
    )
    start = F.col("session.start")
    out = sums.select(
        "cid",
        moment(F.unix_seconds(start)).alias("e_start"),
        moment(F.unix_seconds("last")).alias("e_end"),
        ((F.unix_seconds("last") - F.unix_seconds(start)) / 3600 + 1).cast("int").alias("duration"),
        F.round("p_wet", 3).alias("p_wet"),
        "i_max",
        moment(F.unix_seconds("first_max")).alias("i_max_date"),
    )
    return out.filter(F.col("p_wet") >= least_sum)


def events_of_hours(hour: np.ndarray, precip: np.ndarray, after: int, until: float, wet: float = WET, gap: int = GAP_HOURS, least_sum: float = LEAST_SUM) -> tuple[list[tuple], int, int | None, int | None]:
    """Closed events among a cell's rainy hours (numbers in order, no two equal), and what stays open.

    Wet hours up to ``after`` belong to events that were closed before, and are history only. An event is closed if no hour from
    ``until`` on can still join it. Gives rows (start, end, duration, p_sum, i_max, i_mean, i_sd, api, i_max hour), the last
    hour of a closed event, and the first and last wet hour of what is open.
    """
    at = np.flatnonzero((precip >= wet) & (hour > after))
    parts = np.split(at, np.flatnonzero(np.diff(hour[at]) > gap) + 1) if len(at) else []
    rows, first, last = [], None, None
    for own in parts:
        start, end = int(hour[own[0]]), int(hour[own[-1]])
        if end + gap >= until:
            first, last = (start if first is None else first), end
            continue
        after = end
        p, n = precip[own[0] : own[-1] + 1], end - start + 1
        total = float(p.sum())
        if round(total, 6) < least_sum:
            continue
        mean = total / n
        spread = float(((p - mean) ** 2).sum()) + (n - len(p)) * mean**2  # hours that never arrive are dry
        back = start - hour
        past = (back >= 1) & (back <= API_HOURS)
        api = float((precip[past] * API_DECAY ** ((back[past] - 1) / 24)).sum())
        rows.append((start, end, n, total, float(p.max()), mean, (spread / (n - 1)) ** 0.5 if n > 1 else None, api, int(hour[own[0] + p.argmax()])))
    return rows, after, first, last


_CLOSED = ["start", "end", "duration", "p_sum", "i_max", "i_mean", "i_sd", "api", "top"]


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One cell: takes new hours in, gives closed events out, and keeps the hours that a later event can still look back to."""
    hours, values, after = ([], [], -(1 << 40)) if not state.exists else state.get
    known = dict(zip(hours, values, strict=True))
    for rows in batches:  # an hour that comes again replaces what was known
        known.update(zip(rows["hour"].tolist(), rows["precip"].tolist(), strict=True))
    hour = np.array(sorted(known), np.int64)
    precip = np.array([known[h] for h in hour.tolist()], np.float64)
    until = state.getCurrentWatermarkMs() / HOUR_MS
    closed, after, first, last = events_of_hours(hour, precip, after, until)
    least = min(until, first if first is not None else until) - API_HOURS
    keep = hour >= least
    hour, precip = hour[keep], precip[keep]
    if len(hour):
        state.update((hour.tolist(), precip.tolist(), after))
        # again when the open event can be closed, or else when the last hour is out of every later event's sight
        again = last + GAP_HOURS + 1 if last is not None else int(hour[-1]) + API_HOURS + 1
        state.setTimeoutTimestamp(max(again * HOUR_MS, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    if closed:
        out = pd.DataFrame(closed, columns=_CLOSED).astype({"i_sd": "float64"})
        out.insert(0, "cid", key[0])
        yield out


def full_stream_events(hours: DataFrame, late: str = "2 days") -> DataFrame:
    """All characteristics (but ranks) of the events that the watermark has closed, from a stream of (cid, time, precip).

    Each cell's state is its rainy hours: those of what is open, and the 720 hours before it. It is asked again when the watermark can close
    what is open, and goes when its last hour is out of sight. Rows behind the watermark are dropped; dry hours needn't arrive.
    The work and state of a cell are bounded by its hours between the watermark and the newest one, and 720 more.
    """
    rows = hours.filter("precip > 0").withColumn("time", instant(F.col("time"))).withWatermark("time", late)
    rows = rows.select("cid", "time", F.floor(F.unix_seconds("time") / 3600).alias("hour"), "precip")
    kind = "cid int, start bigint, end bigint, duration bigint, p_sum double, i_max double, i_mean double, i_sd double, api double, top bigint"
    state = "hours array<bigint>, precip array<double>, after bigint"
    found = rows.groupBy("cid").applyInPandasWithState(_advance, kind, state, "append", GroupStateTimeout.EventTimeTimeout)
    time = lambda c: moment(F.col(c) * 3600)
    rounded = [F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("p_sum", "i_max", "i_mean", "i_sd", "api")]
    return found.select("cid", time("start").alias("e_start"), time("end").alias("e_end"), F.col("duration").cast("int").alias("duration"), *rounded, time("top").alias("i_max_date"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes all that is there, and stops: the sink is Parquet, the state is in the checkpoint folder."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
