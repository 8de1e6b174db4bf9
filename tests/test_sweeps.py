"""Sweeps, block scans and tiles against brute force, on series with gaps, ties and holes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.operators import events, grid, linking

BEGIN = dt.datetime(2024, 1, 1)


def at(hour):
    return BEGIN + dt.timedelta(hours=int(hour))


def test_index_equals_the_sum_over_the_history(spark):
    """Hours missing, others 0; starts with and without rain before them, at a block's begin, and far behind all rain."""
    rng = np.random.default_rng(1)
    rain = {(c, int(h)): float(np.round(rng.exponential(4), 1)) for c in (1, 2) for h in rng.choice(3000, 500, replace=False)}
    starts = {(c, int(h)) for c in (1, 2, 3) for h in [*rng.choice(3200, 60, replace=False), 0, 1, 720, 1440, 2160, 3719, 9000]}
    precip = spark.createDataFrame([(c, at(h), p) for (c, h), p in rain.items()], "cid int, time timestamp_ntz, precip double")
    asked = spark.createDataFrame([(c, at(h)) for c, h in starts], "cid int, e_start timestamp_ntz")
    got = {(r["cid"], r["e_start"]): r["api"] for r in events.antecedent_index(asked.union(asked), precip).collect()}
    want = {(c, at(h)): sum(p * 0.8 ** ((h - s - 1) / 24) for (k, s), p in rain.items() if k == c and 1 <= h - s <= 720) for c, h in starts}
    assert got == pytest.approx(want, abs=1e-9) and max(got.values()) > 50


def disjoint(rng, cells, n):
    rows, eid = [], 0
    for c in range(1, cells + 1):
        ends = np.cumsum(rng.integers(0, 4, 2 * n)) + np.arange(2 * n)
        for a, b in ends.reshape(-1, 2):
            eid += 1
            rows.append((eid, c, at(a), at(b)))
    return rows


def test_sweep_finds_all_overlapping_pairs(spark):
    rng = np.random.default_rng(2)
    left, right = disjoint(rng, 4, 60), disjoint(rng, 4, 60)
    schema = "eid bigint, cid int, e_start timestamp_ntz, e_end timestamp_ntz"
    found = events.overlapping_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    want = {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] < b[3] and a[3] > b[2]}
    assert len(found) == len(want) > 100 and {tuple(r) for r in found} == want


def test_sweep_is_linear_on_a_long_history(spark):
    """One cell with 100,000 events on each side: each meets its neighbours only."""
    one = spark.range(100_000).select(F.col("id").alias("eid"), F.lit(1).alias("cid"), F.timestamp_seconds(F.col("id") * 36000).cast("timestamp_ntz").alias("e_start"), F.timestamp_seconds(F.col("id") * 36000 + 7200).cast("timestamp_ntz").alias("e_end"))
    two = one.withColumns({"e_start": F.expr("e_start + INTERVAL 1 HOUR"), "e_end": F.expr("e_end + INTERVAL 1 HOUR")})
    found = events.overlapping_pairs(one, two)
    assert found.count() == found.filter("left_eid = right_eid").count() == 100_000
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_sweep_finds_events_near_removed_claims(spark):
    rng = np.random.default_rng(3)
    rows = disjoint(rng, 3, 40)
    claims = [(c, (BEGIN + dt.timedelta(days=int(d))).date()) for c in (1, 2) for d in rng.integers(0, 30, 5)]
    kept = [(r[0],) for r in rows[::7]]
    got = linking.events_of_removed_claims(
        spark.createDataFrame(rows, "eid bigint, cid int, e_start timestamp_ntz, e_end timestamp_ntz"), spark.createDataFrame(claims, "cid int, date_claim date"), spark.createDataFrame(kept, "eid bigint")
    )
    near = lambda r, c: r[1] == c[0] and abs((r[2] + (r[3] - r[2]) / 2 - dt.datetime.combine(c[1], dt.time())).total_seconds()) <= 48 * 3600
    want = sorted(r[0] for r in rows if any(near(r, c) for c in claims) and (r[0],) not in kept)
    assert sorted(r["eid"] for r in got.collect()) == want and 0 < len(want) < len(rows)


@pytest.mark.parametrize(("size", "tile"), [(3, 2), (3, 16), (5, 4)])
def test_tiles_smooth_like_squares(spark, size, tile):
    """A grid with holes, whose coordinates begin below 0; hours that only some cells have; nulls."""
    rng = np.random.default_rng(4)
    places = [(i, j) for i in range(-3, 6) for j in range(2, 9) if rng.random() < 0.85]
    number = {p: k + 1 for k, p in enumerate(places)}
    cells = spark.createDataFrame([(k, 1000.0 * i + 500, 1000.0 * j + 500) for (i, j), k in number.items()], "cid int, x double, y double")
    rain = {(p, h): (None if rng.random() < 0.1 else float(rng.integers(0, 50))) for p in places for h in (1, 2, 300) if rng.random() < 0.7}
    rows = spark.createDataFrame([(number[p], at(h), v) for (p, h), v in rain.items()], "cid int, time timestamp_ntz, precip double")
    got = {(r["cid"], r["time"]): r["precip"] for r in grid.smooth(rows, cells, size, tile=tile).collect()}
    x, y, half, want = [p[0] for p in places], [p[1] for p in places], size // 2, {}
    for p in places:
        for h in (1, 2, 300):
            square = [(min(max(p[0] + i, min(x)), max(x)), min(max(p[1] + j, min(y)), max(y))) for i in range(-half, half + 1) for j in range(-half, half + 1)]
            if any((q, h) in rain for q in square):
                want[number[p], at(h)] = sum(rain.get((q, h)) or 0.0 for q in square) / size**2
    assert got == pytest.approx(want)


def test_events_of_rainy_hours_equal_those_of_the_full_series(spark):
    """Wet, faint and negative hours among dry ones: a table without the dry hours gives the same events and the same hours of each."""
    rng, n = np.random.default_rng(3), 900
    full = {}
    for c in range(6):
        p = np.where(rng.random(n) < 0.12, np.round(rng.exponential(5, n), 3), 0.0)
        p[rng.choice(n, 40, replace=False)] = 0.05
        p[rng.choice(n, 10, replace=False)] = -0.2
        full |= {(c, h): float(v) for h, v in enumerate(p)}
    full |= {(9, h): 0.0 for h in range(n)} | {(7, h): 12.0 * (h == 5) for h in range(n)}  # a dry cell, and an event of one hour
    table = lambda keep: spark.createDataFrame([(c, at(h), v) for (c, h), v in full.items() if keep(v)], "cid int, time timestamp_ntz, precip double")
    series, rain = table(lambda v: True), table(lambda v: v != 0)
    hours = lambda rows: sorted(map(tuple, rows.select("cid", "gid", "e_start", "e_end", "time", "precip").collect()))
    want = hours(events.sessionise(series))
    assert hours(events.with_dry_hours(events.sparse_sessions(rain))) == want == hours(events.with_dry_hours(events.sparse_sessions(series)))
    columns = ["cid", "e_start", "e_end", "duration", "p_sum", "i_max", "i_mean", "i_sd", "api", "i_max_date", *[f"{c}_q" for c in events.RANKED]]
    found = lambda rows: sorted(tuple(-1 if v is None else v for v in r) for r in rows.select(*columns).collect())
    want = found(events.extract_events(series))
    assert len(want) > 50 and any(r[3] == 1 for r in want)
    assert found(events.extract_events(rain, sparse=True)) == want == found(events.extract_events(series, sparse=True))


def test_events_are_made_without_the_calendar(spark):
    """The plans that events and their samples come from read rainy hours only, and no hour of the calendar for each cell."""
    from pluvia import registry
    from pluvia.adapters import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    d.__dict__["precip"] = None  # any use of the full series would fail
    for name in ("events", "i_max_date", "sessionise", "sample_cubes", "sample_series", "sample_series_padded", "precip_window_join", "drop_period_edges", "write_checked", "smoothing_stats"):
        assert registry.ON_DOMAIN[name](d).count() > 0
