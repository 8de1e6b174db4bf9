"""Small inputs with results worked out by hand or by NumPy."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pluvia.functions.expressions import percentile_rank
from pluvia.functions.scores import NAMES, score
from pluvia.operators import claims, events, grid, linking, samples

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


@pytest.fixture(scope="module")
def precip(spark):
    wet = {0: 0.05, 1: 4.0, 3: 6.5, 11: 2.0, 20: 12.0, 21: 1.0, 35: 3.0}
    return spark.createDataFrame([(1, at(h), wet.get(h, 0.0)) for h in range(40)], "cid int, time timestamp_ntz, precip double")


def test_events_of_one_cell(precip):
    rows = events.extract_events(precip).orderBy("e_start").collect()
    got = [(r.e_start, r.e_end, r.duration, r.p_sum, r.i_max, r.i_max_date, r.i_mean, r.i_sd, r.api) for r in rows]
    assert got == [
        (at(1), at(11), 11, 12.5, 6.5, at(3), 1.13636, pytest.approx(2.19193, abs=1e-5), 0.05),
        (at(20), at(21), 2, 13.0, 12.0, at(20), 6.5, pytest.approx(7.77817, abs=1e-5), pytest.approx(10.88366, abs=1e-5)),
    ]
    assert [(r.duration_q, r.p_sum_q) for r in rows] == [(1.0, 0.5), (0.5, 1.0)]


def test_events_are_apart_and_keep_the_rain(precip):
    hours = events.sessionise(precip)
    assert hours.agg(F.sum("precip")).first()[0] <= precip.agg(F.sum("precip")).first()[0]
    assert [r.gid for r in hours.select("gid").distinct().orderBy("gid").collect()] == [1, 2, 3]


def test_percentile_rank(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 4.0), (1, None)], "g int, v double")
    got = sorted((r.v, r.q) for r in rows.withColumn("q", percentile_rank("v", "g")).collect() if r.v)
    assert got == [(1.0, 0.25), (2.0, 0.625), (2.0, 0.625), (4.0, 1.0)]


EVENTS = [
    (1, 1, datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 12), 3, 5.0, 9.0, 15.0),
    (2, 1, datetime(2024, 1, 3, 14), datetime(2024, 1, 3, 18), 5, 3.0, 7.0, 15.0),
    (3, 1, datetime(2024, 1, 4, 20), datetime(2024, 1, 6, 2), 31, 1.0, 9.0, 31.0),
]
EVENT_SCHEMA = "eid bigint, cid int, e_start timestamp_ntz, e_end timestamp_ntz, duration int, i_mean double, i_max double, p_sum double"


@pytest.mark.parametrize("join", [linking.candidates, linking.candidates_by_day])
def test_linking_one_claim(spark, join):
    rain = spark.createDataFrame(EVENTS, EVENT_SCHEMA)
    claim = spark.createDataFrame([(date(2024, 1, 3), 1, 2), (date(2023, 6, 1), 1, 1)], "date_claim date, cid int, selection int")
    pairs = join(claim, rain)
    ranked = linking.ranked_candidates(pairs)
    got = {r.eid: (r.min_window, r.score) for r in ranked.collect()}
    assert got == {1: (5, 4), 2: (1, 10), 3: (3, 6)}
    assert [(r.eid, r.e_search_window, r.e_match_score) for r in linking.linked_claims(ranked).collect()] == [(2, 1, 10)]
    assert sorted(r.eid for r in linking.losers(ranked).collect()) == [1, 3]
    stats = linking.link_stats(claim, ranked).first().asDict()
    assert stats == {"none": 1, "single": 0, "two": 0, "three": 1, "multiple": 0, "conflicts": 0, "unresolved": 0}


def test_even_windows_end_with_the_claims_day(spark):
    row = spark.sql("SELECT DATE'2024-01-10' AS d").select(linking.window_start(F.col("d"), 4).alias("a"), linking.window_end(F.col("d"), 4).alias("b")).first()
    assert (row.a, row.b) == (datetime(2024, 1, 8), datetime(2024, 1, 12))


def scores_of(spark, tp, tn, fp, fn):
    counts = spark.createDataFrame([(tp, tn, fp, fn)], "tp long, tn long, fp long, fn long")
    return counts.select(*[score(n, *[F.col(c) for c in ("tp", "tn", "fp", "fn")]).alias(n) for n in NAMES]).first().asDict()


def test_scores(spark):
    got = scores_of(spark, 30, 900, 50, 20)
    want = {"hit_rate": 0.6, "false_alarm_rate": 0.052632, "critical_success_index": 0.3, "bias": 1.6, "gilbert": 0.270833, "heidke": 0.42623, "sedi": 0.744717, "seds": 0.57461, "edi": 0.70432, "f1": 0.461538}
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-5)
    none = scores_of(spark, 0, 900, 50, 0)
    assert all(v != v for v in none.values())
    missed = scores_of(spark, 0, 900, 50, 20)
    assert (missed["sedi"], missed["seds"], missed["edi"]) == (0, 0, 0)
    silent = scores_of(spark, 0, 900, 0, 20)
    assert silent["false_alarm_ratio"] == 0 and silent["precision"] != silent["precision"]


def test_class_weights(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 50, 1).otherwise(0).alias("target"))
    got = {r.label: r.weight for r in samples.class_weights(rows, denominator=10).collect()}
    assert got == {0: pytest.approx(0.526316, abs=1e-6), 1: pytest.approx(1.0)}


def test_zonal_fractions(spark):
    pixels = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, None)], "cid int, class int")
    assert grid.zonal_fractions(pixels, [1, 2]).first().asDict() == {"cid": 1, "cat_1": 0.5, "cat_2": 0.25}


def test_zonal_stats_skip_what_is_not_data(spark):
    pixels = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, -9999.0), (1, None), (2, None)], "cid int, value double")
    assert [r.asDict() for r in grid.zonal_stats(pixels).collect()] == [{"cid": 1, "min": 2.0, "max": 4.0, "mean": 3.0, "sd": 1.0, "median": 3.0}]


def test_splits_keep_dates_together(spark):
    rows = spark.range(4000).select(F.col("id").alias("eid"), F.expr("TIMESTAMP_NTZ'2024-01-01' + make_interval(0,0,0,0,int(id % 400))").alias("ref_date"), F.when(F.col("id") % 40 == 0, 1).otherwise(0).alias("target"))
    parts = samples.split_by_date(rows)
    assert parts.groupBy("ref_date").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    sizes = {r.split: r["count"] for r in parts.groupBy("split").count().collect()}
    assert sizes["train"] == 2800 and abs(sizes["valid"] - 600) <= 40
    less = samples.downsampled(parts, 4)
    negatives = parts.filter("split = 'train' AND target = 0").count()
    assert less.filter("split = 'train' AND target = 0").count() == negatives // 4 and less.filter("target = 1").count() == 100


def test_smoothing_at_the_edges(spark):
    cells = spark.createDataFrame([(i + 1, 1000.0 * (i % 3) + 500, 1000.0 * (i // 3) + 500) for i in range(9)], "cid int, x double, y double")
    rain = cells.select("cid", F.lit(T0).cast("timestamp_ntz").alias("time"), F.when(F.col("cid") == 1, 9.0).otherwise(0.0).alias("precip"))
    got = {r.cid: r.precip for r in grid.smooth(rain, cells).collect()}
    assert got == {1: 4.0, 2: 2.0, 3: 0.0, 4: 2.0, 5: 1.0, 6: 0.0, 7: 0.0, 8: 0.0, 9: 0.0}


def test_gaps_are_filled_between_known_hours(spark):
    rows = spark.createDataFrame([(1, at(2), 1.0), (1, at(6), 3.0)], "cid int, time timestamp_ntz, precip double")
    got = {r.time: r.precip for r in grid.fill_gaps(rows).collect()}
    assert len(got) == 31 * 24 and got[at(1)] == 0 and got[at(4)] == 2.0 and got[at(7)] == 0


def test_categories_of_types(spark):
    dim = spark.createDataFrame(claims.CATEGORY_ROWS, claims.CATEGORY_COLUMNS)
    names = lambda *types: {r.category for r in claims.categories_of_types(dim, list(types)).collect()}
    assert names("sme", "external", "pluvial") == {"sme_ext_cont_pluv", "sme_ext_struc_pluv"}
    assert names("internal", "private", "content") == {"priv_int_cont"}
    with pytest.raises(ValueError):
        claims.categories_of_types(dim, ["nonsense"])
    with pytest.raises(ValueError):
        grid.chosen_features(["unknown:x"])
    assert grid.chosen_features(["customer", "part:p_size"]) == {"customer": ["c_acctbal", "seg_building"], "part": ["p_size"]}
