"""Registered queries against their SQL, on the smallest given tables."""

import os
from datetime import datetime

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from pluvia import registry
from pluvia.adapters import Domain
from pluvia.functions.expressions import hour_start, instant, moment, seconds

DATA = "/root/testdata/sf0.001"
ZONE = "spark.sql.session.timeZone"


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return db


@pytest.fixture(scope="module")
def domain(spark):
    """One set of domain tables for all queries, in a zone that isn't UTC: results must not depend on the session's zone."""
    spark.conf.set(ZONE, "Asia/Kolkata")
    yield Domain(spark, DATA)
    spark.conf.set(ZONE, "UTC")


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00")
    return sorted(tuple(map(str, map(plain, r))) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query_equals_sql(spark, domain, sql, name):
    before = dict(spark.conf.getAll)
    got = registry.ON_DOMAIN[name](domain).toArrow().to_pandas()
    assert rows(got) == rows(sql.sql(registry.ORACLES[name]).df())
    assert dict(spark.conf.getAll) == before  # the caller's settings stay


@pytest.mark.parametrize("zone", ["UTC", "Europe/Zurich", "America/New_York"])
def test_times_without_zone_in_any_zone(spark, zone):
    """Hours that a zone skips or has twice are hours like others."""
    texts = ["2024-03-31 02:30:15", "2024-10-27 02:59:59", "2024-03-10 02:00:00", "1969-12-31 23:59:58", "2050-07-01 00:00:00"]
    before = spark.conf.get(ZONE)
    spark.conf.set(ZONE, zone)
    try:
        time = F.col("t").cast("timestamp_ntz")
        parts = [seconds(time), moment(seconds(time)), hour_start(time), moment(F.unix_seconds(instant(time)))]
        got = spark.createDataFrame([(x,) for x in texts], "t string").select(*[p.alias(f"c{i}") for i, p in enumerate(parts)]).collect()
    finally:
        spark.conf.set(ZONE, before)
    for row, text in zip(got, texts, strict=True):
        true = datetime.fromisoformat(text)
        assert tuple(row) == (int((true - datetime(1970, 1, 1)).total_seconds()), true, true.replace(minute=0, second=0), true)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(registry.QUERIES) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
