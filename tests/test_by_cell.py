"""Tables in buckets of cells: the same rows as plain tables, no shuffle by cell, hot cells apart."""

import pytest
from pyspark.sql import functions as F

from pluvia.adapters import Domain
from pluvia.operators import linking
from pluvia.plans import joins
from pluvia.sources import by_cell
from test_queries import DATA, rows, sql  # noqa: F401

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", **by_cell.JOINS_BY_PART_OF_KEY}


@pytest.fixture(scope="module")
def domain(spark):
    return Domain(spark, DATA)


@pytest.fixture(scope="module")
def stored_tables(domain):
    return joins.ranked_by_cell(domain)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def parts(tables, ranked):
    return [tables["events"], ranked, *[tables[k] for k in ("exposure", "customer", "part")]]


def test_no_exchange_by_cell(spark, stored_tables):
    tables, ranked = stored_tables
    with by_cell.settings(spark, NO_BROADCAST):
        links = linking.ranked_candidates(linking.candidates_by_day(tables["claims"].cold, tables["events"].cold))
        features = joins.features_of_cells(*[t.cold for t in parts(tables, ranked)])
        assert "Exchange" not in plan(links)
        assert "Exchange" not in plan(features)
        plain = joins.features_of_cells(*[t.cold.repartition(3) for t in parts(tables, ranked)])
        assert "Exchange hashpartitioning(cid" in plan(plain)
        assert rows(features.toPandas()) == rows(plain.toPandas())


def test_hot_cells_stand_apart(spark, domain, sql):  # noqa: F811
    """A third of all events in one cell: it is hot in all tables, and links and features are still those of the SQL."""
    n = domain.rain_events.groupBy("cid").count().orderBy(F.desc("count"), "cid").first()
    share = (n["count"] - 1) / domain.rain_events.count()
    hot = by_cell.hot_cells(domain.rain_events, share)
    assert n["cid"] in [r.cid for r in hot.collect()]
    store = lambda df, name: by_cell.store(df, name, hot, 3)
    events, claims, exposure, customer, part = (store(df, "t") for df in (domain.rain_events, domain.claims, domain.exposure, domain.static_a, domain.static_b))
    assert events.hot.filter(F.col("cid") == n["cid"]).count() == n["count"] and events.cold.filter(F.col("cid") == n["cid"]).isEmpty()
    assert not events.cold.isEmpty()
    ranked = by_cell.apply_and_keep(lambda c, e: linking.ranked_candidates(linking.candidates_by_day(c, e)), "ranked", 3, claims, events)
    assert not ranked.hot.isEmpty()
    got = by_cell.apply(joins.features_of_cells, events, ranked, exposure, customer, part)
    from pluvia import registry

    assert rows(got.toPandas()) == rows(sql.sql(registry.ORACLES["feature_table_by_cell"]).df())


def test_one_file_a_bucket_and_nothing_in_the_catalog(spark, stored_tables):
    tables, _ = stored_tables
    found = [f.rsplit("_", 1)[1].split(".")[0] for f in tables["events"].cold.inputFiles()]
    assert len(found) == len(set(found)) <= 4
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("by_cell")]


def test_null_cells_repeats_and_empty_tables(spark):
    data = spark.createDataFrame([(None, 1), (None, 1), (1, 2), (1, 2), (2, None), *[(7, k) for k in range(5)]], "cid int, v int")
    hot = by_cell.hot_cells(data, 0.3)
    assert [r.cid for r in hot.collect()] == [7]
    table = by_cell.store(data, "t", hot, 4)
    assert rows(table.rows().toPandas()) == rows(data.toPandas())
    assert table.cold.filter("cid IS NULL").count() == 2 and table.hot.count() == 5
    empty = data.limit(0)
    none = by_cell.store(empty, "t", by_cell.hot_cells(empty), 4)
    assert none.rows().isEmpty() and none.rows().columns == data.columns


def test_settings_come_back(spark):
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), by_cell.settings(spark, {key: "false", "spark.pluvia.unset": "1"}):
        assert spark.conf.get(key) == "false"
        1 / 0  # noqa: B018
    assert spark.conf.get(key) == before and spark.conf.get("spark.pluvia.unset", None) is None
