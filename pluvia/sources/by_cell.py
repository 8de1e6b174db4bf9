"""Tables stored in buckets of cells, so that joins and windows by cell need no shuffle.

A table by cell has two parts. Rows of most cells are one bucketed table: all of a cell's rows are in the file of its
bucket, and two tables with the same number of buckets meet bucket by bucket. Rows of hot cells, those with more than a
share of all rows, stand in a plain table: one bucket could not be split among tasks, while a shuffle by cell and day, or
by cell and event, can spread them. There are at most 1 / share such cells. Whatever is done cell by cell gives the same
rows on both parts one after the other as on the whole.

Files go below the shared checkpoint folder and survive lost executors. Spark keeps buckets in its catalog; the entry is
needed while a table is opened, and is dropped right after it, which leaves the files.

Defined cases: an empty table has no hot cells and empty parts; rows without a cell (null) are never hot and share one
bucket; rows that repeat stay repeated; a cell is hot in all tables that get the same ``hot`` cells, or in none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: A cell with more than this share of a table's rows is hot, so there are fewer than 200 hot cells.
HOT_SHARE = 0.005

#: Tables in buckets of the cell also serve joins by the cell and something else (a day, an event, a year).
JOINS_BY_PART_OF_KEY = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@dataclass(frozen=True)
class CellTable:
    """Both parts of a table by cell: ``cold`` in buckets, ``hot`` as plain files."""

    cold: DataFrame
    hot: DataFrame

    def rows(self) -> DataFrame:
        return self.cold.unionByName(self.hot)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs inside; afterwards the caller's own are back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def hot_cells(rows: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """(cid) of cells with more than a share of all rows, written once: fewer than 1 / share rows."""
    counts = rows.filter("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    found = counts.join(F.broadcast(total)).filter(F.col("n") > share * F.col("total"))  # one row
    return files.stored(found.select("cid"), "hot")


def store(rows: DataFrame, name: str, hot: DataFrame, buckets: int, order: list[str] | None = None) -> CellTable:
    """``rows`` written as a table by cell; cells of ``hot`` apart. ``order``: sorting within a bucket, after the cell.

    Rows are dealt to tasks by the hash that buckets have, so each task writes one file.
    """
    spark, path = rows.sparkSession, files.scratch(rows.sparkSession, name)
    bounded = F.broadcast(hot)  # fewer than 1 / share rows
    table = f"by_cell_{path.rsplit('-', 1)[1]}"
    cold = rows.join(bounded, "cid", "left_anti").select(*rows.columns).repartition(buckets, "cid")
    cold.write.format("parquet").option("path", path).bucketBy(buckets, "cid").sortBy("cid", *(order or [])).saveAsTable(table)
    opened = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return CellTable(opened, files.stored(rows.join(bounded, "cid", "left_semi").select(*rows.columns), f"{name}-hot"))


def apply(work: Callable[..., DataFrame], *tables: CellTable) -> DataFrame:
    """What ``work`` makes of the cold parts together with what it makes of the hot parts, written once.

    ``work`` must treat each cell alone: join by the cell (and more), group and rank within cells.
    """
    cold, hot = work(*[t.cold for t in tables]), work(*[t.hot for t in tables])
    spark = cold.sparkSession
    with settings(spark, JOINS_BY_PART_OF_KEY):
        first = files.stored(cold, "cold")
    return first.unionByName(files.stored(hot, "hot-result"))


def apply_and_keep(work: Callable[..., DataFrame], name: str, buckets: int, *tables: CellTable) -> CellTable:
    """As ``apply``, with the result as a table by cell: its cold part stays in the buckets it was made in."""
    spark = tables[0].cold.sparkSession
    none = spark.createDataFrame([], f"cid {dict(tables[0].cold.dtypes)['cid']}")
    with settings(spark, JOINS_BY_PART_OF_KEY):
        cold = store(work(*[t.cold for t in tables]), name, none, buckets).cold
    return CellTable(cold, files.stored(work(*[t.hot for t in tables]), f"{name}-hot"))
