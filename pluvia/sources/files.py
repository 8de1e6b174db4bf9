"""Reading and writing: Parquet and CSV tables, facts in file names, one series per cell."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


#: Folders made in the innermost scope of this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, below ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pluvia-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (made := _SCOPE.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Removes at its end all intermediate tables made inside by this thread, but for results stored by the function that it gives.

    Rows that are read later must be kept that way, or come from outside. Tables kept in an inner scope belong to the one around it.
    """
    outer, made = _SCOPE.get(), []

    def keep(rows: DataFrame, name: str = "result") -> DataFrame:
        out = stored(rows, name)
        path = made.pop()
        if outer is not None:
            outer.append(path)
        return out

    token = _SCOPE.set(made)
    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        for x in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows written once to the shared folder, for plans that read them again and again."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_static_attributes(spark: SparkSession, path: str, schema: str, wanted: list[str]) -> DataFrame:
    """One attribute class from CSV with a header: the key and the wanted columns only."""
    return spark.read.schema(schema).option("header", True).csv(path).select("cid", *wanted)


def file_facts(name: Column) -> dict[str, Column]:
    """``tag`` and ``date`` of a source file called ``<tag>_<yyyymmdd>.<ending>``, or in a folder of that name."""
    return {"tag": F.regexp_extract(name, r"([A-Za-z]+)_\d{8}", 1), "date": F.to_date(F.regexp_extract(name, r"_(\d{8})", 1), "yyyyMMdd")}


def read_with_source(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files with the path of each row's file, and the tag and date in it."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file")).withColumns(file_facts(F.col("file")))


def write_events(events: DataFrame, path: str) -> None:
    """All parts in one distributed write, each cell's events together and in order."""
    events.repartition("cid").sortWithinPartitions("cid", "e_start").write.mode("overwrite").parquet(path)


def write_checked(events: DataFrame, path: str, checks: dict[str, Column]) -> dict[str, int]:
    """Writes as ``write_events`` does, and counts in the same job: all rows, repeated starts of a cell, and rows that each check is true for.

    Rows are sorted by cell and start for the table anyway, so a repeated start stands next to its like. A job that runs anew after a
    failure doesn't count twice. Offending rows need a scan only if a count says so.
    """
    before = F.lag("e_start").over(Window.partitionBy("cid").orderBy("e_start"))
    flags = {"__duplicate_times": before == F.col("e_start"), **{f"__{k}": c for k, c in checks.items()}}
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c.removeprefix("__")) for c in flags]]
    rows = events.repartition("cid").withColumns(flags).observe(seen, *counts).drop(*flags)
    rows.sortWithinPartitions("cid", "e_start").write.mode("overwrite").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_series_per_cell(precip: DataFrame, path: str, first: int, last: int) -> None:
    """One folder per cell of a range, its hours in order."""
    chosen = precip.filter(F.col("cid").between(first, last)).repartition("cid").sortWithinPartitions("cid", "time")
    chosen.write.mode("overwrite").partitionBy("cid").parquet(path)


#: Model names by the part of a score file's name that gives them away, in the order of the charts.
MODELS = [("thr", "thresholds"), ("lr", "logistic"), ("rf", "forest"), ("cnn", "cnn"), ("tx", "transformer"), ("random", "random"), ("always", "constant")]


def model_of_file(name: Column) -> Column:
    found = F.lit("unknown")
    for part, model in reversed(MODELS):
        found = F.when(name.contains(part), model).otherwise(found)
    return found


def read_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All score files below a folder, without the files of options, with the model that each file is of."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    name = F.col("_metadata.file_name")
    return rows.select("*", name.alias("file")).filter(~F.col("file").endswith("_options.csv")).withColumn("model", model_of_file(F.col("file")))
