"""Shared helpers of the training-data operators: tables, scratch storage, words, ranks.

Everything here is written for executors that can be lost at any time: what a later job reads again
is a Parquet table below ``spark.checkpoint.dir``, never a block kept by one executor.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters A-Z become a-z; every other byte stays (UTF-8 multi-byte sequences hold no ASCII bytes).
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Words of text that was lower-cased by ``LOWER`` are the runs between the six ASCII blanks 0x20, 0x09-0x0D;
#: ``bytes.split()`` without an argument splits on exactly those.


#: Rows of a batch between Spark and Python: texts of a few kB make a few MB, which bounds what a worker holds.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def release() -> None:
    """Gives a worker's free memory back to the system when its task ends; Spark keeps workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given Parquet table, by a path that only Spark's readers need to open."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder (a temporary one only in local mode, where none is set)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="pluvia-"))
    return f"{root.rstrip('/')}/pluvia-{uuid.uuid4().hex}"


_LOCAL: dict[str, str] = {}
#: Tables stored in the innermost scope of this thread, so that threads don't remove each other's.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: cuts lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession)
    if (own := _SCOPE.get()) is not None:
        own.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes what is stored inside when it ends, but for tables stored by the function that it gives.

    Only what is kept may be read later. A scope holds for the thread that opened it; what other threads store stays.
    """
    outer, own = _SCOPE.get(), []

    def keep(df: DataFrame) -> DataFrame:
        out = stored(df)
        path = own.pop()
        if outer is not None:
            outer.append(path)
        return out

    token = _SCOPE.set(own)
    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path
        for x in own:
            path(x).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(x), True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (column names of inputs may clash with ours in any letter case)."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def repeats(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with one more column: whether the row repeats the doc_id and text of another row that counts."""
    key = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    if key.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        return docs.withColumn(name, F.lit(False))
    row = fresh(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))  # written, so that numbers are fixed
    first = numbered.groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.min(row).alias(f"{row}kept")).select(f"{row}kept")
    out = numbered.join(first, F.col(row) == F.col(f"{row}kept"), "left")
    return out.select(*[f"`{c}`" for c in docs.columns], F.col(f"{row}kept").isNull().alias(name))


def texts(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string array; null is the empty text."""
    return [b"" if x is None else x for x in array.cast(pa.binary()).to_pylist()]


def slices(items: list[bytes], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``most`` bytes (one text at least), to bound array sizes."""
    begin = size = 0
    for i, x in enumerate(items):
        if size and size + len(x) > most:
            yield begin, i
            begin, size = i, 0
        size += len(x)
    if begin < len(items):
        yield begin, len(items)


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % by
