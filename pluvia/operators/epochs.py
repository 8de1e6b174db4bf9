"""Epochs of batches in another random order each, without sorting rows anew for an epoch.

Rows get numbers from 0 on, once: counts per hash bucket give each bucket's first number, and rows are numbered within their
bucket. An epoch's order is a keyed permutation of the numbers, worked out for each row on its own: a Feistel network over a x b places,
where a and b are about the root of the number of rows; a place beyond the rows is permuted again until it is one of them (cycle
walking). The same key and epoch always give the same order, in whatever task and however often a row is worked on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, ROUNDS, WALKS = 4096, 6, 64


def numbered(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``number``: 0 to n - 1 in order of a hash bucket and ``key``, which no two rows share.

    One shuffle by bucket; the running sum is over the buckets' counts only.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    full = rows.withColumn("bucket", bucket)
    counts = full.groupBy("bucket").agg(F.count("*").alias("own"))
    first = counts.select("bucket", (F.sum("own").over(Window.orderBy("bucket")) - F.col("own")).alias("first"))  # at most ``buckets`` rows
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(key)) - 1
    return full.withColumn("place", place).join(F.broadcast(first), "bucket").withColumn("number", F.col("first") + F.col("place")).drop("bucket", "place", "first")


def permuted(number: Column, n: int, epoch: Column, seed: int = 0, rounds: int = ROUNDS) -> Column:
    """A permutation of 0 to n - 1, another one for each epoch and seed."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def moved(k: int):
        """Round ``k``: one half moves by a hash of the other, which can be taken back."""
        shift = lambda other, m: F.pmod(F.xxhash64(other, epoch, F.lit(seed), F.lit(k)), F.lit(m))
        if k % 2:
            return lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + shift(s["l"], b), F.lit(b)).alias("r"))
        return lambda s: F.struct(F.pmod(s["l"] + shift(s["r"], a), F.lit(a)).alias("l"), s["r"].alias("r"))

    def once(x: Column) -> Column:
        state = F.array(F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r")))
        for k in range(rounds):
            state = F.transform(state, moved(k))
        return F.transform(state, lambda s: s["l"] * b + s["r"])[0]

    walks = min(a * b - n + 1, WALKS)  # a walk passes each place beyond the rows once at most; one step stays there with chance 1 / a
    found = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), F.lit(-1).cast("long"), lambda x, _: F.when((x >= 0) & (x < n), x).otherwise(once(F.when(x < 0, number).otherwise(x))))
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("a walk didn't end")).cast("long"))


def epoch_batches(rows: DataFrame, key: str, batch: int, epochs: int, seed: int = 0) -> DataFrame:
    """Every row once in each epoch, with ``epoch``, ``batch`` (all but an epoch's last one have ``batch`` rows) and ``place`` in it.

    ``rows`` should be a written table: they are counted first. An empty table gives no rows.
    """
    n = rows.count()
    full = numbered(rows, key).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    at = permuted(F.col("number"), n, F.col("epoch"), seed) if n else F.lit(0).cast("long")
    return full.withColumn("at", at).withColumns({"batch": F.floor(F.col("at") / batch), "place": F.col("at") % batch}).drop("at", "number")
