"""Importance resampling of raw text toward a target, by hashed n-gram models and Gumbel top-k.

Words and word pairs are hashed into ``buckets``; a bag-of-buckets model of the target text and one of all raw
text give each document the log of its importance weight, log p_target - log p_raw, and the ``k`` largest
sums of log weight and Gumbel noise are a sample without replacement in proportion to the weights. The noise
is a hash of doc_id and seed, so that a lost task draws the same again.

The raw model counts every document. The target model learns from at most ``target_rows`` target ids, those
with the smallest hashes: a documented bound, so that the ids can be sent to every task. Ranks come from a
range sort with one count per range; no task holds all rows.

Defined cases: null text has no n-gram and weight 0 (log); without target rows all weights are 0; equal keys
are ordered by doc_id; repeated rows draw equal noise and count as rows; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fresh, stored, texts

BUCKETS = 1 << 14
TARGET_ROWS = 20_000


def features(text: bytes, buckets: int) -> np.ndarray:
    """Bucket of each word and each pair of neighbouring words."""
    words = text.translate(LOWER).split()
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, target_ids: list, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all buckets in all text and in the target's; each task sends its sums once."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(target_ids))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = np.bincount(features(x, buckets), minlength=buckets) if x else 0
                sums[0] += own
                if key in shared.value:
                    sums[1] += own
        yield pa.record_batch([pa.array(np.arange(buckets)), pa.array(sums[0]), pa.array(sums[1])], names=["bucket", "raw", "target"])

    out = docs.select("doc_id", "text").mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    found = out.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = np.asarray(found["bucket"])
    raw[at], target[at] = np.asarray(found["raw"]), np.asarray(found["target"])
    return raw, target


def log_weights(docs: DataFrame, ratio: np.ndarray) -> tuple[DataFrame, str]:
    """``docs`` with one more column (its name is returned too): the log of each text's importance weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    name = fresh(docs, "weight")

    @F.arrow_udf("double")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([float(shared.value[features(x, len(shared.value))].sum()) for x in texts(batch)], pa.float64())

    return docs.withColumn(name, weigh("text")), name


def resample(docs: DataFrame, target: DataFrame, fraction: float = 0.5, seed: int = 7, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, log_weight, gumbel_key, rank (1: the largest key) and selected (rank within fraction) of every document.

    ``target`` holds the doc_ids of target documents.
    """
    ids = target.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    raw, wanted = bucket_counts(docs, [r[0] for r in ids.collect()], buckets)
    model = lambda n: np.log((n + 1) / (n.sum() + buckets))
    ratio = model(wanted) - model(raw) if wanted.any() else np.zeros(buckets)
    out, name = log_weights(docs.select("doc_id", "text"), ratio)
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    rows = stored(out.select("doc_id", F.col(name).alias("log_weight"), (F.col(name) - F.log(-F.log(uniform))).alias("gumbel_key")))
    key = [F.desc("gumbel_key"), F.asc("doc_id")]
    dealt = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    front = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, log_weight double, gumbel_key double"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.record_batch([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen + 1, seen + n + 1))], names=[*b.schema.names, "part", "place"])
            seen += n

    numbered = stored(dealt.mapInArrow(number, f"{front}, part int, place bigint"))
    sizes = numbered.groupBy("part").count().orderBy("part").collect()  # one row per range
    before, total = {}, 0
    for r in sizes:
        before[r["part"]] = total
        total += r["count"]
    offset = F.create_map(*[x for p, n in before.items() for x in (F.lit(p), F.lit(n))])[F.col("part")] if before else F.lit(0)
    rank = F.col("place") + offset
    return numbered.select("doc_id", "log_weight", "gumbel_key", rank.cast("long").alias("rank"), (rank <= int(fraction * total)).alias("selected"))
