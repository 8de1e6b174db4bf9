"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the leading bits of each document's hash. A bucket whose bytes exceed the limit,
and only such a bucket, splits on one more bit, until every shard fits. Directory work never touches
documents again: one scan sums bytes per fine cell (a hash prefix a few bits deeper than the average shard
needs), every coarser bucket is a sum of cells, and cells that are still too large are refined by another
scan of just their documents. A shard is the shortest prefix that fits, so shards differ in depth.

The hash covers ``doc_id`` and the text, so rows of one hot key spread. Rows that are equal in both can't be
told apart by any bit; a bucket of only such rows that is over the limit gets overflow pages, filled within
each input partition. One document larger than the limit is a shard of its own.

Defined cases: null text has 0 bytes; a null doc_id counts as the empty text; an empty table gives no rows;
repeated rows are placed row by row; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

#: Bits of the hash: the first 15 hexadecimal digits of an MD5 digest, a non-negative number.
BITS = 60

#: How many bits the first cells are deeper than shards of average size need.
FINER = 4


def hashed(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def _cells(rows: DataFrame, depth: int) -> DataFrame:
    return rows.groupBy(prefix(F.col("h"), depth).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")
    )


def _leaves(cells: DataFrame, over: int, depth: int, limit: int) -> DataFrame:
    """Each cell with the shallowest bucket deeper than ``over`` bits that fits; ``leaf_depth`` is null where none does.

    A bucket fits if its bytes do, or if all its rows have one hash.
    """
    levels = F.explode(F.sequence(F.lit(over + 1), F.lit(depth))).alias("leaf_depth")
    spread = cells.select("*", levels).withColumn("leaf", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("leaf_depth")))
    buckets = spread.groupBy("leaf_depth", "leaf").agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    fits = buckets.filter((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high")))
    first = spread.select("cell", "leaf_depth", "leaf").join(fits.drop("low", "high"), ["leaf_depth", "leaf"]).groupBy("cell").agg(
        F.min(F.struct("leaf_depth", "leaf", "shard_bytes", "shard_docs")).alias("b")
    )
    return cells.select("cell").join(first, "cell", "left").select("cell", "b.*")


def extendible_shards(docs: DataFrame, limit: int = 16 << 20) -> tuple[DataFrame, str]:
    """``docs`` with one more column (its name is returned too): struct shard, depth, n_bytes, shard_bytes, shard_docs.

    ``shard`` is the bucket's hash prefix in binary digits, with ``.partition.page`` behind it for overflow pages;
    ``shard_bytes`` and ``shard_docs`` are those of the bucket.
    """
    name = fresh(docs, "shard")
    h, size = f"{name}h", f"{name}bytes"
    keyed = docs.withColumns({h: hashed(F.col("doc_id"), F.col("text")), size: F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    rows = keyed.select(F.col(h).alias("h"), F.col(size).alias("bytes"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    over, depth = -1, min(BITS, math.ceil(math.log2(max(1, total / limit))) + FINER)
    left, out, levels = rows, keyed, []
    while True:
        found = stored(_leaves(_cells(left, depth), over, depth, limit))
        levels.append((depth, found))
        open_cells = found.filter("leaf_depth IS NULL").select("cell")
        if depth == BITS or open_cells.isEmpty():
            break
        left = left.withColumn("cell", prefix(F.col("h"), depth)).join(open_cells, "cell", "left_semi").drop("cell")
        over, depth = depth, min(BITS, depth + 8)
    chosen = []
    for k, (depth, found) in enumerate(levels):
        cell, leaf = f"{name}cell{k}", f"{name}leaf{k}"
        side = found.select(F.col("cell").alias(cell), F.struct("leaf_depth", "leaf", "shard_bytes", "shard_docs").alias(leaf))
        out = out.withColumn(cell, prefix(F.col(h), depth)).join(side, cell, "left").drop(cell)
        chosen.append(leaf)
    pick = F.coalesce(*[F.when(F.col(c)["leaf_depth"].isNotNull(), F.col(c)) for c in chosen])
    out = out.withColumn(f"{name}b", pick).drop(*chosen)
    bucket = F.col(f"{name}b")
    digits = F.call_function("lpad", F.bin(bucket["leaf"]), bucket["leaf_depth"], F.lit("0"))
    paged = any(not f.filter((F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)).isEmpty() for _, f in levels)
    if paged:
        part = F.shiftright(F.monotonically_increasing_id(), 33)
        crowded = (bucket["shard_bytes"] > limit) & (bucket["shard_docs"] > 1)
        page, at = f"{name}page", f"{name}part"
        out = out.withColumn(at, part)
        nth = F.row_number().over(Window.partitionBy(h, at).orderBy(h)) - 1
        few = out.filter(crowded).withColumn(page, F.floor(nth / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col(size)))))
        rest = out.filter(~crowded).withColumn(page, F.lit(None).cast("long"))
        out = few.unionByName(rest)
        digits = F.concat(digits, F.when(crowded, F.concat(F.lit("."), F.col(at), F.lit("."), F.col(page))).otherwise(F.lit("")))
    result = F.struct(
        digits.alias("shard"), bucket["leaf_depth"].alias("depth"), F.col(size).alias("n_bytes"), bucket["shard_bytes"].alias("shard_bytes"), bucket["shard_docs"].alias("shard_docs")
    )
    return out.withColumn(name, result).select(*docs.columns, name), name


def write_shards(docs: DataFrame, path: str, limit: int = 16 << 20) -> None:
    """Writes the documents as Parquet, one folder per shard; a task holds whole shards, each below the limit."""
    out, name = extendible_shards(docs, limit)
    by = fresh(out, "dir")
    out.withColumn(by, F.col(name)["shard"]).drop(name).repartition(by).write.partitionBy(by).parquet(path)
