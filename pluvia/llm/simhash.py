"""SimHash fingerprints of word shingles, and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, release, slices, stored, texts
from .components import components

SEED = 42
_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, n: int) -> list[int]:
    words = text.translate(LOWER).split()
    if len(words) < n:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document the 64 bits that over half of its hashes have; 0 without hashes.

    Bits are counted in eight byte lanes at a time, over stretches of at most 255 hashes so that no lane overflows.
    """
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    size = counts[some]
    begin = np.cumsum(size) - size
    parts = -(-size // 255)
    first = np.cumsum(parts) - parts
    at = np.repeat(begin - 255 * first, parts) + 255 * np.arange(parts.sum())
    bits = np.zeros(len(some), np.uint64)
    for s in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(s)) & _ONES, at).view(np.uint8).reshape(-1, 8)
        set_ = 2 * np.add.reduceat(lanes.astype(np.int64), first, axis=0) > size[:, None]
        for j in range(8):
            bits |= set_[:, j].astype(np.uint64) << np.uint64(8 * j + s)
    out[some] = bits
    return out


def fingerprint_udf(n: int):
    @F.arrow_udf("bigint")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            raw = texts(batch)
            found = [np.empty(0, np.uint64)]
            for a, b in slices(raw, 1_000_000):
                own = [shingle_hashes(x, n) for x in raw[a:b]]
                counts = np.array([len(x) for x in own], np.int64)
                flat = np.fromiter((h for x in own for h in x), np.uint64, counts.sum())
                found.append(majority(flat, counts))
            yield pa.array(np.concatenate(found).view(np.int64))
        release()

    return fingerprint


#: Members of one table bucket that a single task compares with up to as many probes, in memory.
BLOCK = 1024


def _ball(radius: int, bits: int) -> list[int]:
    """Masks with at most ``radius`` of ``bits`` bits."""
    masks = [0]
    for _ in range(radius):
        masks = sorted({m | 1 << b for m in masks for b in range(bits)} | {*masks})
    return masks


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _forest_udf(distance: int):
    """Links within ``distance`` between two blocks that join different labels, as few as do so."""
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def forest(members: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in members:
            out = []
            for xs, ys in zip(left, right, strict=True):
                (x, p), (y, q) = ([np.asarray(v.values.field(k)) for k in ("fp", "label")] for v in (xs, ys))
                _, group = np.unique(np.concatenate([p, q]), return_inverse=True)
                mine, theirs, links = group[: len(p)], group[len(p) :], []  # views: a label is the same on both sides
                for i in range(len(x)):
                    rest = np.flatnonzero(theirs != mine[i])
                    rest = rest[np.bitwise_count((y[rest] ^ x[i]).view(np.uint64)) <= distance]
                    for g in np.unique(theirs[rest]).tolist():
                        links.append({"a": int(x[i]), "b": int(y[rest[theirs[rest] == g][0]])})
                        group[group == g] = mine[i]
                out.append(links)
            yield pa.array(out, pa.list_(kind))

    return forest


def _crowd_links(rows: DataFrame, distance: int, block: int) -> DataFrame:
    """Links that connect all near values of each (seg, key) of ``rows`` (fp, seg, key), fewer than there are rows, or little more.

    Values are first compared in random blocks. What that links has one label, and only for keys with several labels
    all blocks meet, to return links between labels.
    """
    udf = _forest_udf(distance)

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        size = rows.groupBy("seg", "key").agg(F.count("*").alias("n"))
        salt = F.pmod(F.xxhash64("fp", "seg", "key"), F.ceil(F.col("n") / block)).alias(f"{name}_salt")
        return rows.join(size, ["seg", "key"]).groupBy("seg", "key", salt).agg(F.collect_list(F.struct("fp", "label")).alias(name))

    links_of = lambda both: stored(both.select(F.explode(udf("x", "y")).alias("l")).select("l.a", "l.b"))
    within = links_of(blocks(rows.withColumn("label", F.col("fp")), "x").withColumn("y", F.col("x")))
    roots = components(within)
    labelled = stored(rows.join(roots, rows["fp"] == F.col("node"), "left").select("fp", "seg", "key", F.coalesce("root", "fp").alias("label")))
    several = labelled.groupBy("seg", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("seg", "key")
    left = labelled.join(several, ["seg", "key"], "left_semi")
    return within.unionByName(links_of(blocks(left, "x").join(blocks(left, "y").hint("merge"), ["seg", "key"]).filter("x_salt < y_salt")))


def fingerprint_links(prints: DataFrame, distance: int = 3, segments: int = 2, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct ``fp`` values of ``prints`` that connect all values within ``distance`` bits.

    The 64 bits are cut into ``segments`` parts. Two values within ``distance`` differ in some part by at most
    ``distance // segments`` bits, so the table of each part is probed with the small Hamming ball around every
    value's part, and matches are verified over all 64 bits. With one bit to flip, only bits that are 0 are
    flipped: of two parts that differ in one bit, the one with the 0 reaches the other.

    Buckets of up to ``block`` members are joined and every link is returned; larger ones are compared in blocks, see
    ``_crowd_links``.
    """
    width = 64 // segments
    radius = distance // segments
    part = lambda k: F.shiftrightunsigned("fp", 64 - width * (k + 1)).bitwiseAND((1 << width) - 1)
    keyed = F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), part(k).alias("key")) for k in range(segments)]))
    entries = prints.select("fp", keyed.alias("s")).select("fp", "s.*")
    flips = F.array(*[F.lit(m).cast("long") for m in _ball(radius, width)])
    if radius == 1:
        flips = F.filter(flips, lambda m: F.col("key").bitwiseAND(m) == 0)
    probes = entries.select("fp", "seg", F.explode(flips).alias("m"), "key").select(F.col("fp").alias("probe"), "seg", F.col("key").bitwiseXOR(F.col("m")).alias("key"))
    crowded = stored(entries.groupBy("seg", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block))
    probes = probes.hint("merge")  # some 17 rows for each value, which the planner's size of them leaves out: it would broadcast them
    near = (F.col("fp") != F.col("probe")) & (_distance(F.col("fp"), F.col("probe")) <= distance)
    if crowded.isEmpty():
        return entries.join(probes, ["seg", "key"]).filter(near).select(F.col("fp").alias("a"), F.col("probe").alias("b"))
    few = entries.join(crowded, ["seg", "key"], "left_anti").join(probes, ["seg", "key"]).filter(near)
    rows = entries.select("fp", "seg", "key").unionByName(probes.select(F.col("probe").alias("fp"), "seg", "key")).distinct()
    many = _crowd_links(stored(rows.join(crowded.select("seg", "key"), ["seg", "key"])), distance, block)
    return few.select(F.col("fp").alias("a"), F.col("probe").alias("b")).unionByName(many)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, segments: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``.

    ``fp`` is the 64-bit SimHash as a signed number; ``component_id`` the smallest doc_id reachable over links
    of at most ``distance`` differing bits, its own included.

    Defined cases: null text and text without words have fingerprint 0, linked like any other; rows with equal
    fingerprints are one group; null doc_ids take part but are never the smallest unless a group has no other;
    an empty table gives no rows; other columns are ignored.
    """
    rows = stored(docs.select("doc_id", fingerprint_udf(shingle)("text").alias("fp")))
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(fingerprint_links(prints, distance, segments))
    linked = prints.join(roots, prints["fp"] == roots["node"])
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_group = linked.select("fp", "root").join(smallest, "root").select("fp", F.col("component_id").alias("group_id"))
    ids = stored(prints.join(of_group, "fp", "left").select("fp", F.coalesce("group_id", "first").alias("component_id")))
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")
