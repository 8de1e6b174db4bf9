"""Near-duplicate groups by exact shingle similarity: candidates by wide SimHash fingerprints and multi-index hashing.

A fingerprint has ``LANES`` words of 64 bits over a text's distinct shingles. For two sets of similarity s
(shared over all shingles) a bit differs with probability acos(2 s / (1 + s)) / pi, so the complete distance
estimates s; two texts are candidates if it is at most what s = ``similarity`` - ``margin`` gives, and link if the exact
similarity of their sets of 64-bit shingle hashes is at least ``similarity``. With 1024 bits the estimate's
standard error is about 0.025 at s = 0.8. As s can't exceed the ratio of the two counts of shingles, texts whose counts
differ by more than that never link.

Candidates: the leading bits are cut into segments. In the table of each segment a fingerprint stands under its own
segment and under every segment with one of its set bits cleared, so that two that differ there in one bit, or have
one bit each that the other lacks, meet. The width grows with the logarithm of the number of fingerprints, to
keep tables sparse, and the number of segments grows with the width, so that pairs at the least similarity meet
in some table with probability ``RECALL`` at any size; more similar ones meet almost surely.

Texts of at most ``SHORT`` shingles are estimated too coarsely. They stand under hashes of their own as well: of n
hashes in order the first n - ceil(s n) + 1, of which two sets of similarity s share one, so that these pairs all meet, and
their distance is held against what their two sizes make likely.

Large groups come first: texts with the same smallest shingle hash, under a few orders of the hashes, are compared in random blocks of
about ``block``, which links nearly all of a group by a few links for each member (``first_links``) before any table is made. What is linked has
a label, and from then on only pairs of different labels are looked for, so that pairs of a group grow with its members and not with their square:
in keys with more than ``crowd`` members all pairs of two labels (``crowd_pairs``), in all others a join, thinned by three further lanes (3.5 standard
errors above the least similarity) and the complete distance. Members of a crowded key's most frequent label are brought together only where another of its labels
may be near by the two labels' centres, radii and sizes, which no near pair fails. The exact similarity decides. Beyond 2^27 fingerprints tables fill up and
more keys are crowded, with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, repeats, scratch_scope, slices, small_batches, stored, texts
from .components import components
from .simhash import majority, shingle_hashes

LANES = 16
RECALL = 0.99
SHORT = 64
LEAST_WIDTH, MOST_WIDTH = 20, 28
BLOCK, CROWD, PICKS, ROUNDS = 256, 16, 4, 2

#: Rows of text hashes and doc_ids that may be broadcast, some ten bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def bit_share(similarity: float) -> float:
    """Probability that a bit differs between two sets of equal size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def table_shape(n: int, similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """Width and number of segments for ``n`` fingerprints."""
    width = min(max(LEAST_WIDTH, math.ceil(math.log2(max(n, 1))) + 1), MOST_WIDTH)
    p = bit_share(similarity)
    meet = (1 - p) ** width + width * p * (1 - p) ** (width - 1) + width * (width - 1) / 4 * p**2 * (1 - p) ** (width - 2)
    return width, min(math.ceil(math.log(1 - recall) / math.log(1 - meet)), 64 * (LANES - 1) // width)


def lanes_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of ``LANES`` words per document; each lane mixes the shingle hashes anew."""
    out = np.zeros((len(counts), LANES), np.uint64)
    for k in range(LANES):
        z = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = majority(z ^ (z >> np.uint64(31)), counts)
    return out


def picks_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of ``ROUNDS * PICKS`` numbers per document: its smallest shingle hash, in so many orders. Sets share each with their similarity."""
    out, some = np.zeros((len(counts), ROUNDS * PICKS), np.int64), counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    for k in range(ROUNDS * PICKS if len(starts) else 0):
        z = (hashes ^ (hashes >> np.uint64(31))) * np.uint64((k + LANES + 1) * 0x9E3779B97F4A7C16 % (1 << 64) | 1)
        out[some, k] = np.minimum.reduceat(z ^ (z >> np.uint64(29)), starts).view(np.int64)
    return out


def _set(text: bytes, n: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.array(shingle_hashes(text, n), np.uint64))


def _few(own: np.ndarray, similarity: float) -> list[int]:
    """Table keys of a short text: its first hashes, apart from all keys of segments."""
    most = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 if 0 < len(own) <= SHORT else 0
    return [int(h) & (1 << 62) - 1 | 1 << 62 for h in own[:most]]


def _prints_udf(n: int, similarity: float):
    """struct<bits, n, few, picks>: the fingerprint, the number of distinct shingles, the table keys of a short text, and ``picks_of``."""

    @F.arrow_udf("struct<bits:binary,n:int,few:array<bigint>,picks:array<bigint>>")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            raw = texts(batch)
            bits, sizes, few, picks = [np.zeros((0, LANES), np.uint64)], [np.zeros(0, np.int64)], [], [np.zeros((0, ROUNDS * PICKS), np.int64)]
            for a, b in slices(raw, 1_000_000):
                own = [_set(x, n) for x in raw[a:b]]
                counts = np.array([len(x) for x in own], np.int64)
                bits.append(lanes_of(np.concatenate(own), counts))
                picks.append(picks_of(np.concatenate(own), counts))
                sizes.append(counts)
                few += [_few(x, similarity) for x in own]
            flat = np.ascontiguousarray(np.concatenate(bits))
            fixed = pa.Array.from_buffers(pa.binary(8 * LANES), len(flat), [None, pa.py_buffer(flat)])
            chosen = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * ROUNDS * PICKS, pa.int32()), pa.array(np.concatenate(picks).ravel()))
            yield pa.StructArray.from_arrays([fixed.cast(pa.binary()), pa.array(np.concatenate(sizes), pa.int32()), pa.array(few, pa.list_(pa.int64())), chosen], names=["bits", "n", "few", "picks"])
        release()

    return prints


def _sets_udf(n: int):
    @F.arrow_udf("binary")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_set(x, n).tobytes() for x in texts(batch)], pa.binary())
        release()

    return sets


def enough(shared, size, other, similarity: float):
    """Whether sets of two sizes that share so many are similar."""
    return shared + 1e-9 >= similarity * (size + other - shared)


def _exact_udf(similarity: float):
    @F.arrow_udf("boolean")
    def exact(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            out.append(enough(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), similarity))
        return pa.array(out, pa.bool_())

    return exact


def _matrix(bits: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(-1, LANES)


def segment_parts(rows: np.ndarray, width: int, segments: int) -> np.ndarray:
    """The leading bits cut into segments, as numbers."""
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1)[:, : width * segments]
    return bits.reshape(-1, segments, width) @ (np.int64(1) << np.arange(width))


def _segments_udf(width: int, segments: int):
    """struct<lane, more, last, parts>: the last three lanes, and the table keys (segment number and bits) of all segments."""

    @F.arrow_udf("struct<lane:bigint,more:bigint,last:bigint,parts:array<bigint>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = _matrix(batch)
            keys = segment_parts(rows, width, segments) + (np.arange(segments) << width)
            ends = pa.array(np.arange(len(rows) + 1) * segments, pa.int32())
            lanes = [pa.array(np.ascontiguousarray(rows[:, k]).view(np.int64)) for k in (-1, -2, -3)]
            yield pa.StructArray.from_arrays([*lanes, pa.ListArray.from_arrays(ends, pa.array(keys.ravel(), pa.int64()))], names=["lane", "more", "last", "parts"])

    return cut


def _ball(key: Column, width: int) -> Column:
    """The key and those with one of its set bits cleared."""
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(width)])
    return F.concat(F.array(key), F.transform(F.filter(masks, lambda m: key.bitwiseAND(m) != 0), lambda m: key.bitwiseXOR(m)))


def short_limits(similarity: float, sigmas: float = 5.5) -> np.ndarray:
    """The largest distance to expect between short sets, by their two sizes: ``sigmas`` above the mean at the least similarity.

    For few shingles the chance that a bit differs is summed over the votes that the two sets share.
    """
    most = SHORT
    pmf = np.zeros((most + 1, most + 1))  # of n coins the chance of k heads
    pmf[0, 0] = 1
    for n in range(1, most + 1):
        pmf[n] = pmf[n - 1] / 2
        pmf[n, 1:] += pmf[n - 1, :-1] / 2
    tail = np.cumsum(pmf[:, ::-1], axis=1)[:, ::-1]  # of at least k heads
    above = lambda n, k: np.where(k <= 0, 1.0, np.where(k > n, 0.0, tail[n, np.clip(k, 0, most)]))
    out = np.full((most + 1, most + 1), -1, np.int64)
    for a in range(1, most + 1):
        for b in range(1, most + 1):
            shared = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            if shared > min(a, b):
                continue
            votes = np.arange(shared + 1)
            p, q = above(a - shared, a // 2 + 1 - votes), above(b - shared, b // 2 + 1 - votes)
            differ = float((pmf[shared, : shared + 1] * (p * (1 - q) + q * (1 - p))).sum())
            out[a, b] = math.ceil(64 * LANES * differ + sigmas * math.sqrt(64 * LANES * differ * (1 - differ)))
    return out


class Nearness:
    """Which pairs of fingerprints are candidates."""

    def __init__(self, similarity: float, estimate: float) -> None:
        self.ratio = min(similarity, estimate)
        self.distance = int(64 * LANES * bit_share(estimate))
        self.short = short_limits(similarity)

    def __call__(self, bits: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray) -> np.ndarray:
        """For arrays that broadcast against each other (``bits`` with one more axis, of lanes)."""
        distance = np.bitwise_count(bits ^ other).sum(-1, dtype=np.int64)
        limit = np.where(np.maximum(n, m) <= SHORT, self.short[np.minimum(n, SHORT), np.minimum(m, SHORT)], self.distance)
        return (distance <= limit) & (np.minimum(n, m) >= self.ratio * np.maximum(n, m))


def _near_udf(near: Nearness):
    @F.arrow_udf("boolean")
    def check(a: pa.Array, n: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array(near(_matrix(a), np.asarray(n), _matrix(b), np.asarray(m)))

    return check


def _distance_udf():
    @F.arrow_udf("int")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.bitwise_count(_matrix(a) ^ _matrix(b)).sum(-1, dtype=np.int32))

    return distance


@dataclass
class Block:
    """Members of a key: ids, shingle counts, labels of what they are linked with so far, fingerprints."""

    id: np.ndarray
    n: np.ndarray
    label: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(rows: pa.StructArray) -> Block:
        own = [np.asarray(rows.field(k)) for k in ("id", "n", "label")]
        return Block(own[0], own[1].astype(np.int64), own[2], _matrix(rows.field("bits")))


def forest(block: Block, near: Nearness) -> list[tuple[int, int]]:
    """Links between near members that join all labels which can be joined, one link for each two that meet."""
    _, group = np.unique(block.label, return_inverse=True)
    links = []
    for i in range(len(group)):
        rest = np.flatnonzero(group != group[i])
        rest = rest[near(block.bits[rest], block.n[rest], block.bits[i], block.n[i])]
        for g in np.unique(group[rest]):
            links.append((int(block.id[i]), int(block.id[rest[group[rest] == g][0]])))
            group[group == g] = group[i]
    return links


def across(key: int, members: Block, probes: Block, near: Nearness, main: int, width: int, segments: int) -> list[tuple[int, int]]:
    """All near pairs of a probe and a member of another label that are to be reported for this key.

    A pair meets in several tables: it is reported for the first segment in which it does, and there for the key of the
    bits that both have. Pairs of short texts are reported for each key of their own hashes. ``main`` is the label that no probe has.
    """
    few, links = key >> 62 & 1, []
    for label in np.unique(probes.label):
        p, m = np.flatnonzero(probes.label == label), np.flatnonzero(members.label != label)
        found = near(probes.bits[p][:, None], probes.n[p][:, None], members.bits[m], members.n[m])
        i, j = np.nonzero(found)
        i, j = p[i], m[j]
        ok = (members.label[j] == main) | (probes.id[i] < members.id[j])
        ok &= ((probes.n[i] <= SHORT) & (members.n[j] <= SHORT)) == bool(few)
        i, j = i[ok], j[ok]
        if not few and len(i):
            x, y = segment_parts(probes.bits[i], width, segments), segment_parts(members.bits[j], width, segments)
            meet = (np.bitwise_count(x & ~y) <= 1) & (np.bitwise_count(y & ~x) <= 1)
            first = meet.argmax(1)
            both = (x & y)[np.arange(len(i)), first] + (first << width)
            i, j = i[both == key], j[both == key]
        links += zip(probes.id[i].tolist(), members.id[j].tolist(), strict=True)
    return links


_LINKS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _as_links(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in f] for f in found], _LINKS)


def _forest_udf(near: Nearness):
    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def links(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield _as_links([forest(Block.of(x.values), near) for x in rows])
        release()

    return links


def _across_udf(near: Nearness, width: int, segments: int):
    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def links(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, members, probes, mains in batches:
            yield _as_links([across(k.as_py(), Block.of(m.values), Block.of(p.values), near, main.as_py(), width, segments) for k, m, p, main in zip(keys, members, probes, mains, strict=True)])
        release()

    return links


def _blocks(members: DataFrame, block: int, name: str, seed: int, *keys: str) -> DataFrame:
    """Members (key, id, n, label, bits, and the number of them) in random blocks of each key."""
    salt = F.pmod(F.xxhash64("id", F.lit(seed), *keys[1:]), F.ceil(F.col(f"{name}_n") / block)).alias("salt")
    return members.groupBy(*keys, salt).agg(F.collect_list(F.struct("id", "n", "label", "bits")).alias(name)).drop("salt")


def first_links(prints: DataFrame, verified: Callable[[DataFrame], DataFrame], similarity: float, block: int) -> DataFrame:
    """Links (a, b) that connect nearly all members of large groups, at most a few for each member.

    Texts with the same pick are compared in random blocks, and only what joins two labels of a block is linked. Two rounds, each with
    ``PICKS`` picks of its own: the first asks for a closer estimate than ``similarity``, the second meets what is left in larger blocks.
    """
    full, links = prints.select("id", "n", "bits"), None
    for k, estimate in enumerate((similarity + 0.06, similarity)):
        pick = _labelled(prints.select("id", "picks"), links).select("id", "label", F.posexplode(F.slice("picks", PICKS * k + 1, PICKS)).alias("time", "key"))
        size = pick.groupBy("key", "time").agg(F.count("*").alias("rows_n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        own = pick.join(size, ["key", "time"]).join(full, "id")
        udf = _forest_udf(Nearness(similarity, estimate))
        found = _few_rows(_ordered(_blocks(own, block * 4**k, "rows", 1, "key", "time").select(F.explode(udf("rows")).alias("l"))), 16)
        new = verified(found.distinct())
        links = new if links is None else stored(links.unionByName(new))
    return links


def label_spans(labelled: DataFrame) -> DataFrame:
    """(label, centre, radius, least, most) of rows (id, label, n, bits): the label's own fingerprint, the largest distance of a member to it,
    and the least and the largest number of shingles."""
    centres = labelled.filter("id = label").select("label", F.col("bits").alias("centre"))
    alone = labelled.groupBy("label").agg(F.count("*").alias("ids"), F.min("n").alias("least"), F.max("n").alias("most"))
    wide = labelled.join(alone.filter("ids > 1").select("label"), "label", "left_semi").join(centres, "label")
    radius = wide.groupBy("label").agg(F.max(_distance_udf()("bits", "centre")).alias("radius"))
    spans = alone.join(centres, "label").join(radius, "label", "left")
    return spans.select("label", "centre", F.coalesce("radius", F.lit(0)).alias("radius"), "least", "most")


def may_be_near(pairs: DataFrame, spans: DataFrame, near: Nearness) -> DataFrame:
    """Those of the pairs of labels (label, main) of which a member of one can be near to a member of the other.

    Near members x and y are at most their limit apart, so their centres are at most that and both radii apart.
    """
    side = lambda p, key: spans.select(F.col("label").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("centre", "radius", "least", "most")])
    both = pairs.join(side("a", "label"), "label").join(side("b", "main"), "main")
    sizes = (F.col("a_most") >= F.col("b_least") * near.ratio - 1e-6) & (F.col("b_most") >= F.col("a_least") * near.ratio - 1e-6)
    short = F.greatest("a_least", "b_least") <= SHORT
    limit = F.when(short, max(near.distance, int(near.short.max()))).otherwise(near.distance)
    return both.filter(sizes & (_distance_udf()("a_centre", "b_centre") <= limit + F.col("a_radius") + F.col("b_radius"))).select("label", "main")


def crowd_pairs(places: Callable[[DataFrame], DataFrame], labelled: DataFrame, keys: DataFrame, near: Nearness, shape: tuple[int, int], block: int) -> DataFrame:
    """All near pairs (a, b) of two labels that meet in a crowded key.

    ``places`` gives (id, label, key) of rows of ``labelled`` (id, label, n, bits). ``keys`` (key, main, main_n, probes_n) are the crowded
    keys with several labels. In each of them every member of another label than the most frequent one, ``main``, meets all members of other labels, but
    ``main``'s members only if its label may be near to the member's.
    """
    size, full = ["main", "probes_n", "rows_n"], labelled.select("id", "n", "bits")
    keys = keys.select("key", "main", "probes_n", (F.col("main_n") + F.col("probes_n")).alias("rows_n"))
    probes = stored(places(labelled).join(keys, "key").filter("label <> main").select("key", "id", "label", *size))
    met = stored(may_be_near(probes.select("label", "main").distinct(), label_spans(labelled), near))
    open_ = stored(probes.join(met, ["label", "main"], "left_semi").select("key", *size).distinct())
    large = labelled.join(open_.select(F.col("main").alias("label")).distinct(), "label", "left_semi")
    mains = places(large).join(open_, "key").filter("label = main").select("key", "id", "label", *size)
    # a key's only probe meets nothing where main's members stay away
    asked = stored(probes.filter("probes_n > 1").unionByName(probes.filter("probes_n = 1").join(open_.select("key"), "key", "left_semi")).join(full, "id"))
    rows = _blocks(asked.unionByName(mains.join(full, "id")), block, "rows", 2, "key", "main")
    both = rows.join(_blocks(asked, block, "probes", 3, "key", "main"), ["key", "main"])
    return _few_rows(_ordered(both.select(F.explode(_across_udf(near, *shape)("key", "rows", "probes", "main")).alias("l"))), 16)


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("l.a", "l.b").alias("a"), F.greatest("l.a", "l.b").alias("b"))


def _labelled(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """``rows`` with a label: the root of what the id is linked with so far, itself if with nothing."""
    if links is None:
        return rows.withColumn("label", F.col("id"))
    roots = stored(components(links))
    return rows.join(roots, rows["id"] == F.col("node"), "left").select(*rows.columns, F.coalesce("root", "id").alias("label"))


def similar_links(prints: DataFrame, n: int, similarity: float, margin: float, sets: Callable[[DataFrame], DataFrame], block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between ids that connect all similar texts which meet in a table.

    ``prints`` is a written table (id: bigint, bits, n: shingles, few: keys of short texts, picks) of ``n`` rows. ``sets`` gives
    (id, hashes) of a table of ids, for exact checks.
    """
    width, segments = table_shape(n, similarity, RECALL)
    share = bit_share(similarity)
    lanes_most = int(192 * share + 3.5 * math.sqrt(192 * share * (1 - share)))
    near = Nearness(similarity, similarity - margin)
    wide = prints.filter(F.col("n") >= similarity * SHORT)  # shorter pairs meet in ``few``
    cut = stored(wide.select("id", _segments_udf(width, segments)("bits").alias("s")).select("id", "s.*"))

    def entries(rows: DataFrame, short: DataFrame) -> DataFrame:
        own = [c for c in rows.columns if c != "parts"]
        balls = rows.select(*own, F.explode("parts").alias("own")).select(*own, F.explode(_ball(F.col("own"), width)).alias("key"))
        return balls.unionByName(short.select("*", F.explode("few").alias("key")).drop("few"), allowMissingColumns=True)

    def verified(found: DataFrame) -> DataFrame:
        """Pairs that are similar; their sets are made for them alone."""
        found = stored(found)
        known = stored(sets(found.select(F.col("a").alias("id")).union(found.select("b")).distinct()))
        side = lambda name: known.select(F.col("id").alias(name), F.col("hashes").alias(f"{name}_hashes"))
        return _few_rows(found.join(side("a"), "a").join(side("b"), "b").filter(_exact_udf(similarity)("a_hashes", "b_hashes")).select("a", "b"), 64)

    links = first_links(prints, verified, similarity, block)
    labelled = stored(_labelled(prints.select("id", "n", "bits", "few"), links))

    def places(rows: DataFrame) -> DataFrame:
        own = rows.select("id", "label")
        return entries(cut.join(own, "id"), rows.filter(F.size("few") > 0).select("id", "label", "few"))

    found = places(labelled).select("key", "label").repartition("key").groupBy("key", "label").agg(F.count("*").alias("n"))
    found = found.groupBy("key").agg(F.sum("n").alias("members"), F.max(F.struct("n", "label")).alias("m"))
    crowded = stored(found.filter(F.col("members") > crowd).select("key", F.col("m.label").alias("main"), F.col("m.n").alias("main_n"), (F.col("members") - F.col("m.n")).alias("probes_n")))
    rest, cross = places(labelled), None
    if not crowded.isEmpty():
        cross = crowd_pairs(lambda rows: places(rows).select("id", "label", "key"), labelled, crowded.filter("probes_n > 0"), near, (width, segments), block)
        rest = rest.join(crowded, "key", "left_anti")
    a, b = rest.alias("a"), rest.alias("b")
    differ = sum(F.bit_count(F.col(f"a.{k}").bitwiseXOR(F.col(f"b.{k}"))) for k in ("lane", "more", "last"))
    alike = (F.col("a.id") < F.col("b.id")) & (F.col("a.lane").isNull() | (differ <= lanes_most))  # keys of short texts have no lanes
    alike &= F.col("a.label") != F.col("b.label")
    pairs = a.join(b, F.col("a.key") == F.col("b.key")).filter(alike).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    if cross is not None:
        pairs = pairs.join(cross, ["a", "b"], "left_anti")  # what is near is known of those
    side = lambda name: prints.select(F.col("id").alias(name), F.col("bits").alias(f"{name}_bits"), F.col("n").alias(f"{name}_n"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(_near_udf(near)("a_bits", "a_n", "b_bits", "b_n")).select("a", "b")
    last = verified(pairs if cross is None else pairs.unionByName(cross).distinct())
    return links.unionByName(last)


def _few_rows(df: DataFrame, rows: int) -> DataFrame:
    """``df`` written with so many rows at a time in a Python worker: sets and blocks are large."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        return stored(df)
    finally:
        small_batches(spark)


def _grouped(docs: DataFrame, shingle: int, similarity: float, margin: float, block: int, crowd: int) -> DataFrame:
    """(doc_id, text_hash, keep) of each row: struct none, doc_id, text_hash of the first row of its group, rows without doc_id last."""
    text_hash = F.xxhash64("text").alias("text_hash")
    rows = stored(docs.select("doc_id", text_hash, _prints_udf(shingle, similarity)("text").alias("p")).select("doc_id", "text_hash", "p.*"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    distinct = rows.groupBy("bits", "n").agg(F.min(row).alias("first"), F.min("text_hash").alias("text_hash"), F.min("few").alias("few"), F.min("picks").alias("picks"))
    prints = stored(distinct.withColumn("id", F.monotonically_increasing_id()))  # written, so that ids are fixed

    def sets(ids: DataFrame) -> DataFrame:
        needed = stored(prints.join(ids, "id", "left_semi").select("id", "text_hash"))
        hashes = needed.select("text_hash")
        hashes = F.broadcast(hashes) if needed.count() <= BROADCAST_ROWS else hashes  # 8 bytes a row
        one = docs.select(text_hash, "text").join(hashes, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
        return one.join(needed, "text_hash").select("id", _sets_udf(shingle)("text").alias("hashes"))

    links = similar_links(prints.filter("n > 0").select("id", "n", "bits", "few", "picks"), prints.count(), similarity, margin, sets, block, crowd)
    linked = prints.join(components(links), prints["id"] == F.col("node"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("keep"))
    of_group = linked.select("id", "root").join(smallest, "root").select("id", "keep")
    kept = stored(prints.join(of_group, "id", "left").select("bits", "n", F.coalesce("keep", "first").alias("keep")))
    return rows.join(kept, ["bits", "n"]).select("doc_id", "text_hash", "keep")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, margin: float = 0.08, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """(doc_id, component_id): one row per row of ``docs``; the smallest doc_id reachable over links, its own included.

    Words: A-Z lower-cased, then ``[^\\x20\\x09-\\x0D]+``; shingles of ``shingle`` words, each counted once (fewer words: the
    whole sequence).

    Defined cases: null text and text without words have the fingerprint zero and are one group; texts with the same
    shingles are one group; null doc_ids take part but are never the smallest unless a group has no other; rows that share
    a doc_id are grouped by their own texts; an empty table gives no rows; other columns are ignored.
    """
    return _grouped(docs, shingle, similarity, margin, block, crowd).select("doc_id", F.col("keep.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, margin: float = 0.08) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id, and of those the smallest text hash.

    Rows are told apart by doc_id and text, so different texts under one doc_id are kept or dropped on their own; of rows equal in both
    one stays. Rows without a doc_id count like others, but come last.
    """
    name, marked = fresh(docs, "gone"), repeats(docs, fresh(docs, "again"))
    with scratch_scope(docs.sparkSession) as keep:
        found = _grouped(docs, shingle, similarity, margin, BLOCK, CROWD)
        gone = found.filter(~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_hash") == F.col("keep.text_hash"))))
        gone = keep(gone.select(F.col("doc_id").alias(f"{name}id"), F.col("text_hash").alias(f"{name}hash")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone  # then texts stay where they are
    same = marked["doc_id"].eqNullSafe(F.col(f"{name}id")) & (F.xxhash64(marked["text"]) == F.col(f"{name}hash"))
    left = marked.join(gone, same, "left_anti")
    return left.filter(~F.col(marked.columns[-1])).select(*[f"`{c}`" for c in docs.columns])
