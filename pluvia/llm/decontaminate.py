"""Benchmark decontamination by suffix arrays over the training text.

Each slice of training documents that a task holds is one shard. Its suffix array (word positions sorted by
the ``window`` words that follow them) is searched with every distinct suffix of the benchmark's items by binary
search; equal ranges give all verbatim occurrences with their places, and runs of neighbouring hits on one
diagonal give the longest verbatim matches. Where a suffix repeats inside an item, a match goes on along its diagonal as long as
that can, and else begins at the item's first such place: a place in a document has one match per item, never one per pair of
places. The array is sparse: positions whose first few words start no benchmark suffix cannot match and are left out before
sorting, which changes no result.

Documents are never shuffled. The benchmark is broadcast in blocks of at most ``block_words`` words. With more than one block
each is a job of its own, whose matches are written before the next one is built, so that the driver and the workers hold one block
at a time, whatever the benchmark's size.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ``window`` consecutive words of
an item; an item with fewer words, but not none, is one window.

Defined cases: null or wordless text has no words and is never hit; null or wordless items have no windows;
repeated documents and repeated items are treated row by row (an item id counts once per document); empty
tables work; other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, stored, texts
from .merges import spread

WINDOW = 10

#: Bytes of a word: 0-9, a-z and all of a multi-byte character; others separate words. A-Z is lower-cased.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_FILTER_BITS = 22
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

MATCH = "struct<item_id:string,item_pos:int,doc_pos:int,length:int>"


class Suffixes:
    """The benchmark side of the search: word ids and all item suffixes with the words they need to match."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        rows, item, pos, need = [], [], [], []
        for k, (_, words) in enumerate(items):
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            for p in range(len(own) - min(window, len(own)) + 1):
                rows.append((own[p : p + window] + [0] * window)[:window])
                item.append(k)
                pos.append(p)
                need.append(min(window, len(own)))
        self.names = [name for name, _ in items]
        item, pos, need = (np.array(x, np.int64) for x in (item, pos, need))
        words = np.array(rows, np.int64).reshape(-1, window)
        _, first, kind = np.unique(np.c_[words, need], axis=0, return_index=True, return_inverse=True)
        kind = kind.ravel()
        # distinct suffixes, and for each the (item, first place) pairs that have it
        self.words, self.need = words[first], need[first]
        order = np.lexsort((pos, item, kind))
        kind, item, pos = kind[order], item[order], pos[order]
        lead = np.r_[True, (kind[1:] != kind[:-1]) | (item[1:] != item[:-1])] if len(kind) else np.zeros(0, bool)
        self.item, self.pos = item[lead], pos[lead]
        self.of_kind = np.searchsorted(kind[lead], np.arange(len(self.words) + 1))
        again = ~lead
        self.loops = np.isin(np.arange(len(items)), item[again])
        inside = self.loops[item]
        self.places = set(zip(kind[inside].tolist(), item[inside].tolist(), pos[inside].tolist(), strict=True))
        self.first = int(min(self.need.min(initial=3), 3))
        self.starts = np.zeros(1 << _FILTER_BITS, bool)
        self.starts[self.mixed([self.words[:, j] for j in range(self.first)])] = True
        self.low = self.keys(self.words)
        high = self.words.copy()
        high[np.arange(window) >= self.need[:, None]] = 0xFFFFFFFF
        self.high = self.keys(high)

    def mixed(self, columns: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for c, m in zip(columns, _MIX, strict=False):
            total += c.astype(np.uint64) * np.uint64(m)
        return (total >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Byte strings that sort as the word sequences do."""
        return np.ascontiguousarray(words.astype(">u4")).view(f"S{4 * self.window}").ravel()

    def matches(self, docs: list[list[bytes]]) -> list[list[tuple[str, int, int, int]]]:
        """Per document its maximal runs of matched windows: (item, place in item, place in document, words)."""
        found: list[list[tuple[str, int, int, int]]] = [[] for _ in docs]
        sizes = np.array([len(d) for d in docs], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        ids = np.zeros(begins[-1] + self.window, np.int64)
        for d, begin in zip(docs, begins, strict=False):
            ids[begin : begin + len(d)] = np.fromiter(map(self.ids.get, d, repeat(0)), np.int64, len(d))
        n = len(ids) - self.window
        if not n or not len(self.words):
            return found
        heads = [ids[j : n + j] for j in range(self.first)]
        at = np.flatnonzero(np.logical_and.reduce([h > 0 for h in heads]))
        at = at[self.starts[self.mixed([h[at] for h in heads])]]
        if not len(at):
            return found
        own = self.keys(ids[at[:, None] + np.arange(self.window)])
        order = np.argsort(own, kind="stable")  # the shard's suffix array
        own = own[order]
        left, right = np.searchsorted(own, self.low, "left"), np.searchsorted(own, self.high, "right")
        hits = np.maximum(right - left, 0)
        test = np.repeat(np.arange(len(hits)), hits)
        if not len(test):
            return found
        where = at[order[np.arange(len(test)) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(left, hits)]]
        pairs, _ = spread(np.arange(len(self.item)), self.of_kind[:-1], np.diff(self.of_kind), test)
        n_items = np.diff(self.of_kind)[test]
        kind, where = np.repeat(test, n_items), np.repeat(where, n_items)
        item, need = self.item[pairs], self.need[kind]
        pos = self._diagonals(item, self.pos[pairs], kind, where)
        by = np.lexsort((where, where - pos, item))
        item, pos, need, where = item[by], pos[by], need[by], where[by]
        new = np.r_[True, (item[1:] != item[:-1]) | (where[1:] - pos[1:] != where[:-1] - pos[:-1]) | (where[1:] > where[:-1] + need[:-1])]
        begin = np.flatnonzero(new)
        stop = np.r_[begin[1:], len(new)] - 1
        length = where[stop] + need[stop] - where[begin]
        doc = np.searchsorted(begins, where[begin], "right") - 1
        for d, k, p, w, m in zip(doc.tolist(), item[begin].tolist(), pos[begin].tolist(), (where[begin] - begins[doc]).tolist(), length.tolist(), strict=True):
            found[d].append((self.names[k], p, w, m))
        return found


    def _diagonals(self, item: np.ndarray, pos: np.ndarray, kind: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Places in items: the first one of the suffix, or, in items that repeat it, the next on the diagonal before."""
        pos = pos.copy()
        some = np.flatnonzero(self.loops[item])
        some = some[np.lexsort((where[some], item[some]))]
        last = (-1, -1, -1)
        for i, k, w, c in zip(some.tolist(), item[some].tolist(), where[some].tolist(), kind[some].tolist(), strict=True):
            if last[:2] == (k, w - 1) and (c, k, last[2] + 1) in self.places:
                pos[i] = last[2] + 1
            last = (k, w, int(pos[i]))
        return pos


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def benchmark_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with their words, in blocks; the driver holds one block at a time."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = words_of((row[1] or "").encode())
        if size and size + len(words) > block_words:
            yield block
            block, size = [], 0
        if words:
            block.append((row[0] or "", words))
            size += len(words)
    yield block


def _search(shared: Any) -> Any:
    @F.arrow_udf(f"struct<n_words:bigint,matches:array<{MATCH}>>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        suffixes = shared.value
        kind = pa.struct([("item_id", pa.string()), ("item_pos", pa.int32()), ("doc_pos", pa.int32()), ("length", pa.int32())])
        for batch in batches:
            raw = texts(batch)
            counts: list[int] = []
            matches: list[list[tuple[str, int, int, int]]] = []
            for a, b in slices(raw):
                docs = [words_of(x) for x in raw[a:b]]
                counts += map(len, docs)
                matches += suffixes.matches(docs)
            ends = np.concatenate([[0], np.cumsum([len(m) for m in matches])]).astype(np.int32)
            flat = [x for m in matches for x in m]
            parts = zip(*flat, strict=True) if flat else ((), (), (), ())
            rows = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(parts, kind, strict=True)], fields=list(kind))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rows)], names=["n_words", "matches"])

    return search


def covered(matches: Column) -> Column:
    """Words inside at least one match: the matches by place, each adding what reaches past those before."""
    step = lambda s, m: F.struct(
        (s["n"] + F.greatest(m["doc_pos"] + m["length"] - F.greatest(s["end"], m["doc_pos"]), F.lit(0))).alias("n"),
        F.greatest(s["end"], m["doc_pos"] + m["length"]).alias("end"),
    )
    ordered = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_pos"].alias("doc_pos"), m["length"].alias("length"))))
    folded = F.aggregate(ordered, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)
    return F.when(F.size(matches) == 0, F.lit(0)).otherwise(folded["n"]).cast("long")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 500_000) -> tuple[DataFrame, str]:
    """``docs`` with one more column (its name is returned too): struct n_words, n_hit, item_ids, matches.

    ``matches`` are the longest verbatim matches (item_id, item_pos, doc_pos, length in words; positions from
    0); ``item_ids`` the distinct matched items sorted as strings; ``n_hit`` the words inside any match.
    """
    name = fresh(docs, "match")
    context = docs.sparkSession.sparkContext
    blocks = benchmark_blocks(benchmark, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = docs.withColumn(name, _search(context.broadcast(Suffixes(first, window)))("text"))
    else:
        row, parts = f"{name}row", []
        docs = stored(docs.withColumn(row, F.monotonically_increasing_id()))  # written, so that numbers are fixed
        for block in chain([first, second], blocks):
            shared = context.broadcast(Suffixes(block, window))
            hits = docs.select(row, _search(shared)("text").alias("m")).select(row, F.explode("m.matches").alias("match"))
            parts.append(stored(hits))
            shared.unpersist()
        hits = reduce(DataFrame.unionByName, parts).groupBy(row).agg(F.collect_list("match").alias(f"{name}all"))  # of one text
        counted = docs.withColumn(name, _search(context.broadcast(Suffixes([], window)))("text"))
        found = counted.join(hits.withColumnRenamed(row, f"{row}hit"), F.col(row) == F.col(f"{row}hit"), "left")
        matches = F.coalesce(F.col(f"{name}all"), F.array().cast(f"array<{MATCH}>"))
        found = found.withColumn(name, F.struct(F.col(name)["n_words"].alias("n_words"), matches.alias("matches"))).drop(row, f"{row}hit", f"{name}all")
    matches = F.col(name)["matches"]
    out = found.withColumn(
        name,
        F.struct(
            F.col(name)["n_words"].alias("n_words"),
            covered(matches).alias("n_hit"),
            F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"]))).alias("item_ids"),
            F.array_sort(matches).alias("matches"),
        ),
    )
    return out, name


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold a benchmark window, with the columns of ``docs``."""
    out, name = find_contamination(docs, benchmark, window)
    return out.filter(F.col(name)["n_hit"] == 0).drop(name)
