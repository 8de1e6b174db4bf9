"""Best-fit packing of documents into token sequences of a fixed capacity.

Method: bulk-synchronous best-fit. Documents (cut into pieces of at most ``capacity`` tokens) are
range-sorted by length over the cluster, and open gaps are kept sorted by size. In each round one run of
equally long pieces, longest first, sweeps the gaps upward from its own length (the successor of a length
is the smallest gap that holds it), conflicts are resolved by rank (the k-th piece of the run takes the
k-th place), the gaps shrink, and the next run follows.

Pieces of one length are interchangeable, so the sweep needs only their number: it runs over runs
``(length, count)`` and ``(gap, sequences)``. There are at most ``capacity`` lengths however large the
corpus is, so these run tables are the only thing that leaves the executors; pieces themselves are ranked
by a range sort and placed by binary search in the list of matched rank intervals.

Defined cases: null text is empty and packs as its end token alone; an empty table gives no rows; repeated
``doc_id`` rows are packed one by one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored
from .merges import MergeEncoder

#: Bytes of text that a task encodes at once: few enough to bound its arrays, many enough to share chunks.
SLICE = 12_000_000

_WORKER: dict[str, MergeEncoder] = {}


def gathered(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches put together, and cut after each row that brings a slice to ``most`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0), dtype=np.int64)
            rows = min(int(np.searchsorted(sizes, most - size)) + 1, batch.num_rows)
            held.append(batch.slice(0, rows))
            size += int(sizes[rows - 1])
            batch = batch.slice(rows)
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents over ``capacity`` are cut."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _WORKER:
            _WORKER[tokenizer] = MergeEncoder(tokenizer)
        for batch in gathered(batches):
            flat, stops = _WORKER[tokenizer].encode(batch["text"])
            n = np.diff(stops, prepend=0) + 1
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            length = np.minimum(n[doc] - piece * capacity, capacity)
            crcs, end = [], np.array([end_id], "<u4").tobytes()
            data = flat.astype("<u4").view(np.uint8)
            last = piece == count[doc] - 1
            begin = (stops - n + 1)[doc] + piece * capacity
            for at, size, ends in zip((4 * begin).tolist(), (4 * (length - last)).tolist(), last.tolist(), strict=True):
                crc = zlib.crc32(data[at : at + size])
                crcs.append(zlib.crc32(end, crc) if ends else crc)
            columns = [batch["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def match_runs(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit matching of runs of equal lengths to runs of equal gaps.

    Returns rows (length, first rank, first sequence, pieces per sequence, offset of the first), sorted by
    length and rank, and the number of sequences. Work and memory depend on ``capacity`` only.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    placed: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def take(length: int, rank: int, left: int, gap: int, first: int, n: int) -> int:
        """Puts up to ``left`` pieces into ``n`` sequences from ``first`` on, each with ``gap`` free; returns how many."""
        each = gap // length
        full, rest = divmod(min(left, n * each), each)
        offset = capacity - gap
        if full:
            placed.append((length, rank, first, each, offset))
            gaps.setdefault(gap - each * length, []).append((first, full))
        if rest:
            placed.append((length, rank + full * each, first + full, rest, offset))
            gaps.setdefault(gap - rest * length, []).append((first + full, 1))
        if over := n - full - bool(rest):
            gaps.setdefault(gap, []).append((first + full + bool(rest), over))
        return full * each + rest

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for gap in sorted(g for g in gaps if g >= length):
            runs = gaps.pop(gap)
            while runs and left:
                done = take(length, rank, left, gap, *runs.pop(0))
                rank, left = rank + done, left - done
            if runs:
                gaps.setdefault(gap, []).extend(runs)
            if not left:
                break
        if left:
            n = -(-left // (capacity // length))
            take(length, rank, left, capacity, sequences, n)
            sequences += n
        gaps.pop(0, None)
    return np.array(sorted(placed), np.int64).reshape(-1, 5), sequences


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs all documents; per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Two jobs: tokenizing with the range sort (written once), and the placement, a scan of that small table.
    """
    cut = pieces(docs, tokenizer, capacity, end_id)
    kept = stored(cut)  # tokenize once: the range sort samples its input first
    key = ["length", "doc_id", "piece", "ids_crc32"]
    dealt = kept.repartitionByRange(*key).sortWithinPartitions(*key)
    name, kind = docs.schema["doc_id"].name, docs.schema["doc_id"].dataType.simpleString()
    front = f"`{name}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Part number and place within (part, length), in sorted order."""
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for x in batches:
            length = x["length"].to_numpy()
            if not len(length):
                continue
            begins = np.flatnonzero(np.r_[True, length[1:] != length[:-1]])
            index = np.arange(len(length)) - np.repeat(begins, np.diff(np.r_[begins, len(length)]))
            if length[0] == last:
                index[: begins[1] if len(begins) > 1 else None] += seen
            last, seen = length[-1], index[-1] + 1
            yield x.assign(part=part, place=index)

    ranked = stored(dealt.mapInPandas(number, f"{front}, part int, place bigint"))
    # at most (parts + capacity) rows, since parts are ranges of lengths
    runs = ranked.groupBy("length", "part").agg(F.count("*").alias("n")).orderBy("length", "part").toPandas()
    counts = runs.groupby("length")["n"].sum()
    match, _ = match_runs({int(k): int(v) for k, v in counts.items()}, capacity)
    before = runs.groupby("length")["n"].cumsum() - runs["n"]
    wide = 1 << 40
    run_key = runs["part"].to_numpy(np.int64) * wide + runs["length"].to_numpy(np.int64)
    by_key = np.argsort(run_key)
    shared = docs.sparkSession.sparkContext.broadcast((run_key[by_key], before.to_numpy(np.int64)[by_key], match))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, firsts, rows = shared.value
        match_key = rows[:, 0] * wide + rows[:, 1]
        for x in batches:
            length = x["length"].to_numpy(np.int64)
            rank = firsts[np.searchsorted(keys, x["part"].to_numpy(np.int64) * wide + length)] + x["place"].to_numpy(np.int64)
            row = rows[np.searchsorted(match_key, length * wide + rank, "right") - 1]
            nth = rank - row[:, 1]
            x = x.drop(columns=["part", "place"])
            yield x.assign(sequence_id=row[:, 2] + nth // row[:, 3], offset=row[:, 4] + nth % row[:, 3] * length)

    return ranked.mapInPandas(place, f"{front}, sequence_id bigint, offset bigint")
