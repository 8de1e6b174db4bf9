"""Substring deduplication by sliding runs of sentences.

From every sentence on, the run of consecutive sentences that has at least ``run`` sentences and ``min_words``
words is hashed; equal runs meet in one global grouping; the first by (doc_id, text hash, place) stays, and every sentence that any later run covers
is removed from its text.

Two scans keep shuffles small. The first counts 64-bit run hashes. The second brings (128-bit hash, place) of
only those runs whose hash was counted more than once; a bitmap made from the repeated hashes tells tasks which
runs to leave out, and the exact grouping after it corrects the bitmap's false positives. Its size follows the number
of repeated hashes, from 4 MB up to ``MOST_BITS``, beyond which more single runs pass it and are sorted out by the grouping.
Counting and first places are partial aggregates, and the first places are taken out by an anti-join over hash and
place, so a passage that a third of all documents share does not meet in one task.

Sentences end after ``.``, ``!`` or ``?`` before white space, and at line ends. Every sentence is cut further into
pieces, and all that is said of sentences here holds for pieces: in each ``WINDOW`` consecutive words of a sentence the
one with the smallest hash (the last of equal ones) ends a piece, so pieces have at most ``WINDOW`` words and cuts
depend only on the ``WINDOW`` - 1 words on each side. A passage that repeats has the same pieces from its eighth word
to its eighth last, whatever it is glued to: of 51 words, the first whole piece begins with the sixteenth at the latest
and its run takes at most 24, so every repeated passage of over 50 words has a common run.

A task works on all texts of a slice together: words, cuts, runs and hashes are array operations.

Defined cases: null text stays null and has no sentence; a text with fewer than ``run`` sentences is one run,
if it has ``min_words``; of rows equal in doc_id and text one counts, and the others lose all that a run covers; runs repeat
within a document as they do across; a null doc_id sorts first; empty tables work; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fresh, release, repeats, scratch_scope, slices, stored, texts

RUN = 3
MIN_WORDS = 15
WINDOW = 8

#: Bits of the index into the bitmap of repeated hashes: 4 MB at least, 128 MB at most.
LEAST_BITS, MOST_BITS = 25, 30

#: Odd multipliers of the hashes: of bytes in a word, and of words in a run (two).
_BYTES, _WORDS = 0x9E3779B97F4A7C15, (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)

_BLANK, _END, _LOW = np.zeros(256, bool), np.zeros(256, bool), np.frombuffer(LOWER, np.uint8).astype(np.uint64)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_END[list(b".!?")] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Pieces:
    """Words and pieces of several texts. Offsets of texts are into words and pieces, those of pieces into words."""

    word_begin: np.ndarray  # bytes, from the begin of the text
    word_end: np.ndarray
    hashes: np.ndarray  # of words, A-Z in lower case
    first: np.ndarray  # the word with which each piece begins, and the number of words
    of_text: np.ndarray  # the piece with which each text begins, and the number of pieces


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - begin
    if not len(n):
        return np.zeros(0, np.uint64)
    low = _mixed(_LOW + np.uint64(1))[data[~_BLANK[data]]]
    first = np.cumsum(n) - n
    place = np.arange(len(low)) - np.repeat(first, n)
    return _mixed(np.add.reduceat(low * _powers(_BYTES, int(n.max()))[place], first) ^ n.astype(np.uint64))


def pieces(raw: list[bytes]) -> Pieces:
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    text_begin = np.cumsum([0, *(len(x) + 1 for x in raw)])
    edge = np.diff(_BLANK[data].view(np.int8), prepend=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = word_hashes(data, begin, end)
    lines = np.flatnonzero(data == 10)
    stop = _END[data[end - 1]] | (lines[np.searchsorted(lines, end)] < np.append(begin[1:], len(data))) if len(begin) else np.zeros(0, bool)
    cut = stop.copy()
    if len(begin) >= WINDOW:
        sentence = np.cumsum(stop) - stop
        place = np.arange(len(begin), dtype=np.uint64)
        least = (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - place)  # of equal hashes the last
        width = 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        inside = sentence[: len(least)] == sentence[WINDOW - 1 :]
        cut[np.uint64(0xFFFFFFFF) - (least[inside] & np.uint64(0xFFFFFFFF))] = True
    first = np.concatenate([[0], np.flatnonzero(cut) + 1])
    word_text = np.searchsorted(text_begin, begin, "right") - 1
    base = text_begin[word_text]
    return Pieces(begin - base, end - base, hashes, first, np.searchsorted(first, np.searchsorted(begin, text_begin)))


def runs_of(p: Pieces, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, begin, end) of each run, begin and end as numbers of pieces, by text and place.

    A run goes from its sentence over the fewest that are ``run`` sentences and ``min_words`` words; its place is the
    sentence's number in the text. One more run, its place the number of sentences, is the shortest such that ends with the
    text, if no other is. A text of fewer than ``run`` sentences is a run if it has the words.
    """
    size = np.diff(p.of_text)
    text = np.repeat(np.arange(len(size)), size)
    begin = np.arange(len(text))
    least = np.minimum(run, size)
    end = np.maximum(begin + least[text], np.searchsorted(p.first, p.first[:-1] + min_words))
    whole = end <= p.of_text[1:][text]
    long = np.flatnonzero(p.first[p.of_text[1:]] - p.first[p.of_text[:-1]] >= max(min_words, 1))
    last_end = p.of_text[1:][long]
    last = np.minimum(last_end - least[long], np.searchsorted(p.first, p.first[last_end] - min_words, "right") - 1)
    new = end[last] != last_end
    text = np.concatenate([text[whole], long[new]])
    place = np.concatenate([(begin - np.repeat(p.of_text[:-1], size))[whole], size[long[new]]])
    order = np.lexsort((place, text))
    return text[order], place[order], np.concatenate([begin[whole], last[new]])[order], np.concatenate([end[whole], last_end[new]])[order]


def run_hashes(p: Pieces, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """One of the two hashes of each run: the sum of word hash times base^place, from differences of running sums."""
    own = _mixed(p.hashes + np.uint64(_WORDS[which]))
    down, up = _powers(pow(_WORDS[which], -1, 1 << 64), len(own) + 1), _powers(_WORDS[which], len(own) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * down[:-1], dtype=np.uint64)])
    a, b = p.first[begin], p.first[end]
    return _mixed((sums[b] - sums[a]) * up[a] ^ (b - a).astype(np.uint64))


def _scan_runs(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    """(high): the first hash of every run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = texts(batch.column(0))
            for a, b in slices(raw):
                p = pieces(raw[a:b])
                _, _, begin, end = runs_of(p, run, min_words)
                yield pa.RecordBatch.from_pydict({"high": run_hashes(p, begin, end).view(np.int64)})
        release()

    return docs.select("text").mapInArrow(scan, "high bigint")


def _scan_places(docs: DataFrame, run: int, min_words: int, bits: int, bitmap) -> DataFrame:
    """(doc_id, text_hash, place, high, low) of the runs whose hash the bitmap has."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmap.value
        for batch in batches:
            raw = texts(batch["text"])
            for a, b in slices(raw):
                p = pieces(raw[a:b])
                text, place, begin, end = runs_of(p, run, min_words)
                high = run_hashes(p, begin, end)
                bit = (high >> np.uint64(64 - bits)).astype(np.int64)
                keep = (known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                at = pa.array(text[keep] + a)
                columns = [batch["doc_id"].take(at), batch["text_hash"].take(at), pa.array(place[keep], pa.int32()), pa.array(high[keep].view(np.int64))]
                low = run_hashes(p, begin[keep], end[keep], 1).view(np.int64)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(low)], names=["doc_id", "text_hash", "place", "high", "low"])
        del known
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(scan, f"doc_id {kind}, text_hash bigint, place int, high bigint, low bigint")


def _bitmap(repeated: DataFrame) -> tuple[int, np.ndarray]:
    """The repeated hashes' leading bits as a bitmap, and how many bits; the driver receives at most its bytes, in groups of 8."""
    bits = min(max(math.ceil(math.log2(repeated.count() + 1)) + 4, LEAST_BITS), MOST_BITS)
    bit = F.shiftrightunsigned("high", 64 - bits)
    word = repeated.groupBy(F.shiftrightunsigned(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("bits"))
    out = np.zeros(1 << (bits - 6), "<i8")
    found = word.toArrow()
    out[np.asarray(found["word"])] = np.asarray(found["bits"])
    return bits, out.view(np.uint8)


def repeated_places(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, places): for each text with repeats, the places of its non-first runs, as a written table."""
    with scratch_scope(docs.sparkSession) as keep:
        return keep(_repeated_places(docs, run, min_words))


def _repeated_places(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    repeated = stored(_scan_runs(docs, run, min_words).groupBy("high").agg(F.count("*").alias("n")).filter("n > 1").select("high"))
    bits, bitmap = _bitmap(repeated)
    rows = stored(_scan_places(docs, run, min_words, bits, docs.sparkSession.sparkContext.broadcast(bitmap)))  # it is read twice
    at = F.struct("doc_id", "text_hash", "place")
    first = rows.groupBy("high", "low").agg(F.min(at).alias("at")).select("high", "low", "at.*")
    keys = ["high", "low", "doc_id", "text_hash", "place"]
    a, b = rows.alias("a"), first.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if k == "doc_id" else F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    later = a.join(b, same, "left_anti")
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))


def _cut_udf(run: int, min_words: int):
    @F.arrow_udf("struct<n_sentences:int,n_removed:int,text:string>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, places, extra in batches:
            raw, left = texts(batch), batch.cast(pa.binary()).to_pylist()
            total, removed = [], []
            for a, b in slices(raw):
                p = pieces(raw[a:b])
                text, place, begin, end = runs_of(p, run, min_words)
                some = np.searchsorted(text, np.arange(b - a + 1))
                for i, (at, all_) in enumerate(zip(places.slice(a, b - a).to_pylist(), extra.slice(a, b - a).to_pylist(), strict=True)):
                    lo, hi = p.of_text[i], p.of_text[i + 1]
                    total.append(int(hi - lo))
                    removed.append(0)
                    if not at and not all_:
                        continue
                    own = slice(some[i], some[i + 1])
                    hit = np.ones(own.stop - own.start, bool) if all_ else np.isin(place[own], at)
                    gone = np.zeros(hi - lo + 1, np.int64)
                    np.add.at(gone, begin[own][hit] - lo, 1)
                    np.add.at(gone, end[own][hit] - lo, -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    removed[-1] = int(gone.sum())
                    if removed[-1]:
                        x = raw[a + i]
                        begins = np.append(p.word_begin[p.first[lo:hi]], len(x)).tolist()
                        kept = [x[: begins[0]], *(x[begins[k] : begins[k + 1]] for k in np.flatnonzero(~gone).tolist())]
                        left[a + i] = b"".join(kept).rstrip()
            yield pa.StructArray.from_arrays([pa.array(total, pa.int32()), pa.array(removed, pa.int32()), pa.array(left, pa.binary()).cast(pa.string())], names=["n_sentences", "n_removed", "text"])
        release()

    return cut


def dedup_spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> tuple[DataFrame, str]:
    """``docs`` with one more column (its name is returned too): struct n_sentences, n_removed, text (what is left)."""
    name = fresh(docs, "spans")
    side = repeated_places(docs, run, min_words).select(
        F.col("doc_id").alias(f"{name}id"), F.col("text_hash").alias(f"{name}hash"), F.col("places").alias(f"{name}places")
    )
    docs = repeats(docs, f"{name}extra")
    same = docs["doc_id"].eqNullSafe(F.col(f"{name}id")) & (F.xxhash64(docs["text"]) == F.col(f"{name}hash"))
    out = docs.join(side, same, "left").withColumn(name, _cut_udf(run, min_words)("text", f"{name}places", f"{name}extra"))
    return out.drop(f"{name}id", f"{name}hash", f"{name}places", f"{name}extra"), name


def remove_repeated_spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and ``n_chars``, if there, as it is then.

    A document of which no sentence is left goes; others stay, with all columns.
    """
    out, name = dedup_spans(docs, run, min_words)
    left: Column = F.col(name)["text"]
    lost = (F.col(name)["n_removed"] > 0) & (F.col(name)["n_removed"] == F.col(name)["n_sentences"])
    columns = []
    for f in docs.schema:
        new = left if f.name == "text" else F.length(left).cast(f.dataType) if f.name == "n_chars" else F.col(f"`{f.name}`")
        columns.append(new.alias(f.name))
    return out.filter(~lost).select(*columns)
