"""Runs of words in texts: maximal stretches that repeat with a period, found by recompression.

The words of many texts become one array of numbers, with a mark between texts. ``Grammar`` compresses it level by level, by turns: equal
neighbours become one symbol (block compression), then symbols are dealt to two sides and every pair of a left and a right
symbol becomes one (pair compression), until each text is one symbol. The symbols of a level are the nonterminals of a run-length
grammar, whose right sides are the symbols below.

Whether a phrase begins at a place depends on the two symbols beside it alone. So two places that agree for long have the same symbols above but
for a symbol at the edges, and the longest common extension of two places (``extend``) climbs while symbols agree, a constant number of
comparisons at each level, and comes down where they don't. All questions of a slice of texts climb together.

A run of period p has at least 4 p words, so among its places are 3 p in a row that agree with the place p later, and one of them is a multiple of
3 p. Candidates are these places of the harmonic grid (for each p up to a quarter of the text, in all about n ln(n) / 3) where the two words agree;
extending them both ways gives all runs and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, release
from .packing import gathered

#: Bytes of text worked on at once. A single longer text is a slice of its own; memory grows with it, about 20 bytes for each byte.
SLICE = 4_000_000

#: Candidates extended at once.
CANDIDATES = 2_000_000

LEAST_LENGTH, LEAST_POWER = 6, 4

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_TYPE = pa.struct([("n_runs", pa.int64()), *_RUN, ("exponent_milli", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
RESULT = "struct<n_runs:bigint,start:bigint,length:bigint,period:bigint,exponent_milli:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


class Grammar:
    """Levels of symbols: ``symbols[k]``; ``parents[k]``, the phrase of level k + 1 that a symbol is in; ``starts[k]``, where in level
    k - 1 each phrase begins; ``blocks[k]``, whether level k was made by block compression.

    The mark between texts is 0 and is never part of a phrase. A text that is one symbol is left out of the levels above.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols, self.parents, self.starts, self.blocks = [symbols], [], [np.zeros(0, np.int32)], [False]
        free, turn = int(symbols.max(initial=0)) + 1, 0
        while len(self.symbols[-1]) > 1:
            now = self.symbols[-1]
            block = turn % 2 == 0
            turn += 1
            inner = np.r_[False, now[1:] == now[:-1]] if block else self._pairs(now, turn)
            mark = np.flatnonzero(now == 0)
            single = mark[1:][np.diff(mark) == 2]  # marks of texts that are one symbol
            if not len(single) and not inner.any():
                continue
            starts = np.flatnonzero(~inner).astype(np.int32)
            sizes = np.diff(starts, append=len(now))
            up = now[starts]
            more = np.flatnonzero(sizes > 1)
            tail = sizes[more] if block else now[starts[more] + 1]
            names, name = np.unique(up[more] << 32 | tail, return_inverse=True)
            up[more] = free + name
            free += len(names)
            parents = np.cumsum(~inner, dtype=np.int32) - 1
            if len(single):
                stay = np.ones(len(up), bool)
                stay[parents[single]] = stay[parents[single - 1]] = False
                parents = (np.cumsum(stay, dtype=np.int32) - 1)[parents]
                starts, up = starts[stay], up[stay]
            self.parents.append(parents)
            self.symbols.append(up)
            self.starts.append(starts)
            self.blocks.append(block)

    @staticmethod
    def _pairs(now: np.ndarray, turn: int) -> np.ndarray:
        """Which symbols are the second of a pair: sides by a hash of the symbol, turned so that more pairs are made."""
        z = (now.astype(np.uint64) + np.uint64(turn << 40)) * np.uint64(0x9E3779B97F4A7C15)
        side = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63) == 1
        word = now != 0
        left, right = side & word, ~side & word
        ahead, back = left[:-1] & right[1:], right[:-1] & left[1:]
        return np.r_[False, ahead if np.count_nonzero(ahead) >= np.count_nonzero(back) else back]

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from places i and j on agree (``back``: of those before them), for i < j in the same text.

        A place is one before a symbol. Marks differ from all words, so that nothing reaches over a text's end.
        """
        i, j, step, side = i.astype(np.int32), j.astype(np.int32), -1 if back else 1, -1 if back else 0
        begin, stop = i.copy(), np.zeros(len(i), np.int32)
        live = np.arange(len(i))
        for level, now in enumerate(self.symbols):
            a, b = i[live], j[live]
            same = now[a + side] == now[b + side]
            stop[live[~same]] = level
            live, a, b = live[same], a[same], b[same]
            if not len(live):
                break
            parent, start = self.parents[level], self.starts[level + 1]
            inside = np.flatnonzero((start[parent[a]] != a) | (start[parent[b]] != b))
            if self.blocks[level + 1]:
                x, y = a[inside], b[inside]
                if back:
                    p, q = x - start[parent[x - 1]], y - start[parent[y - 1]]
                else:
                    p, q = start[parent[x] + 1] - x, start[parent[y] + 1] - y
                m = step * np.minimum(p, q)
                a[inside], b[inside] = x + m, y + m
                i[live], j[live] = a, b
                uneven = inside[p != q]  # one of them stands behind its block, the other inside: what follows differs
                stop[live[uneven]] = level
                on = np.ones(len(live), bool)
                on[uneven] = False
                live, a, b = live[on], a[on], b[on]
            else:  # a pair's second symbol: one step, and both stand between phrases
                a[inside] += step
                b[inside] += step
            i[live], j[live] = parent[a], parent[b]
        for level in range(int(stop.max(initial=0)), 0, -1):
            live = np.flatnonzero(stop >= level)
            start, now = self.starts[level], self.symbols[level - 1]
            p, q = i[live] + side, j[live] + side
            a, b = start[i[live]], start[j[live]]
            same = np.flatnonzero(now[a + side] == now[b + side])
            if self.blocks[level]:
                p, q, x, y = p[same], q[same], a[same], b[same]
                if back:
                    m = np.minimum(x - start[p], y - start[q])
                else:
                    m = np.minimum(start[p + 1] - x, start[q + 1] - y)
                a[same] = x + step * m
                b[same] = y + step * m
            else:
                a[same] += step
                b[same] += step
            i[live], j[live] = a, b
        return step * (i - begin)


def grid(first: np.ndarray, n: np.ndarray, reach: int = LEAST_POWER - 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates (text, place, period): for each period the multiples of ``reach`` times the period, about ``CANDIDATES`` at a time."""
    periods = n // (reach + 1)
    periods[n < LEAST_LENGTH] = 0
    text = np.repeat(np.arange(len(n)), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = -(-(n[text] - p) // (reach * p))
    ends = np.cumsum(count)
    at = 0
    while at < len(text):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")), at + 1)
        c = count[at:to]
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        own, period = np.repeat(text[at:to], c), np.repeat(p[at:to], c)
        yield own, first[own] + nth * (reach * period), period
        at = to


def runs_of(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts of ``n`` words, whose numbers (from 1 on) are ``words``: text, start, length, smallest period; in order of text, start, period."""
    some = np.flatnonzero(n >= LEAST_LENGTH)
    marked = np.zeros(len(words) + len(n) + 1, np.int64)
    first = np.cumsum(n) - n + np.arange(len(n)) + 1
    marked[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(words))] = words
    if len(some) < len(n):  # texts too short for a run stay away, empty ones too
        keep = np.repeat(n >= LEAST_LENGTH, n + 1)
        marked, first = np.r_[marked[:1], marked[1:][keep]], np.cumsum(n[some]) - n[some] + np.arange(len(some)) + 1
    grammar, found = Grammar(marked), [np.zeros((4, 0), np.int64)]
    for own, place, period in grid(first, n[some]):
        hit = marked[place] == marked[place + period]
        own, place, period = own[hit], place[hit], period[hit]
        ahead, behind = grammar.extend(place, place + period), grammar.extend(place, place + period, back=True)
        length = period + ahead + behind
        good = length >= np.maximum(LEAST_LENGTH, LEAST_POWER * period)
        found.append(np.array([some[own], place - behind - first[own], length, period])[:, good])
    text, start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start, text))  # one stretch is found for the multiples of its period too
    text, start, length, period = text[order], start[order], length[order], period[order]
    new = np.r_[True, (np.diff(text) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)][: len(text)]
    text, start, length, period = text[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and how many each has: maximal runs of other than the six ASCII blanks."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    split = pc.ascii_split_whitespace(trimmed)
    n = np.where(np.asarray(pc.binary_length(trimmed)) > 0, np.diff(np.asarray(split.offsets)), 0).astype(np.int64)
    flat = split.flatten()
    return (flat if len(flat) == n.sum() else flat.filter(pc.not_equal(flat, ""))), n


def texts_runs(texts: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, ...], pa.Array]:
    """Number of words and runs of each text, and the texts with runs collapsed to their first period."""
    words, n = split_words(texts)
    coded = words.dictionary_encode()
    text, start, length, period = runs_of(np.asarray(coded.indices).astype(np.int64) + 1, n)
    first = np.cumsum(n) - n
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, first[text] + start + period, 1)
    np.add.at(edge, first[text] + start + length, -1)
    kept = np.cumsum(edge)[:-1] == 0
    ends = np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(n)]].astype(np.int32)
    left = pa.ListArray.from_arrays(pa.array(ends), words.filter(pa.array(kept)))
    return n, (text, start, length, period), pc.binary_join(left, " ")


def _runs_udf():
    @F.arrow_udf(RESULT)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            whole = pa.RecordBatch.from_arrays([batch], names=["text"])
            for part in gathered(iter([whole]), SLICE):
                n, (text, start, length, period), collapsed = texts_runs(part["text"])
                count = np.bincount(text, minlength=len(n))
                best = np.lexsort((period, start, -length, text))[np.r_[0, np.cumsum(count)[:-1]][count > 0]]
                at, has = np.zeros(len(n), np.int64), count > 0
                at[has] = best
                none = ~has
                take = lambda x: pa.array(x[at] if len(x) else np.zeros(len(at), np.int64), pa.int64(), mask=none)
                runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), runs)
                milli = 1000 * length // np.maximum(period, 1)
                columns = [pa.array(count, pa.int64()), take(start), take(length), take(period), take(milli), runs, collapsed]
                parts.append(pa.StructArray.from_arrays(columns, names=["n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], _TYPE)
        release()

    return found


def find_runs(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is given too: a struct of all runs and the longest one, and the collapsed text.

    A run is a stretch of words with smallest period q and length of at least max(6, 4 q) that no neighbouring word extends keeping
    period q. ``collapsed`` joins by one space the words that no run contains after its first q words.

    Defined cases: null, empty and blank texts have no words and no run, and collapse to the empty text; of equally long runs the first by
    start, then period, counts as longest; repeated rows are worked on alike; an empty table gives no rows; other columns stay. A text is
    worked on as a whole in one task, with memory in proportion to it.
    """
    name = fresh(docs, "runs")
    return docs.withColumn(name, _runs_udf()("text")), name


def digest_runs(runs: Column) -> Column:
    """Lower-case hex SHA-256 of each run's ``start,length,period`` and a line feed."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.transform(runs, lambda r: F.concat(line(r), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)
