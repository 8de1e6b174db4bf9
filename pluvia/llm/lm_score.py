"""Class-based bigram language model: exchange clustering of words, smoothed probabilities, text scores.

Words: A-Z lower-cased, then ``[^\\x20\\x09-\\x0D]+``; every text ends with an end token, which is also the history
of the next text's first word.

Counting covers every training token. Clustering moves the core vocabulary: words with at least ``min_share``
of all tokens, of which there are at most 1 / min_share on any corpus, so that the class map can be sent to
every task. All rarer words begin in one class, in which their own counts still give their probabilities. With ``place_rare``
each of them then gets the class that adds most to the likelihood, by what stands before and after it, in one distributed round: rare
words are grouped by their hash, and neither they nor their classes pass through the driver to be placed. Class pairs are counted anew with them.

Exchange clustering is bulk-synchronous. One row per core word holds its neighbour counts (at most one per core
word and side). In each round every task computes, for its words, the change of the class bigram likelihood
for a move into each class, given the class counts of the round before, and moves the word to the best class;
after the first round only the words of one hashed half move at a time, so that words that depend on each
other don't swap for ever. The class counts give the likelihood of each round; the exchange ends when two rounds, one of each half,
raise it by less than ``LEAST_GAIN`` of itself, and the classes of the best round stay.

P(word | history) = (1 - weight) * unigram(word) + weight * (1 - u) * P(class | class of history) * P(word | class)
for known words and u for the unknown word, where the unigram is the add-0.1 estimate with one slot, u, for
unknown words, and class transitions are smoothed by the classes' own frequencies. It sums to 1 over the
vocabulary and the unknown word.

Scoring looks rare words up in sorted hashes if the vocabulary has at most ``broadcast_words`` words, and by a
join on the hash beyond that; both give the same result.

Defined cases: null text is empty and has just its end token; a null doc_id is hashed as the empty text;
without training rows every probability is 1 (log 0); repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fresh, release, slices, stored, texts

CLASSES = 64
MIN_SHARE = 4e-6
ROUNDS, LEAST_GAIN = 12, 1e-4
WEIGHT = 0.9
BROADCAST_WORDS = 8_000_000
END = b"\n"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, the end token included as a line feed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def batch() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for x in texts(b.column(0)):
                seen.update(x.translate(LOWER).split())
                seen[END] += 1
                if len(seen) > 200_000:
                    yield batch()
        yield batch()
        release()

    return docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Core:
    """Numbers of core words: 0 is the end token, ``size`` stands for every other word."""

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        self.number = {w: i for i, w in enumerate(words)}
        self.counts = np.array(counts, np.int64)
        self.size = len(words)

    def sequence(self, batch: list[bytes]) -> tuple[np.ndarray, list[list[bytes]]]:
        """Numbers of all tokens, each text closed by the end token, and the texts' words."""
        words = [x.translate(LOWER).split() for x in batch]
        out = np.zeros(sum(map(len, words)) + len(words), np.int64)
        at = 0
        for w in words:
            out[at : at + len(w)] = np.fromiter(map(self.number.get, w, repeat(self.size)), np.int64, len(w))
            at += len(w) + 1
        return out, words


def neighbours(docs: DataFrame, shared) -> tuple[DataFrame, int]:
    """One row per core word: number, arrays ``after`` and ``n_after``, ``before`` and ``n_before``; and how often two rare words meet."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core: Core = shared.value
        held: list[np.ndarray] = []

        def batch() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(codes // (core.size + 1), pa.int32()), pa.array(codes % (core.size + 1), pa.int32()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for b in batches:
            raw = texts(b.column(0))
            for i, j in slices(raw):
                own, _ = core.sequence(raw[i:j])
                held.append(np.r_[0, own[:-1]] * (core.size + 1) + own)
                if sum(map(len, held)) > 2_000_000:
                    yield batch()
        if held:
            yield batch()
        release()

    counted = stored(docs.select("text").mapInArrow(pairs, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")))
    size = shared.value.size
    rare = counted.filter((F.col("a") == size) & (F.col("b") == size)).agg(F.sum("n")).first()[0] or 0
    side = lambda w, other, sign: counted.filter(F.col(w) < size).select(F.col(w).alias("word"), F.struct(F.col(other).alias("o"), (sign * F.col("n")).alias("n")).alias("p"))
    both = side("a", "b", 1).unionByName(side("b", "a", -1))  # counts of words before are negative
    rows = both.groupBy("word").agg(F.collect_list("p").alias("p"))  # at most two per core word and other number
    return stored(rows.select("word", F.col("p.o").alias("other"), F.col("p.n").alias("n"))), int(rare)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word numbers; and per neighbour: index of the word in the batch, the neighbour, its signed count."""
    words = np.asarray(batch.column(0)).astype(np.int64)
    lists = batch.column(1)
    index = np.repeat(np.arange(len(words)), np.diff(np.asarray(lists.offsets)))
    return words, index, np.asarray(lists.flatten()).astype(np.int64), np.asarray(batch.column(2).flatten()).astype(np.int64)


def class_counts(rows: DataFrame, classes: np.ndarray, n_classes: int, rare: int) -> np.ndarray:
    """Counts of class pairs; ``classes`` maps word numbers, the last being that of rare words."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shared.value, np.zeros(n_classes * n_classes, np.int64)
        for b in batches:
            words, index, other, n = _flat(b)
            own, there, last = of[words][index], of[other], len(of) - 1
            after, from_rare = n > 0, (n < 0) & (other == last)
            total += np.bincount(own[after] * n_classes + there[after], n[after], n_classes**2).astype(np.int64)
            total += np.bincount(there[from_rare] * n_classes + own[from_rare], -n[from_rare], n_classes**2).astype(np.int64)
        yield pa.record_batch([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["pair", "n"])

    found = rows.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_classes * n_classes)
    out[np.asarray(found["pair"])] = np.asarray(found["n"])
    out = out.reshape(n_classes, n_classes)
    out[classes[-1], classes[-1]] += rare
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(total: np.ndarray) -> float:
    """What the classes of words add to the log likelihood of the text, from counts of class pairs."""
    return float(_xlogx(total).sum() - _xlogx(total.sum(0)).sum() - _xlogx(total.sum(1)).sum())


def best_classes(after: np.ndarray, before: np.ndarray, now: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The class of each word that adds most to sum n log n(c, c') - sum n log n(c) - sum n log n(c').

    ``after`` and ``before`` are the words' counts by neighbour class. What a word adds to its present class is
    measured with the word taken out of it. Class 0 (the end token) and the last one (rare words) take no word.
    """
    out = now.copy()
    row, column = total.sum(1), total.sum(0)
    for i in range(0, len(now), 128):
        a, b, c = after[i : i + 128], before[i : i + 128], now[i : i + 128]
        n_a, n_b = a.sum(1), b.sum(1)
        gain = (_xlogx(total + a[:, None, :]) - _xlogx(total)).sum(2) + (_xlogx(total.T + b[:, None, :]) - _xlogx(total.T)).sum(2)
        gain -= _xlogx(row + n_a[:, None]) - _xlogx(row) + _xlogx(column + n_b[:, None]) - _xlogx(column)
        left = lambda x, y: _xlogx(x) - _xlogx(np.maximum(x - y, 0))
        stay = left(total[c], a).sum(1) + left(total.T[c], b).sum(1) - left(row[c], n_a) - left(column[c], n_b)
        gain[np.arange(len(c)), c] = stay
        gain[:, [0, -1]] = -np.inf
        out[i : i + 128] = gain.argmax(1)
    return out


def exchange(rows: DataFrame, core: Core, rare: int, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each core word and of rare words (last), and the counts of class pairs.

    The most frequent words start with a class each; all others start with the rare words, and in the first
    round every one of them moves.
    """
    classes = np.full(core.size + 1, n_classes - 1)
    first = min(core.size, n_classes - 1)
    classes[:first] = np.arange(first)
    total = class_counts(rows, classes, n_classes, rare)
    best, gained = (likelihood(total), classes, total), []
    for k in range(rounds if core.size > 1 else 0):
        shared = rows.sparkSession.sparkContext.broadcast((classes, total))

        def move(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            of, pairs = shared.value
            for b in batches:
                words, index, other, n = _flat(b)
                turn = (words > 0) & ((k == 0) | ((words * 2654435761 >> 7) % 2 == k % 2))
                if k == 0:
                    turn &= of[words] == n_classes - 1
                place = index * n_classes + of[other]
                count = lambda keep, place=place, n=n, words=words: np.bincount(place[keep], abs(n[keep]), len(words) * n_classes).reshape(-1, n_classes)
                after, before = count(n > 0)[turn], count(n < 0)[turn]
                yield pa.record_batch([pa.array(words[turn]), pa.array(best_classes(after, before, of[words[turn]], pairs))], names=["word", "class"])

        found = rows.mapInArrow(move, "word bigint, class bigint").toArrow()  # core words only
        classes = classes.copy()
        classes[np.asarray(found["word"])] = np.asarray(found["class"])
        total = class_counts(rows, classes, n_classes, rare)
        gained.append(likelihood(total))
        if gained[-1] > best[0]:
            best = gained[-1], classes, total
        if len(gained) > 2 and gained[-1] - gained[-3] < LEAST_GAIN * abs(gained[-1]):
            break
    return best[1], best[2]


def rare_places(docs: DataFrame, shared, classes: np.ndarray, n_classes: int) -> DataFrame:
    """One row per rare token: hash of the word; classes before and after it as one number, ``n_classes`` for a rare word; the next word's hash if that is rare."""
    of_core = docs.sparkSession.sparkContext.broadcast(np.append(classes[:-1], n_classes))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core: Core = shared.value
        for b in batches:
            raw = texts(b.column(0))
            for i, j in slices(raw):
                own, words = core.sequence(raw[i:j])
                flat = [x for w in words for x in (*w, END)]
                at = np.flatnonzero(own == core.size)
                hashes = np.zeros(len(own), np.int64)
                hashes[at] = np.fromiter((xxhash.xxh64_intdigest(flat[k], 42) for k in at.tolist()), np.uint64, len(at)).view(np.int64)
                of = of_core.value[own]
                before = np.r_[of_core.value[0], of[:-1]]  # an end token before the first text
                after = at + 1  # a text ends with the end token, so that there is one
                following = pa.array(hashes[after], mask=own[after] != core.size)
                yield pa.record_batch([pa.array(hashes[at]), pa.array(before[at] * (n_classes + 1) + of[after], pa.int32()), following], names=["word", "pair", "following"])
        release()

    return stored(docs.select("text").mapInArrow(places, "word bigint, pair int, following bigint"))


def placed_classes(index: np.ndarray, before: np.ndarray, after: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The class of each rare word by the criterion of ``best_classes``; the last class is the one that all are in.

    One entry per token: number of its word (in order, from 0), classes before and after it. A word's neighbours fall in few classes, so
    sums run over those alone, and equal counts share their logarithms.
    """
    k = len(total)
    row, column = total.sum(1), total.sum(0)

    def gains(have: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What counts gain by ``n`` more; in the last class, what it would lose without them."""
        out = _xlogx(have + n[:, None]) - _xlogx(have)
        out[:, -1] = _xlogx(have[:, -1]) - _xlogx(np.maximum(have[:, -1] - n, 0))
        return out

    gain = np.zeros((index[-1] + 1, k))
    for there, table in ((after, total.T), (before, total)):
        codes, n = np.unique(index * k + there, return_counts=True)
        of, word = codes % k, codes // k
        kinds, kind = np.unique(of * (1 << 40) + n, return_inverse=True)
        own = gains(table[kinds >> 40], kinds & (1 << 40) - 1)
        gain += np.add.reduceat(own[kind], np.flatnonzero(np.r_[True, word[1:] != word[:-1]]))
    sizes, size = np.unique(np.bincount(index), return_inverse=True)
    gain -= (gains(np.broadcast_to(row, (len(sizes), k)), sizes) + gains(np.broadcast_to(column, (len(sizes), k)), sizes))[size]
    gain[:, 0] = -np.inf  # the end token's
    return gain.argmax(1)


def place_rare_words(places: DataFrame, total: np.ndarray, last: int) -> tuple[DataFrame, np.ndarray]:
    """(word, class) of every rare word by hash, and the counts of class pairs that have a rare word on one side or both."""
    k = len(total)
    shared = places.sparkSession.sparkContext.broadcast(total)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held = np.zeros(k * k, np.int64), []

        def batch(words: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            first = np.r_[True, words[1:] != words[:-1]]
            index = np.cumsum(first) - 1
            before, after = codes // (k + 1), codes % (k + 1)
            found = placed_classes(index, np.where(before == k, last, before), np.where(after == k, last, after), shared.value)
            own = found[index]
            pairs[:] += np.bincount((own * k + after)[after < k], minlength=k * k) + np.bincount((before * k + own)[before < k], minlength=k * k)
            return pa.record_batch([pa.array(words[first]), pa.array(found, pa.int32()), pa.nulls(len(found), pa.int64())], names=["word", "class", "n"])

        def cut(end: bool) -> Iterator[pa.RecordBatch]:
            """What is held, but for the last word, which may go on."""
            words, codes = (np.concatenate(c) for c in zip(*held, strict=True))
            most = len(words) if end else int(np.searchsorted(words, words[-1]))
            held[:] = [(words[most:], codes[most:])]
            if most:
                yield batch(words[:most], codes[:most])

        for b in batches:
            if b.num_rows:
                held.append((np.asarray(b.column(0)), np.asarray(b.column(1)).astype(np.int64)))
            if sum(len(w) for w, _ in held) > 50_000:
                yield from cut(False)
        if held:
            yield from cut(True)
        there = np.flatnonzero(pairs)
        yield pa.record_batch([pa.nulls(len(there), pa.int64()), pa.array(there, pa.int32()), pa.array(pairs[there])], names=["word", "class", "n"])
        release()

    sorted_ = places.select("word", "pair").repartition("word").sortWithinPartitions("word")
    found = stored(sorted_.mapInArrow(place, "word bigint, class int, n bigint"))  # rows without a word: counts of a pair of classes
    placed = found.filter("word IS NOT NULL").select("word", "class")
    both = places.filter("following IS NOT NULL").select("word", "following").join(placed.withColumnRenamed("class", "a"), "word")
    both = both.join(placed.select(F.col("word").alias("following"), F.col("class").alias("b")), "following")
    counts = both.groupBy((F.col("a") * k + F.col("b")).alias("pair")).agg(F.count("*").alias("n"))
    counts = counts.unionByName(found.filter("word IS NULL").groupBy(F.col("class").alias("pair")).agg(F.sum("n").alias("n"))).toArrow()  # pairs of classes
    out = np.zeros(k * k)
    np.add.at(out, np.asarray(counts["pair"]), np.asarray(counts["n"]))
    return placed, out.reshape(k, k)


@dataclass
class ClassModel:
    """Everything that scoring needs but the counts of rare words."""

    core: Core
    classes: np.ndarray
    transition: np.ndarray
    class_sizes: np.ndarray
    tokens: int
    words: int
    weight: float

    def parts(self, seen: np.ndarray, transition: np.ndarray, own_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of unigram and model probability, from a token's count, class transition and class."""
        unknown = 0.1 / (self.tokens + 0.1 * (self.words + 1))
        unigram = (seen + 0.1) / (self.tokens + 0.1 * (self.words + 1))
        emission = seen / np.maximum(self.class_sizes[own_class], 1)
        mixed = (1 - self.weight) * unigram + (1 - unknown) * self.weight * transition * emission
        return np.log10(unigram), np.log10(np.where(seen > 0, mixed, unigram))


def learn(docs: DataFrame, n_classes: int = CLASSES, min_share: float = MIN_SHARE, rounds: int = ROUNDS, weight: float = WEIGHT, place_rare: bool = False) -> tuple[ClassModel, DataFrame]:
    """The model learned from all rows of ``docs``, and the table (word, n) of its whole vocabulary.

    With ``place_rare`` the table has a third column, ``class``: that of each word outside the core.
    """
    vocabulary = stored(word_counts(docs))
    sums = vocabulary.agg(F.sum("n"), F.count("*")).first()
    tokens, words = int(sums[0] or 0), int(sums[1])
    frequent = vocabulary.filter((F.col("n") >= min_share * tokens) & (F.col("word") != "\n")).orderBy(F.desc("n"), "word").collect()
    end = vocabulary.filter("word = '\\n'").first()
    core = Core([END, *(r["word"].encode() for r in frequent)], [end["n"] if end else 0, *(r["n"] for r in frequent)])
    shared = docs.sparkSession.sparkContext.broadcast(core)
    rows, rare = neighbours(docs, shared)
    classes, total = exchange(rows, core, rare, n_classes, rounds)
    if place_rare:
        places = rare_places(docs, shared, classes, n_classes)
        placed, with_rare = place_rare_words(places, total, int(classes[-1]))
        total = class_counts(rows, np.append(classes[:-1], n_classes), n_classes + 1, rare)[:n_classes, :n_classes] + with_rare
        vocabulary = stored(vocabulary.join(placed.withColumnRenamed("word", "hash"), F.xxhash64("word") == F.col("hash"), "left").select("word", "n", "class"))
    sizes = total.sum(0)
    shares = sizes / max(sizes.sum(), 1)
    transition = (total + n_classes * shares) / (total.sum(1, keepdims=True) + n_classes)
    return ClassModel(core, classes, transition, sizes, tokens, words, weight if tokens else 0.0), vocabulary


def _score_udf(model, known):
    """Sums per text; with ``known`` (sorted hashes, counts and classes of all words) rare words are in them.

    Else they are listed, and so are words after them: hash, or class and count of a core word; the hash before it, or the class of a core word.
    """
    item = pa.struct([("hash", pa.int64()), ("own", pa.int32()), ("seen", pa.int64()), ("before", pa.int64()), ("history", pa.int32()), ("n", pa.int32())])

    @F.arrow_udf("struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double,rare:array<struct<hash:bigint,own:int,seen:bigint,before:bigint,history:int,n:int>>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m: ClassModel = model.value
        core, rare_class = m.core, int(m.classes[-1])
        for batch in batches:
            raw = texts(batch)
            sums: list[list[np.ndarray]] = [[], [], [], []]
            rare: list[Counter] = []
            for i, j in slices(raw, 1_000_000):
                own, words = core.sequence(raw[i:j])
                of = m.classes[own]
                sizes = np.array([len(w) + 1 for w in words], np.int64)
                begin = np.cumsum(sizes) - sizes
                seen = np.append(core.counts, 0)[own].astype(np.float64)
                at = np.flatnonzero(own == core.size)
                doc = np.searchsorted(begin, at, "right") - 1
                hashes = np.fromiter((xxhash.xxh64_intdigest(words[d][p], 42) for d, p in zip(doc.tolist(), (at - begin[doc]).tolist(), strict=True)), np.uint64, len(at)).view(np.int64)
                if known is not None:
                    keys, counts, placed = known.value
                    if len(keys):
                        place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                        seen[at] = np.where(keys[place] == hashes, counts[place], 0)
                        of[at] = np.where(keys[place] == hashes, placed[place], rare_class)
                    rare += [Counter()] * len(words)
                history = np.r_[m.classes[0], of[:-1]]
                base, full = m.parts(seen, m.transition[history, of], of)
                if known is None:
                    found = [Counter() for _ in words]
                    hash_of = dict(zip(at.tolist(), hashes.tolist(), strict=True))
                    listed = np.unique(np.r_[at, at + 1])  # never beyond the last end token
                    for d, i in zip((np.searchsorted(begin, listed, "right") - 1).tolist(), listed.tolist(), strict=True):
                        core_word = i not in hash_of
                        found[d][hash_of.get(i), int(of[i]) if core_word else None, int(seen[i]) if core_word else None, hash_of.get(i - 1), int(history[i])] += 1
                    rare += found
                    base[at] = full[listed] = 0
                for column, value in zip(sums, (np.ones(len(own), np.int64), (seen > 0).astype(np.int64), base, full), strict=True):
                    column.append(np.add.reduceat(value, begin))
            ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            flat = [(*key, n) for r in rare for key, n in r.items()]
            columns = zip(*flat, strict=True) if flat else ((),) * len(item)
            rows = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, item, strict=True)], fields=list(item))
            done = [pa.array(np.concatenate(c)) if c else pa.array([], t) for c, t in zip(sums, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            yield pa.StructArray.from_arrays([*done, pa.ListArray.from_arrays(pa.array(ends), rows)], names=["n_tokens", "n_known", "base_score", "score", "rare"])
        release()

    return score


def score(docs: DataFrame, model: ClassModel, vocabulary: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> tuple[DataFrame, str]:
    """``docs`` with one more column (its name is returned too): struct n_tokens, n_known, base_score, score (log10)."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    name = fresh(docs, "lm")
    rare_class = F.lit(int(model.classes[-1]))
    own_class = F.coalesce("class", rare_class) if "class" in vocabulary.columns else rare_class
    if model.words <= broadcast_words:
        found = vocabulary.select(F.xxhash64("word").alias("h"), "n", own_class.cast("smallint").alias("class")).toArrow()
        keys, counts, placed = (np.asarray(found[c]) for c in ("h", "n", "class"))
        order = np.argsort(keys)
        counts = counts.astype(np.int32 if not len(counts) or counts.max() < 1 << 31 else np.int64)
        known = context.broadcast((keys[order], counts[order], placed[order]))
        return docs.withColumn(name, _score_udf(shared, known)("text")), name
    row, lm = f"{name}row", F.col(name)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(name, _score_udf(shared, None)("text")))
    rare = rows.select(F.col(row).alias("row"), F.explode(f"{name}.rare").alias("r")).select("row", "r.*")
    known = vocabulary.select(F.xxhash64("word").alias("hash"), F.col("n").alias("known_n"), own_class.alias("known_class"))
    joined = rare.join(known, "hash", "left").join(known.select(F.col("hash").alias("before"), F.col("known_class").alias("known_before")), "before", "left")
    seen = F.coalesce("seen", "known_n", F.lit(0)).cast("double")
    joined = joined.select("row", "n", F.col("hash").isNull().alias("core"), seen.alias("seen"), F.coalesce("own", "known_class", rare_class).alias("own"), F.when(F.col("before").isNull(), F.col("history")).otherwise(F.coalesce("known_before", rare_class)).alias("history"))
    k = len(model.transition)
    move = model.transition / np.maximum(model.class_sizes, 1) * model.weight * (1 - 0.1 / (model.tokens + 0.1 * (model.words + 1)))
    moves = docs.sparkSession.createDataFrame([(i, j, float(move[i, j])) for i in range(k) for j in range(k)], "history int, own int, move double")
    joined = joined.join(F.broadcast(moves), ["history", "own"])  # pairs of classes
    seen = F.col("seen")
    unigram = (seen + 0.1) / (model.tokens + 0.1 * (model.words + 1))
    sums = joined.groupBy("row").agg(
        F.sum(F.when(~F.col("core") & (seen > 0), F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.when(F.col("core"), 0.0).otherwise(F.col("n") * F.log10(unigram))).alias("b"),
        F.sum(F.col("n") * F.log10(F.when(seen > 0, (1 - model.weight) * unigram + F.col("move") * seen).otherwise(unigram))).alias("s"),
    )
    out = rows.join(sums, rows[row] == sums["row"], "left")
    zero = F.lit(0.0)
    full = F.struct(
        lm["n_tokens"].alias("n_tokens"),
        (lm["n_known"] + F.coalesce("k", F.lit(0))).alias("n_known"),
        (lm["base_score"] + F.coalesce("b", zero)).alias("base_score"),
        (lm["score"] + F.coalesce("s", zero)).alias("score"),
    )
    return out.withColumn(name, full).select(*docs.columns, name), name
