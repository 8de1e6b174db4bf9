"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter table serves all languages: a position holds one bit per language, so the AND of an n-gram's
positions returns, at once, every language that contains it. A language contains an n-gram if it makes up at
least ``least_share`` of the language's n-grams (so no language has more than 1 / least_share of them, and the
filter's size and error are bounded on any corpus) and at least ``ratio`` of its largest share in any language.
A text's popcount per language, corrected for the filter's false positives, decides.

N-grams: every letter with the letter before it in its word and the two after it; words are runs of letters,
lower-cased, and n-grams stop at their ends.

Defined cases: text that is null or has no letter is ``und`` with score 0; so is everything if there is no row
to learn from; rows with null language teach nothing; ties go to the language first in sort order; repeated
rows count as often as they occur; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, slices, stored, texts

UNKNOWN = "und"
POSITIONS = 1 << 22
HASHES = 3
_P = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether a code point is a letter; built once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def cut_long(text: bytes, most: int = 1_000_000) -> list[bytes]:
    """Pieces of a very long text, cut at blanks (n-grams never cross them) or, inside a longer word, between characters."""
    out = []
    while len(text) > most:
        at = text.rfind(b" ", 1, most)
        if at < 0:
            at = most
            while text[at] & 0xC0 == 0x80:
                at -= 1
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


def grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams, and for each the piece it is in."""
    coded = [np.frombuffer(x.decode().lower().encode("utf-32-le"), np.uint32) for x in pieces]
    sizes = np.array([len(c) + 3 for c in coded], np.int64)
    codes = np.zeros(sizes.sum() + 3, np.uint64)
    for c, begin in zip(coded, np.cumsum(sizes) - sizes, strict=True):
        codes[begin + 1 : begin + 1 + len(c)] = c
    codes[~letter_table()[codes.astype(np.int64)]] = 0
    at = np.flatnonzero(codes)
    before, own, after, last = codes[at - 1], codes[at], codes[at + 1], codes[at + 2]
    last = np.where(after > 0, last, 0)
    mixed = ((before * _P + own) * _P + after) * _P + last
    mixed ^= mixed >> np.uint64(29)
    return mixed * _P, np.repeat(np.arange(len(pieces)), sizes)[at]


def places(hashes: np.ndarray, k: int) -> np.ndarray:
    """Filter positions of the k-th hash function (double hashing)."""
    step = (hashes >> np.uint64(40)) | np.uint64(1)
    return ((hashes + np.uint64(k) * step * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(20) & np.uint64(POSITIONS - 1)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            raw = texts(batch.column(1))
            for lang in sorted(set(langs)):
                own = [p for x, g in zip(raw, langs, strict=True) if g == lang for p in cut_long(x)]
                for a, b in slices(own, 1_000_000):
                    found, n = np.unique(grams(own[a:b])[0], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
        release()

    spread = docs.filter("lang IS NOT NULL").select(F.col("lang").cast("string"), F.col("text")).mapInArrow(count, "lang string, gram bigint, n bigint")
    return spread.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageFilter:
    """The learned filter: languages, bit table (positions x bytes of languages) and its false-positive rates."""

    def __init__(self, languages: list[str], table: np.ndarray) -> None:
        self.languages, self.table = languages, table
        self.wrong = [float(np.mean(self.bit(table, i))) ** HASHES for i in range(len(languages))]

    @staticmethod
    def bit(masks: np.ndarray, language: int) -> np.ndarray:
        return masks[:, language >> 3] >> np.uint8(language & 7) & np.uint8(1)

    def predict(self, batch: list[bytes]) -> tuple[list[str], list[float]]:
        cut = [cut_long(x) for x in batch]
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        pieces = [p for c in cut for p in c]
        total, hits = np.zeros(len(batch)), np.zeros((len(batch), len(self.languages)))
        for a, b in slices(pieces, 1_000_000):
            hashes, piece = grams(pieces[a:b])
            doc = owner[a:b][piece]
            masks = self.table[places(hashes, 0)]
            for k in range(1, HASHES):
                masks &= self.table[places(hashes, k)]
            total += np.bincount(doc, minlength=len(batch))
            for i in range(len(self.languages)):
                hits[:, i] += np.bincount(doc[self.bit(masks, i) > 0], minlength=len(batch))
        if not self.languages:
            return [UNKNOWN] * len(batch), [0.0] * len(batch)
        wrong = np.array(self.wrong)
        sure = np.clip((hits - total[:, None] * wrong) / np.maximum(1 - wrong, 1e-9), 0, None)
        best = sure.argmax(1)
        score = np.clip(sure[np.arange(len(batch)), best] / np.maximum(total, 1), 0, 1)
        return [self.languages[i] if n else UNKNOWN for i, n in zip(best, total, strict=True)], score.tolist()


def learn_languages(docs: DataFrame, ratio: float = 0.3, least_share: float = 1e-6) -> LanguageFilter:
    """Learns from text and lang of all rows of ``docs``. The driver receives the filter, whose size is fixed."""
    counts = stored(gram_counts(docs))
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()  # one row per language
    languages = [r["lang"] for r in sums]
    width = max(1, -(-len(languages) // 8))
    table = np.zeros((POSITIONS, width), np.uint8)
    if languages:
        share = F.create_map(*[x for r in sums for x in (F.lit(r["lang"]), F.lit(1.0 / r["total"]))])
        rated = counts.withColumn("share", F.col("n") * share[F.col("lang")])
        most = rated.groupBy("gram").agg(F.max("share").alias("most"))
        kept = rated.join(most, "gram").filter((F.col("share") >= least_share) & (F.col("share") >= ratio * F.col("most")))
        number = {g: i for i, g in enumerate(languages)}

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                index = np.array([number[g] for g in batch.column(0).to_pylist()], np.int64)
                hashes = np.asarray(batch.column(1)).view(np.uint64)
                for k in range(HASHES):
                    yield pa.record_batch([pa.array(places(hashes, k)), pa.array(index >> 3), pa.array(np.int64(1) << (index & 7))], names=["place", "byte", "bit"])

        bits = kept.select("lang", "gram").mapInArrow(spread, "place bigint, byte bigint, bit bigint").groupBy("place", "byte").agg(F.bit_or("bit").alias("bits"))
        found = bits.toArrow()
        table[np.asarray(found["place"]), np.asarray(found["byte"])] = np.asarray(found["bits"]).astype(np.uint8)
    return LanguageFilter(languages, table)


def predict_languages(docs: DataFrame, model: LanguageFilter) -> tuple[DataFrame, str]:
    """``docs`` with one more column (its name is returned too): struct lang_pred, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = fresh(docs, "language")

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            raw = texts(batch)
            langs: list[str] = []
            scores: list[float] = []
            for a, b in slices(raw, 1_000_000):
                own = shared.value.predict(raw[a:b])
                langs += own[0]
                scores += own[1]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])
        release()

    return docs.withColumn(name, predict("text")), name


def accepted(language: Column, least_score: float = 0.0) -> Column:
    """What a corpus filter keeps: texts in a learned language, with more than ``least_score`` of n-grams it contains."""
    return (language["lang_pred"] != UNKNOWN) & (language["score"] > least_score)
