"""Winnowing fingerprints of documents, with DataFrame functions only.

Units are words; a word of more than ``LONG`` code points, and every word of a text with fewer than ``w + k - 1``
words, counts as its code points instead, so that texts without blanks have positions and k-grams too. Whether a
word is long depends on the word alone, so both texts that share it cut it alike.

Units are hashed, k-gram hashes are Karp-Rabin polynomials of unit hashes (mod 2^31 - 1), and of every window
of ``w`` consecutive k-grams the smallest hash is chosen, the rightmost on ties. Any two texts that share
``w + k - 1`` consecutive units share a chosen hash. k and w are powers of two, so that both the polynomials
and the window minima come from doubling: a k-gram from two halves, a window's minimum from two halves.
A chosen k-gram is one number: hash * 2^31 + (2^31 - 1 - position); the smallest number is the smallest hash at
the rightmost position, and both can be read from it.

Defined cases: null text is empty; a text without words has no fingerprint, and two such texts have likeness
1; fewer than k units are one k-gram, fewer than w k-grams one window; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 4
W = 4

#: Longer words are URLs, tables in one string, or texts of a script without blanks.
LONG = 32

_MOD = 2147483647
_BASE = 1000003


def _pairs(values: Column, apart: int, combine) -> Column:
    """combine(values[i], values[i + apart]) for all i."""
    n = F.greatest(F.size(values) - apart, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, apart + 1, n), combine)


def _polynomial(power: int):
    """The hash of two neighbouring halves, the second ``power`` = base^length long."""
    return lambda x, y: (x * F.lit(power).cast("long") + y) % F.lit(_MOD).cast("long")


def _with_units(rows: DataFrame, text: str, out: str, least: int) -> DataFrame:
    """``rows`` with the hashes of a text's units as ``out``; code points stand for words where there are fewer than ``least``."""
    words = f"{out}_words"
    hashed = lambda x: F.pmod(F.xxhash64(x), F.lit(_MOD).cast("long"))
    few = F.size(words) < least
    letters = lambda x: F.transform(F.array_remove(F.split(x, ""), ""), hashed)
    cut = F.flatten(F.transform(F.col(words), lambda x: F.when(few | (F.length(x) > LONG), letters(x)).otherwise(F.array(hashed(x)))))
    rows = rows.withColumn(words, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), ""))
    return rows.withColumn(out, F.when(few | F.exists(words, lambda x: F.length(x) > LONG), cut).otherwise(F.transform(words, hashed))).drop(words)


def with_fingerprint(rows: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """``rows`` with the array column ``out``: the chosen k-grams of the column ``text``, in order of position.

    Every step is a column of its own, so that each is computed once per row.
    """
    step = f"{out}_0"
    rows = _with_units(rows, text, step, w + k - 1)
    missing = F.when(F.size(step) == 0, F.lit(0)).otherwise(F.greatest(F.lit(k) - F.size(step), F.lit(0)))
    names = [step]

    def then(column: Column) -> None:
        nonlocal rows
        names.append(f"{out}_{len(names)}")
        rows = rows.withColumn(names[-1], column)

    then(F.concat(F.col(step), F.array_repeat(F.lit(0).cast("long"), missing)))
    power, apart = _BASE, 1
    while apart < k:
        then(_pairs(F.col(names[-1]), apart, _polynomial(power)))
        power, apart = power * power % _MOD, 2 * apart
    then(F.transform(F.col(names[-1]), lambda x, i: F.shiftleft(x, 31) + (F.lit(_MOD).cast("long") - i)))
    grams, apart = names[-1], 1
    while apart < w:
        then(_pairs(F.col(names[-1]), apart, lambda x, y: F.least(x, y)))
        apart *= 2
    few = F.size(grams) < w
    chosen = F.when(few & (F.size(grams) > 0), F.array(F.array_min(grams))).otherwise(F.array_distinct(F.col(names[-1])))
    return rows.withColumn(out, chosen).drop(*names)


def hashes(chosen: Column) -> Column:
    """The distinct hashes of chosen k-grams."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 31).cast("int")))


def positions(chosen: Column) -> Column:
    """(position in units, hash) of chosen k-grams."""
    return F.transform(chosen, lambda x: F.struct((F.lit(_MOD).cast("long") - x.bitwiseAND(_MOD)).cast("int").alias("position"), F.shiftright(x, 31).alias("hash")))


def likeness(a: str, b: str) -> Column:
    """Shared hashes by all hashes of two hash sets (columns), 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def digest(chosen: Column) -> Column:
    """Text form of a fingerprint: SHA-256 of all chosen hashes with their positions."""
    return F.sha2(F.array_join(chosen.cast("array<string>"), ","), 256)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, fingerprint: array of (position, hash)) of every row."""
    return with_fingerprint(docs.select("doc_id", "text"), "text", "chosen", k, w).select("doc_id", positions(F.col("chosen")).alias("fingerprint"))


def successors(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, next_id, m) for each distinct doc_id: the next in order, the first after the last; and whether ids repeat.

    ``m`` is a quarter of the longest text with that id. Ids are range-sorted; a row that is the last of its
    range takes the first of the next range, from a table with one row per range.
    """
    ids = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).cast("int").alias("m"), F.count("*").alias("n"))
    dealt = stored(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    repeated = not dealt.filter("n > 1").isEmpty()
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first"))
    after = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"))  # one row per range
    start = dealt.agg(F.min("doc_id").alias("start"))
    within = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    out = dealt.withColumn("within", within).join(F.broadcast(after), "part").join(F.broadcast(start))
    return out.select("doc_id", F.coalesce("within", "after", "start").alias("next_id"), "m"), repeated


def compare_edited(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text and of its edited text (the last quarter replaced by the next document's start).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next
    document is the one with the next larger doc_id, or the first; of several rows with that id it is the one
    with the smallest start. A row without doc_id has no next document: nothing replaces its last quarter.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    following, repeated = successors(texts)
    known = texts.filter("doc_id IS NOT NULL")  # the same rows on both sides of the joins: their texts are shuffled once
    side = known.join(following.withColumnRenamed("doc_id", "before_id"), F.col("doc_id") == F.col("next_id"))
    side = with_fingerprint(side, "text", "chosen", k, w)
    side = side.select(F.col("before_id").alias("doc_id"), F.expr("substring(text, 1, m)").alias("head"), hashes(F.col("chosen")).alias("next_hashes"))
    if repeated:
        side = side.groupBy("doc_id").agg(F.min(F.struct("head", "next_hashes")).alias("s")).select("doc_id", "s.*")
    alone = texts.filter("doc_id IS NULL").select("*", F.lit(None).cast("string").alias("head"), F.lit(None).cast("array<int>").alias("next_hashes"))
    rows = known.join(side, "doc_id", "left").unionByName(alone).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 4)), coalesce(substring(head, 1, int(n_chars div 4)), ''))"))
    rows = with_fingerprint(with_fingerprint(rows, "text", "chosen", k, w), "edited", "edited_chosen", k, w)
    rows = rows.withColumns({"own": hashes(F.col("chosen")), "other": hashes(F.col("edited_chosen")), "next": F.coalesce("next_hashes", F.array().cast("array<int>"))})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("chosen")).alias("fingerprint"),
        digest(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
    )
