"""How the filters of a cleaning chain interact: what each removes in every order, and what only it would remove.

Failing exact copies are found by an existential self-join: a left-semi join on the text's hash, the exact text and a smaller doc_id.
Its ids and the other failures (kind, row) are united, each row's failures become one bit mask, and rows are counted per
part and mask. There are at most 2^filters masks, and every order of the filters is worked out from their counts alone: a document
passes the filters before a step if its mask has none of their bits.

No group of copies meets itself: the join's right side has one row for each distinct text, the smallest doc_id that has it (summed up
before the shuffle), and both sides are dealt out by hash and salt. A text has one salt for each ``1 / HOT`` of all rows that it has, so its copies
are spread over tasks however many there are, and the salts of all texts together are at most ``HOT`` plus one for each text.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A text gets one salt more for each such share of all rows.
HOT = 1000

#: Rows of (hash, salts) that may be broadcast, 12 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

BLANK = r"[\x20\x09-\x0D]+"


def repeats_smaller(docs: DataFrame, row: list[str], hashes: DataFrame, n_rows: int) -> DataFrame:
    """The distinct ``row`` columns of ``docs`` (doc_id, text, hash, ...) whose text some smaller doc_id has too.

    ``hashes`` has a row (hash) for each row of ``docs``, without texts. Rows without doc_id neither repeat nor are repeated.
    """
    several = hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    several = several.select("hash", F.ceil(F.col("n") * HOT / F.lit(max(n_rows, 1))).cast("int").alias("salts"))
    several = stored(several)
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    copies = docs.filter("doc_id IS NOT NULL").join(several, "hash")
    first = copies.groupBy("hash", "text", "salts").agg(F.min("doc_id").alias("first"))
    right = first.select("hash", "text", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).alias("b")
    left = copies.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).alias("a")
    same = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.text") == F.col("b.text"))
    return left.join(right, same & (F.col("b.first") < F.col("a.doc_id")), "left_semi").select(*row).distinct()


def failure_masks(docs: DataFrame, filters: dict[str, Column], repeats: str | None, part: Column) -> DataFrame:
    """(doc_id, part, mask, rows): per document the bits of the filters it fails, in the order of ``filters``, then ``repeats``.

    ``filters`` gives each failure condition over the columns of ``docs``; ``repeats`` names the condition that an exact copy fails.
    """
    rows = docs.select("doc_id", part.alias("part"), F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(c, F.lit(False)).alias(f"fails_{k}") for k, c in enumerate(filters.values())])
    rows = rows.withColumn("hash", F.xxhash64("text"))
    key = ["doc_id", "part", "hash"]
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"fails_{k}"), 1 << k).otherwise(0) for k in range(len(filters))], F.lit(0))
    narrow = stored(rows.select(*key, mask.alias("mask")))
    found = narrow.select(*key, "mask", F.lit(1).alias("rows"))
    if repeats is not None:
        texts = rows.select(*key, "text")
        again = repeats_smaller(texts, key, narrow.select("hash"), narrow.count())
        found = found.unionByName(again.select(*key, F.lit(1 << len(filters)).alias("mask"), F.lit(0).alias("rows")))
    return found.groupBy(*key).agg(F.bit_or("mask").alias("mask"), F.sum("rows").alias("rows")).drop("hash")


def audit_orders(masks: DataFrame, weights: dict[str, Column], names: str) -> DataFrame:
    """One row per part, order of all filters and step, from (part, mask, rows) and further columns that ``weights`` are made of.

    The counts of a part are one row (at most 2^filters entries), and the orders are a fixed table. A document that fails m
    filters is removed by each of them in the same number of orders, all orders over m.
    """
    totals = {"rows": F.sum("rows"), **{w: F.sum(F.when(c, F.col("rows")).otherwise(0)) for w, c in weights.items()}}
    counts = masks.groupBy("part", "mask").agg(*[c.alias(w) for w, c in totals.items()])
    counts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *totals)).alias("counts"))
    bit = {name: 1 << k for k, name in enumerate(names)}
    orders = list(permutations(names))
    steps = [{"filter_order": "".join(o), "step": k + 1, "own": bit[f], "before": sum(bit[x] for x in o[:k])} for o in orders for k, f in enumerate(o)]
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    own, before = F.col("own"), F.col("before")

    def total(what: str, of) -> Column:
        """Sum of ``what`` over masks, times ``of`` (a condition, or a number)."""
        return F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x[what] * of(x["mask"]).cast("long"))

    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    share = lambda m: F.when(fails(m), F.lit(len(orders)) / F.bit_count(m)).otherwise(0)
    return counts.select("part", "counts", F.inline(table)).select(
        "part",
        "filter_order",
        "step",
        total("rows", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("rows", removed).alias("removed"),
        total("rows", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("rows", lambda m: m == own).alias("unique_fails"),
        *[total(w, removed).alias(w) for w in weights],
        total("rows", share).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], repeats: str | None = "E", part: Column | None = None) -> DataFrame:
    """All orders of the filters: per part, order and step what is kept, removed, redundant, lost, and the filter's Shapley sum.

    ``filters`` maps one letter to each failure condition over ``docs``; ``labels`` (doc_id, quality, toxic) says what is good
    (quality 1) and toxic (toxic 1).

    Defined cases: a null text is empty; a condition that is null doesn't fail; a null part is the empty string; every row counts, repeated
    ones too; rows without doc_id never fail ``repeats``, have no label, and count; of a doc_id's labels any one is enough; an
    empty table gives no rows; other columns are ignored.
    """
    part = F.coalesce((F.lit("") if part is None else part).cast("string"), F.lit(""))
    masks = failure_masks(docs, filters, repeats, part)
    of_doc = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = masks.join(of_doc, F.col("doc_id") == F.col("labelled"), "left")
    names = "".join(filters) + (repeats or "")
    return audit_orders(known, {"good_lost": F.col("good") == 1, "toxic_lost": F.col("toxic") == 1}, names)


def text_filters() -> dict[str, Column]:
    """A: under 200 words; B: under half of the words are distinct; C: over 2 % capitals; D: holds a symbol of code or markup."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, BLANK), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }
