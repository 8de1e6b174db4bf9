"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A stage's result is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.common import small_batches, stored, table
from pluvia.llm.decontaminate import remove_contaminated
from pluvia.llm.language_id import accepted, learn_languages, predict_languages
from pluvia.llm.packing import best_fit_pack
from pluvia.llm.queries import tokenizer_path
from pluvia.llm.similar import drop_near_duplicates
from pluvia.llm.substring_dedup import remove_repeated_spans


#: Score that a text needs in its language. On the given tables texts have 0.59 and more; letters in random order have 0.31 at most.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no learned language: without letters, or with under ``LEAST_SCORE`` of n-grams that the language has.

    Learns from all rows with a language. Null and empty texts go; with no language to learn from all go; repeated rows are
    decided alike.
    """
    small_batches(spark)
    out, name = predict_languages(docs, learn_languages(docs))
    return out.filter(accepted(F.col(name), LEAST_SCORE)).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, the smallest doc_id, of each group of near copies.

    Texts without words are one group; different texts under one doc_id are decided apart; rows without doc_id come last.
    """
    small_batches(spark)
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from texts; a document of which nothing is left goes.

    Null and empty texts stay; of rows equal in doc_id and text the first keeps its passages.
    """
    small_batches(spark)
    return remove_repeated_spans(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark. Null and wordless texts hold none; repeated rows go alike."""
    small_batches(spark)
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences. Null and empty texts are an end token; repeated rows are packed one by one."""
    small_batches(spark)
    return best_fit_pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language models, XXH64 fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
