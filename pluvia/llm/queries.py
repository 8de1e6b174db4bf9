"""One query per operator, over whole tables; SQL for those that SQL can express."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .bpe_rounds import encode_decode
from .chat_format import format_windows, read_back
from .common import remainder, table
from .decontaminate import find_contamination
from .filter_audit import audit_filters, text_filters
from .importance import resample
from .language_id import learn_languages, predict_languages
from .lm_score import learn, score
from .packing import best_fit_pack
from .periodic_runs import digest_runs, find_runs
from .sharding import extendible_shards
from .simhash import near_duplicates
from .substring_dedup import dedup_spans
from .winnowing import compare_edited


#: The text of both turns of the conversation that is added to the given ones.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), 10) == 0)
    model, vocabulary = learn(docs.filter("NOT held_out"), place_rare=True)
    out, name = score(docs, model, vocabulary)
    m = F.col(name)
    return out.select(
        "doc_id",
        "held_out",
        m["n_tokens"].alias("n_tokens"),
        m["n_known"].alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        m["base_score"].alias("base_score"),
        m["score"].alias("score"),
        F.pow(F.lit(10.0), -m["score"] / m["n_tokens"]).alias("perplexity"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", f"{name}.*")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    turns = turns.unionByName(spark.createDataFrame(more, "conv_id bigint, turn bigint, role string, text string"))
    return read_back(format_windows(turns, tokenizer_path("byte_bpe_50k.json")))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    model = learn_languages(docs.filter("NOT held_out"))
    out, name = predict_languages(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", f"{name}.lang_pred", f"{name}.score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    m = F.col(name)
    return out.select(
        "doc_id",
        m["n_words"].alias("n_words"),
        m["n_hit"].alias("n_hit"),
        F.size(m["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(m["item_ids"], ","), 256).alias("items_sha256"),
        (m["n_hit"] > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spans AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, spans.n, p, item_id FROM spans JOIN windows USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND coalesce(toxic, 0) = 0")
    return resample(table(spark, sf_dir, "documents"), good)


def op9_extendible_shards(spark: SparkSession, sf_dir: str, limit: int = 16 << 20) -> DataFrame:
    out, name = extendible_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), limit)
    return out.select("doc_id", f"{name}.*")


def small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a limit that even small tables exceed, so that buckets split."""
    return op9_extendible_shards(spark, sf_dir, SMALL_SHARD)


#: Bytes of a shard in ``small_shards``, over the longest document that the given tables hold.
SMALL_SHARD = 200_000

OP9_SQL = """
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
levels AS (SELECT doc_id, n_bytes, h, depth, h >> (60 - depth) AS p FROM d, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS depth)),
buckets AS (
  SELECT depth, p, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
  FROM levels GROUP BY depth, p HAVING sum(n_bytes) <= LIMIT OR min(h) = max(h)),
first AS (SELECT doc_id, h, min(depth) AS depth FROM levels JOIN buckets USING (depth, p) GROUP BY doc_id, h)
SELECT d.doc_id, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(b.p), f.depth, '0') END AS shard, f.depth, d.n_bytes, b.shard_bytes, b.shard_docs
FROM d JOIN first f ON d.doc_id = f.doc_id AND d.h = f.h JOIN buckets b ON b.depth = f.depth AND b.p = d.h >> (60 - f.depth)
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), text_filters(), "E", F.col("source"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
bits AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(w) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(s) - length(regexp_replace(s, '[A-Z]', '', 'g'))) > 2 * length(s) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(s, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY s) THEN 16 ELSE 0 END AS mask FROM t),
known AS (
  SELECT part, mask, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
  FROM bits LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM known GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS o FROM letters v, letters w, letters x, letters y, letters z
  WHERE v.b + w.b + x.b + y.b + z.b = 31 AND len(list_distinct([v.b, w.b, x.b, y.b, z.b])) = 5),
steps AS (SELECT filter_order, step, o[step] AS own, coalesce(list_sum(o[1 : step - 1]), 0) AS before FROM (SELECT filter_order, o, unnest(range(1, 6)) AS step FROM orders)),
audit AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (before + own)::INT = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before::INT = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before::INT <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails, coalesce(sum(n_good) FILTER (mask & own <> 0 AND mask & before::INT = 0), 0) AS good_lost,
    coalesce(sum(n_toxic) FILTER (mask & own <> 0 AND mask & before::INT = 0), 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM audit
"""


@F.arrow_udf(StringType())
def _periodic(texts: pa.Array, g: pa.Array) -> pa.Array:
    """Texts of which each word from some word on is that of one of the first words from there on; null stays."""
    out = []
    for x, k in zip(texts.cast(pa.binary()).to_pylist(), g.to_pylist(), strict=True):
        w = x.split() if x else []
        if w:
            a = k % len(w)
            p = 1 + (len(w) - a) // (3 + k % 8)
            x = b" ".join(w[:a] + [w[a + i % p] for i in range(len(w) - a)])
        out.append(x)
    return pa.array(out, pa.binary()).cast(pa.string())


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The documents, of which those whose hash is divisible by 10 repeat words with a period from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = _periodic(F.when(h % 10 == 0, F.col("text")), F.floor(h / 10))
    return docs.withColumn("text", F.coalesce(own, F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = find_runs(with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    m = F.col(name)
    longest = [m[c].alias(c) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    return out.select("doc_id", *longest, digest_runs(m["runs"]).alias("runs_sha256"), F.sha2(m["collapsed"], 256).alias("collapsed_sha256"))


def op13_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    m = F.col(name)
    return out.select("doc_id", m["n_tokens"].alias("n_tokens"), F.sha2(m["ids"], 256).alias("ids_sha256"), F.sha2(m["decoded"], 256).alias("decoded_sha256"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_winnowing": op4_winnowing,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_extendible_shards": op9_extendible_shards,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_bpe_rounds": op13_bpe_rounds,
    "small_shards": small_shards,
}

ORACLES = {"op7_decontaminate": OP7_SQL, "op9_extendible_shards": OP9_SQL.replace("LIMIT", str(16 << 20)), "op11_filter_audit": OP11_SQL, "small_shards": OP9_SQL.replace("LIMIT", str(SMALL_SHARD))}
