"""Filter audit, run detection and batched byte-pair merges against SQL, brute force and the tokenizer itself."""

import hashlib
import os
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pluvia.llm import bpe_rounds, filter_audit, periodic_runs, queries

DATA = "/root/testdata/sf0.001"
TOKENIZER = queries.tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, source string, hash string, mask string, runs string, __runs string, coded string"
LONG = " ".join(f"word{i} and{i % 13}" for i in range(60_000)) + "."
HARD = [None, "", " \t\n", "a", "A b", "a b a b a b a b", "?!", "x" * 5000, "ê ü", "one two three four. " * 9, LONG, LONG, "same text here", "same text here", "a " * 7, "#"]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and very long texts, ties, repeated rows, a null id, and other columns with clashing names."""
    rows = [(i, x, ["s", None, ""][i % 3], "h", "m", "r", "u", "c") for i, x in enumerate(HARD)]
    rows += [rows[-1], rows[5], (None, "same text here", "s", None, None, None, None, None), (3, "another text of id 3", "s", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- filter audit -------------------------------------------------------------------------------------------


def brute_masks(rows):
    """Failed filters per row as a set of letters."""
    out = []
    for doc, text, _ in rows:
        s = text or ""
        w = words(s)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", s)) > 2 * len(s), "D": bool(re.search(r"[#$%&*|]", s))}
        fails["E"] = doc is not None and any(d is not None and d < doc and (t or "") == s for d, t, _ in rows)
        out.append({f for f, x in fails.items() if x})
    return out


def brute_audit(rows, good, toxic):
    out = {}
    masks = brute_masks(rows)
    for part in {p or "" for _, _, p in rows}:
        own = [(d, m) for (d, _, p), m in zip(rows, masks, strict=True) if (p or "") == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                kept = [x for x in left if f not in x[1]]
                removed_in_all[f] += len(gone)
                failing = sum(f in m for _, m in own)
                lost = [sum(d in which for d, _ in gone) for which in (good, toxic)]
                out[part, "".join(order), k + 1] = [len(kept), len(gone), failing - len(gone), sum(m == {f} for _, m in own), *lost]
                left = kept
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(removed_in_all[f])
    return out


def audit_rows(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_equals_sql(spark):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = queries.op11_filter_audit(spark, DATA).select(*names)
    assert {t for _, t in got.dtypes[3:]} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(db.sql(queries.OP11_SQL).select(*names).fetchall())


def test_audit_hard_cases(spark, hard, empty):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (4, 1, None), (None, 1, 1), (99, 1, 1), (13, None, 1)], "doc_id bigint, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in hard.collect()]
    found = audit_rows(filter_audit.audit_filters(hard, labels, filter_audit.text_filters(), "E", F.col("source")))
    assert found == brute_audit(rows, {3, 4}, {3, 13})
    assert filter_audit.audit_filters(empty, labels, filter_audit.text_filters()).count() == 0
    assert filter_audit.audit_filters(hard, labels.limit(0), {"X": F.lit(None).cast("boolean"), "Y": F.lit(True)}, None).agg(F.sum("removed")).first()[0] == 2 * len(rows)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_copies_of_a_crowd_are_dealt_out(spark, monkeypatch, broadcast):
    """A third of all rows has one text; the joins find what brute force finds, by a broadcast of hashes and by a shuffle."""
    monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", broadcast)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 4))).alias("text"))
    docs = docs.withColumns({"part": F.lit(""), "hash": F.xxhash64("text")})
    found = filter_audit.repeats_smaller(docs, ["doc_id"], docs.select("hash"), 3000)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    assert sorted(r[0] for r in found.collect()) == [d for d in sorted(texts) if first[texts[d]] < d]


def test_copies_need_the_exact_text(spark):
    docs = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "a", 7)], "doc_id bigint, text string, hash bigint")
    assert [r[0] for r in filter_audit.repeats_smaller(docs, ["doc_id"], docs.select("hash"), 3).collect()] == [3]


# -- runs ---------------------------------------------------------------------------------------------------


def brute_runs(w):
    """(start, length, period) of all runs, from the agreement of words a period apart."""
    best = {}
    for p in range(1, len(w) // 4 + 1):
        begin = None
        for k in range(len(w) - p + 1):
            if k < len(w) - p and w[k] == w[k + p]:
                begin = k if begin is None else begin
            elif begin is not None:
                if k - begin + p >= max(6, 4 * p):
                    best[begin, k - begin + p] = min(best.get((begin, k - begin + p), p), p)
                begin = None
    return sorted((s, n, p) for (s, n), p in best.items())


def brute_collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc, text):
    w, h = words(text), zlib.crc32(b"" if doc is None else str(doc).encode())
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def test_runs_against_brute_force(spark, given):
    rows = queries.op12_periodic_runs(spark, DATA).collect()
    assert len(rows) == len(given)
    some = 0
    for r in rows:
        w = planted(r["doc_id"], given[r["doc_id"]])
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r["collapsed_sha256"] == sha(brute_collapsed(w, runs))
        some += bool(runs)
    assert some > 10


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 12)):
            n, kinds = rng.choice([0, 1, 5, 6, 7, 20, 60, 150]), rng.choice([1, 2, 3, 50])
            w = [rng.randint(1, kinds) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
            docs.append(w)
        text, start, length, period = periodic_runs.runs_of(np.array([x for w in docs for x in w], np.int64), np.array([len(w) for w in docs]))
        for d, w in enumerate(docs):
            own = text == d
            assert list(zip(start[own].tolist(), length[own].tolist(), period[own].tolist(), strict=True)) == brute_runs(w)


def test_extensions_against_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        w = [rng.randint(1, 2) for _ in range(40)] * rng.randint(1, 3) + [rng.randint(1, 2) for _ in range(rng.randint(2, 30))]
        grammar = periodic_runs.Grammar(np.array([0, *w, 0]))
        pairs = np.array([sorted(rng.sample(range(1, len(w) + 1), 2)) for _ in range(200)])
        ahead, back = grammar.extend(pairs[:, 0], pairs[:, 1]), grammar.extend(pairs[:, 0], pairs[:, 1], back=True)
        for (i, j), f, b in zip(pairs.tolist(), ahead.tolist(), back.tolist(), strict=True):
            i, j = i - 1, j - 1
            assert f == next((k for k in range(len(w)) if j + k == len(w) or w[i + k] != w[j + k]))
            assert b == next((k for k in range(len(w)) if i - k == 0 or w[i - k - 1] != w[j - k - 1]))


def test_grammar_expands_to_its_text():
    """Every level's symbols stand for the words between their phrases' begins, equal symbols for equal words."""
    rng = random.Random(3)
    words_ = np.array([0, *[rng.randint(1, 3) for _ in range(500)], 0, *[1] * 300, 0])
    grammar, begin = periodic_runs.Grammar(words_), np.arange(len(words_))
    for level in range(1, len(grammar.symbols)):
        begin = begin[grammar.starts[level]]
        seen, symbols = {}, grammar.symbols[level]
        for k in range(len(symbols) - 1):
            if symbols[k]:
                text = tuple(words_[begin[k] : begin[k + 1]].tolist())
                assert seen.setdefault(int(symbols[k]), text) == text
    assert len(grammar.symbols) < 60


def test_runs_hard_cases(spark, hard, empty):
    out, name = periodic_runs.find_runs(hard)
    assert out.columns == [*hard.columns, name]
    for r in out.collect():
        w, m = words(r["text"]), r[name]
        if len(w) < 10_000:
            runs = brute_runs(w)
            assert [tuple(x) for x in m["runs"]] == runs and m["collapsed"] == brute_collapsed(w, runs)
        else:
            assert m["n_runs"] == 0 and m["start"] is None and m["collapsed"] == r["text"]
    assert periodic_runs.find_runs(empty)[0].count() == 0


def test_a_long_text_of_one_word_has_one_run(spark):
    docs = spark.createDataFrame([(1, "na " * 20_000), (2, "x y z " * 7_000)], "doc_id bigint, text string")
    out, name = periodic_runs.find_runs(docs)
    found = {r["doc_id"]: ([tuple(x) for x in r[name]["runs"]], r[name]["collapsed"]) for r in out.collect()}
    assert found == {1: ([(0, 20_000, 1)], "na"), 2: ([(0, 21_000, 3)], "x y z")}


# -- byte pairs ---------------------------------------------------------------------------------------------


def differing(encoder, texts):
    """Texts whose ids or decoded text differ from the tokenizer's own."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids, stops = encoder.encode(pa.array(texts, pa.string()))
    decoded, begin, bad = encoder.decode(ids, stops).to_pylist(), 0, []
    for text, stop, own, x in zip(texts, stops.tolist(), tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False), decoded, strict=True):
        if ids[begin:stop].tolist() != own.ids or x != tokenizer.decode(own.ids, skip_special_tokens=False):
            bad.append(text)
        begin = stop
    return bad


@pytest.fixture(scope="module")
def encoder():
    return bpe_rounds.RoundEncoder(TOKENIZER)


def test_every_character_encodes_as_in_the_tokenizer(encoder):
    assert differing(encoder, [f"a{chr(c)}b{chr(c)}" for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]) == []


@pytest.mark.parametrize("everywhere", [True, False])
def test_random_texts_encode_as_in_the_tokenizer(encoder, monkeypatch, everywhere):
    """Also with every pair merged at its leftmost place only."""
    if not everywhere:
        monkeypatch.setattr(encoder, "everywhere", np.zeros_like(encoder.everywhere))
    rng = random.Random(2)
    parts = ["a", "b", "'s", "'LL", " ", "\t", "\n", " ", "́", "e", "İ", "Σ", "ß", "ﬁ", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "1", "23", "!!", "...", "日本", "🙂", "x" * 70, "\x1c", "\x85", "the", "THE", "ing", " ", "\x00", "aaaa"]
    texts = [None, "", " \n", " ", "x" * 5000, "ab" * 3000, "é" * 3000, *["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(5000)]]
    assert differing(encoder, texts) == []


def test_coded_documents_equal_the_tokenizer(spark, given):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = queries.op13_bpe_rounds(spark, DATA).collect()
    assert len(rows) == len(given)
    for r in rows:
        own = tokenizer.encode(given[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(own, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), sha(decoded))


def test_coded_hard_cases(spark, hard, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    out, name = bpe_rounds.encode_decode(hard, TOKENIZER)
    assert out.columns == [*hard.columns, name] and out.count() == len(HARD) + 4
    for r in out.collect():
        own = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r[name]["ids"], "<u4").tolist() == own
        assert r[name]["decoded"] == tokenizer.decode(own, skip_special_tokens=False)
    assert bpe_rounds.encode_decode(empty, TOKENIZER)[0].count() == 0
