"""The training-data operators against brute force, on given tables and on small hard cases."""

import itertools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pluvia.llm import chat_format, decontaminate, importance, language_id, lm_score, merges, packing, queries, sharding, simhash, similar, substring_dedup, winnowing
from pluvia.llm.components import components

DATA = "/root/testdata/sf0.001"
TOKENIZER = queries.tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, match string, fp string, __shard string"
LONG = " ".join(f"word{i} and{i % 13}" for i in range(60_000)) + "."
HARD = [None, "", " \t\n", "a", "A b", "a b. c", "?!", "x" * 5000, "ê ü", "one two three four. " * 9, LONG, LONG, "same text here", "same text here"]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, and other columns with clashing names."""
    rows = [(i, x, ["en", None, "fr"][i % 3], "m", "f", "s") for i, x in enumerate(HARD)]
    rows += [rows[-1], rows[5], (None, "no id", "en", None, None, None), (3, "another text of id 3", "en", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


# -- language model -----------------------------------------------------------------------------------------


def test_lm_base_scores(spark, given):
    rows = queries.op1_lm_score(spark, DATA).collect()
    assert len(rows) == len(given)
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in given}
    counts = Counter(t for d, x in given.items() if not out[d] for t in [*words(x), "\n"])
    n, v = sum(counts.values()), len(counts)
    better = [0.0, 0.0]
    for r in rows:
        tokens = [*words(given[r["doc_id"]]), "\n"]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out[r["doc_id"]], len(tokens), n)
        assert r["n_known"] == sum(counts[t] > 0 for t in tokens)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        if r["held_out"]:
            better[0] += r["base_score"]
            better[1] += r["score"]
    assert better[1] > better[0]


def test_lm_probabilities_sum_to_one(spark, given):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    model, vocabulary = lm_score.learn(docs, n_classes=8, min_share=1e-3, rounds=3)
    counts = {r["word"]: r["n"] for r in vocabulary.collect()}
    core = model.core.number
    for history in range(8):
        total = 0.0
        for w, n in counts.items():
            c = model.classes[core.get(w.encode(), model.core.size)]
            total += 10 ** model.parts(np.array([n]), model.transition[history, [c]], np.array([c]))[1][0]
        unknown = 10 ** model.parts(np.array([0]), np.array([0.0]), np.array([0]))[1][0]
        assert total + unknown == pytest.approx(1, abs=1e-6)


def test_lm_scores_against_the_formula(spark, given):
    """Scores from classes alone: counts of class pairs, transitions and mixtures are worked out anew."""
    docs = spark.createDataFrame([*list(given.items())[:80], (None, None), (-1, ""), (-1, "")], "doc_id bigint, text string")
    learned = [(d, x) for d, x in [*list(given.items())[:80], (None, None), (-1, ""), (-1, "")] if d is None or d % 2]
    model, vocabulary = lm_score.learn(docs.filter("doc_id IS NULL OR doc_id % 2 <> 0"), n_classes=12, min_share=1e-3, rounds=4)
    out, name = lm_score.score(docs, model, vocabulary)
    of = lambda t: int(model.classes[0 if t == "\n" else model.core.number.get(t.encode(), model.core.size)])
    tokens = {i: [*words(x), "\n"] for i, (_, x) in enumerate(learned)}
    count, pairs = Counter(t for ts in tokens.values() for t in ts), Counter()
    for ts in tokens.values():
        pairs.update((of(p), of(t)) for p, t in itertools.pairwise(["\n", *ts]))
    n, v, k, weight = sum(count.values()), len(count), 12, 0.9
    into, out_of = Counter(), Counter()
    for (a, b), m in pairs.items():
        out_of[a] += m
        into[b] += m
    unknown = 0.1 / (n + 0.1 * (v + 1))

    def log_p(history, t):
        unigram = (count[t] + 0.1) / (n + 0.1 * (v + 1))
        if not count[t]:
            return math.log10(unigram)
        a, b = of(history), of(t)
        move = (pairs[a, b] + k * into[b] / n) / (out_of[a] + k)
        return math.log10((1 - weight) * unigram + weight * (1 - unknown) * move * count[t] / into[b])

    for r in out.collect():
        ts = ["\n", *words(r["text"]), "\n"]
        assert r[name]["score"] == pytest.approx(sum(log_p(h, t) for h, t in itertools.pairwise(ts)), rel=1e-9)


def test_lm_join_path_equals_broadcast_path(spark, hard):
    docs = hard.unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", *[F.lit("x").alias(c) for c in ("match", "fp", "__shard")]).limit(50))
    model, vocabulary = lm_score.learn(docs.filter("doc_id % 2 = 0"), n_classes=8, min_share=1e-3, rounds=2)
    rows = []
    for limit in (10**9, 0):
        out, name = lm_score.score(docs, model, vocabulary, broadcast_words=limit)
        rows.append(sorted(out.select("doc_id", "text", *[F.round(f"{name}.{c}", 6).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]).collect(), key=repr))
    assert rows[0] == rows[1]


def test_exchange_raises_the_likelihood(spark):
    random.seed(1)
    groups = [["red", "blue", "green", "pink"], ["runs", "sits", "eats", "naps"], ["quickly", "slowly", "often", "never"]]
    texts = [" ".join(random.choice(groups[k % 3]) for k in range(30)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model, _ = lm_score.learn(docs, n_classes=5, min_share=1e-6, rounds=5)
    of = {w.decode(): model.classes[i] for w, i in model.core.number.items()}
    start, _ = lm_score.learn(docs, n_classes=5, min_share=1e-6, rounds=0)
    pairs = lambda m: lm_score.likelihood(np.array([[sum(m.classes[m.core.number[a.encode()]] == i and m.classes[m.core.number[b.encode()]] == j for x in texts for a, b in itertools.pairwise(x.split())) for j in range(5)] for i in range(5)], float))
    assert pairs(model) > pairs(start)
    assert len({of[g[0]] for g in groups}) == 3
    assert all(len({of[w] for w in g}) == 1 for g in groups)


def test_lm_empty(spark, empty, hard):
    model, vocabulary = lm_score.learn(empty)
    out, name = lm_score.score(hard, model, vocabulary)
    assert {r[0] for r in out.select(f"{name}.base_score").collect()} == {0.0}
    assert lm_score.score(empty, model, vocabulary)[0].count() == 0


# -- substring dedup ----------------------------------------------------------------------------------------


def brute_pieces(text, window=8):
    """(begin, end, words in lower case, number of words) of each piece of a sentence, word by word."""
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    own = [low(text[a:b].decode()).encode() for a, b in spans]
    hashes = [int(substring_dedup.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) >> 32 for w in own]
    stops = {i for i, (_, b) in enumerate(spans) if text[b - 1] in b".!?" or i + 1 == len(spans) or b"\n" in text[b : spans[i + 1][0]]}
    cuts = set(stops)
    for i in range(len(own) - window + 1):
        if not stops & set(range(i, i + window - 1)):
            cuts.add(min(range(i, i + window), key=lambda j: (hashes[j], -j)))
    out, first = [], 0
    for i in sorted(cuts):
        out.append((spans[first][0], spans[i][1], b" ".join(own[first : i + 1]), i + 1 - first))
        first = i + 1
    return out


def brute_spans(rows, run=3, least=15):
    """Numbers of removed sentences, by dictionaries of joined sentences."""
    cut = {d: brute_pieces((x or "").encode()) for d, x in rows}
    places = defaultdict(list)
    for d in sorted(cut):
        found = cut[d]
        n, size = len(found), lambda p, q, found=found: sum(s[3] for s in found[p:q])
        long_enough = lambda p, q, n=n, size=size: q - p >= min(run, n) and size(p, q) >= least
        runs = {(p, next((q for q in range(p, n + 1) if long_enough(p, q)), None)) for p in range(n)}
        runs |= {(next((p for p in range(n - 1, -1, -1) if long_enough(p, n)), None), n)}
        for p, q in runs:
            if p is not None and q is not None:
                places[b" ".join(s[2] for s in found[p:q])].append((d, p, q))
    gone = defaultdict(set)
    for at in places.values():
        for d, p, q in sorted(at)[1:]:
            gone[d] |= set(range(p, q))
    return {d: len(gone[d]) for d in cut}


def test_spans_against_brute_force(spark, given):
    got = {r["doc_id"]: r["n_removed"] for r in queries.op2_substring_dedup(spark, DATA).collect()}
    assert got == brute_spans(given.items())
    assert any(got.values())


def test_spans_remove_later_copies_only(spark):
    random.seed(2)
    make = lambda n: " ".join(" ".join(random.choice("abcdefghij") * 3 + str(random.randrange(999)) for _ in range(9)) + "." for _ in range(n))
    passage, tails = make(6), [make(4) for _ in range(3)]
    plain = " ".join(f"nopunct{i}" for i in range(120))
    docs = spark.createDataFrame([(1, f"{tails[0]} {passage}"), (2, f"{passage} {tails[1]}"), (3, tails[2]), (4, plain), (5, f"x y z {plain} q r")], "doc_id bigint, text string")
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeated_spans(docs).collect()}
    assert left[1] == f"{tails[0]} {passage}" and left[3] == tails[2] and left[4] == plain
    assert left[2].endswith(tails[1]) and len(left[2].split()) < len(tails[1].split()) + 9  # less than a piece of the passage
    assert len(left[5].split()) < 60


def test_pieces_against_brute_force(given):
    rng = random.Random(3)
    made = ["".join(rng.choices(["a", "Bb", "c.", "!", " ", " ", "\n", "\t", "?", "é", ".x"], k=rng.randrange(60))).encode() for _ in range(400)]
    raw = [*made, b"", b" \n", *(x.encode() for x in list(given.values())[:40])]
    p = substring_dedup.pieces(raw)
    for i, x in enumerate(raw):
        own = range(p.of_text[i], p.of_text[i + 1])
        assert [(p.word_begin[p.first[k]], p.word_end[p.first[k + 1] - 1], p.first[k + 1] - p.first[k]) for k in own] == [(a, b, n) for a, b, _, n in brute_pieces(x)]


def test_spans_remove_later_of_repeated_rows(spark):
    text, other = (" ".join(f"{w}{i}" for i in range(40)) + "." for w in ("word", "other"))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, other), (None, other), (3, "short"), (3, "short")], "doc_id bigint, text string")
    left = sorted((r["doc_id"] or 0, r["text"]) for r in substring_dedup.remove_repeated_spans(docs).collect())
    assert left == [(0, other), (1, text), (3, "short"), (3, "short")]
    out, name = substring_dedup.dedup_spans(docs)
    assert sorted(r[name]["n_removed"] > 0 for r in out.collect()) == [False] * 4 + [True] * 3


def test_spans_hard_cases(spark, hard, empty):
    out, name = substring_dedup.dedup_spans(hard)
    rows = {(r["doc_id"], r["text"]): r[name] for r in out.collect()}
    assert out.count() == hard.count()
    assert rows[0, None]["text"] is None and rows[0, None]["n_sentences"] == 0
    assert rows[10, LONG]["n_removed"] == 0 and rows[11, LONG]["text"] == ""
    assert rows[13, "same text here"]["n_removed"] == 0
    assert substring_dedup.dedup_spans(empty)[0].count() == 0
    assert substring_dedup.remove_repeated_spans(hard).columns == hard.columns


def repeated_windows(docs, n=51):
    """Windows of ``n`` words that occur in two texts."""
    seen = Counter(w for x in docs.values() for ws in [words(x or "")] for w in {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)})
    return {w for w, k in seen.items() if k > 1}


def test_spans_leave_no_repeated_window_of_51_words(spark, given):
    rng = random.Random(4)
    make = lambda n: [rng.choice("bcdfghj") * 2 + str(rng.randrange(9999)) for _ in range(n)]
    docs = {}
    for k, lengths in enumerate([[26, 25], [32, 20], [20, 31], [51], [10, 31, 10], [5, 20, 20, 6], [8] * 7, [1, 49, 1], [12, 12, 12, 15]] * 3):
        passage = " ".join(" ".join(make(n)) + "." for n in lengths).rstrip(".")  # its edges belong to the sentences around it
        for c in range(2):
            docs[2 * k + c] = " ".join([*make(rng.randrange(1, 40)), passage, *make(rng.randrange(1, 40))]) + "."
    docs |= {1000 + d: x for d, x in given.items() if d is not None}
    before = repeated_windows(docs)
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeated_spans(rows).collect()}
    assert len(before) > 27 and not before & repeated_windows(left)
    assert all(left[2 * k] == docs[2 * k] for k in range(27))


# -- chat formatting ----------------------------------------------------------------------------------------


def conversation_digests(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_digests(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    rows += [{"conv_id": -7, "turn": k, "role": role, "text": "\\### Assistant: </turn> ok"} for k, role in enumerate(("user", "assistant"))]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op3_chat_format(spark, DATA).collect()}
    assert got == conversation_digests(rows)


def test_chat_windows_keep_their_budget(spark):
    random.seed(3)
    texts = lambda: " ".join(random.choice(["hello", "</turn>", "###", "\\", "a:b", "\n", "ok"]) for _ in range(random.randrange(0, 40)))
    rows = []
    for conv in (1, 2, None):
        rows += [(conv, 0, "system", "be brief")] if conv != 2 else []
        rows += [(conv, k, "assistant" if k % 2 == 0 else "user", texts()) for k in range(1, 300)]
    rows += [(3, 0, None, None), (3, None, "assis:tant", "x"), (4, 1, "assistant", "tie"), (4, 1, "assistant", "tie"), (5, 0, "user", "long " * 900)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat_format.format_windows(turns, queries.tokenizer_path("byte_bpe_50k.json"), capacity=256, history=48).cache()
    assert windows.filter("n_tokens > 256 AND n_new > 1").count() == 0
    assert {r["conv_id"] for r in windows.filter("over").collect()} == {5} and windows.filter("over <> (n_tokens > 256)").count() == 0
    long = windows.filter("conv_id = 1").orderBy("block", "crossing").collect()
    assert len(long) > 10 and all(chat_format.parse(w["formatted"])[0] == ("system", "be brief") for w in long)
    assert any(w["n_repeated"] > 1 for w in long)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.read_back(windows).collect()}
    assert got == conversation_digests([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows])
    assert chat_format.format_windows(turns.limit(0), queries.tokenizer_path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.8, 1.2])
def test_chat_windows_keep_their_budget_beside_any_system_turn(spark, share):
    rng = random.Random(7)
    lead = " ".join(["rule"] * int(256 * share))
    rows = [(1, 0, "system", lead)] + [(1, k, "assistant" if k % 2 else "user", " ".join(["word"] * rng.randrange(1, 12))) for k in range(1, 80)]
    rows += [(1, 80, "user", " ".join(["long"] * 70)), (1, 81, "assistant", "end")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat_format.format_windows(turns, queries.tokenizer_path("byte_bpe_50k.json"), capacity=256, history=48).collect()
    size = {r["n_tokens"] for r in windows if r["n_new"] == 1 and r["n_repeated"] == 0}
    for w in windows:
        own = chat_format.parse(w["formatted"])
        assert own[0] == ("system", lead)
        if w["over"]:  # the system turn and one more don't fit, so nothing else is in it
            assert len(own) == 2 - (w["n_repeated"] == 0)
        else:
            assert w["n_tokens"] <= 256
    if share < 1:
        assert sum(w["over"] for w in windows) == (1 if share == 0.8 else 0) and any(w["n_repeated"] > 1 for w in windows)
    else:
        assert size and all(w["over"] for w in windows)
    got = chat_format.read_back(spark.createDataFrame(windows)).first()
    assert (got["n_turns"], got["turns_sha256"]) == conversation_digests([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows])[1][:2]


def test_chat_windows_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    base = "same beginning " * 20  # longer than what ranges are cut by
    rows = [(k % 3, rng.randrange(6), rng.choice(["user", "assistant", None]), rng.choice(["tie", "", base, base + "a", base + "b", f"t{rng.randrange(9)}"])) for k in range(240)]
    rows += [(9, k, "system" if k % 4 == 2 else "user", "later system turns are turns") for k in range(1, 60)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("nth", F.lit("clash"))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            windows = chat_format.format_windows(turns, queries.tokenizer_path("byte_bpe_50k.json"), capacity=128, history=32)
            found.append(sorted((r["conv_id"], r["block"], r["crossing"], r["formatted"], r["n_repeated"]) for r in windows.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) > 20


def test_chat_system_turn_meets_long_conversations_in_stretches(spark, monkeypatch):
    """A conversation that holds a third of all turns: windows are the same however its blocks are cut into stretches."""
    rng = random.Random(5)
    rows = [(1, k, "system" if k == 0 else "assistant" if k % 2 else "user", " ".join(["word"] * rng.randrange(1, 30))) for k in range(400)]
    rows += [(None, k, "system" if k == 0 else "user", f"turn {k}") for k in range(40)] + [(2 + k // 4, k % 4, "user", "no system turn") for k in range(760)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = []
    for n in (1, 3, 100_000):
        monkeypatch.setattr(chat_format, "LEAD_BLOCKS", n)
        windows = chat_format.format_windows(turns, queries.tokenizer_path("byte_bpe_50k.json"), capacity=256, history=32)
        found.append(sorted((str(r["conv_id"]), r["block"], r["crossing"], r["formatted"], str(r["loss"])) for r in windows.collect()))
    assert found[0] == found[1] == found[2]
    long = [w for w in found[0] if w[0] == "1"]
    assert len(long) > 20 and max(w[1] for w in long) > 16 and all(chat_format.parse(w[3])[0][0] == "system" for w in long)
    assert sum(chat_format.parse(w[3])[0][0] == "system" for w in found[0] if w[0] == "None") == sum(w[0] == "None" for w in found[0])


# -- winnowing ----------------------------------------------------------------------------------------------


def winnowing_units(text, least=7):
    """Words; code points where a word is long or words are few."""
    found = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    return [u for x in found for u in (x if len(x) > 32 or len(found) < least else [x])]


def brute_winnow(text, word_hash, k=4, w=4):
    own = [word_hash[x] for x in winnowing_units(text, w + k - 1)]
    own += [0] * (k - len(own)) if own else []
    grams = []
    for i in range(len(own) - k + 1):
        h = 0
        for x in own[i : i + k]:
            h = (h * winnowing._BASE + x) % winnowing._MOD
        grams.append((h, -i))
    starts = range(max(1, len(grams) - w + 1)) if grams else []
    return sorted({(-min(grams[i : i + w])[1], min(grams[i : i + w])[0]) for i in starts})


def likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("name", ["given", "hard"])
def test_winnowing_against_brute_force(spark, request, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet") if name == "given" else request.getfixturevalue("hard").filter("doc_id <> 3 AND doc_id <> 5 AND doc_id <> 13")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(text)
    edited = {d: text[d][: len(text[d]) - len(text[d]) // 4] + text[order[(i + 1) % len(order)]][: len(text[d]) // 4] for i, d in enumerate(order)}
    all_words = sorted({x for t in [*text.values(), *edited.values()] for x in winnowing_units(t)})
    hashed = spark.createDataFrame([(x,) for x in all_words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(winnowing._MOD))).collect()
    word_hash = {r[0]: r[1] for r in hashed}
    own = {d: brute_winnow(t, word_hash) for d, t in text.items()}
    for r in winnowing.fingerprints(docs).collect():
        assert sorted((x["position"], x["hash"]) for x in r["fingerprint"]) == own[r["doc_id"]]
    rows = winnowing.compare_edited(docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        d = r["doc_id"]
        assert r["n_chars"] == len(text[d]) and r["edited_sha256"] == hashlib.sha256(edited[d].encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(likeness(own[d], brute_winnow(edited[d], word_hash)))
        assert r["near_next"] == pytest.approx(likeness(own[d], own[order[(order.index(d) + 1) % len(order)]]))


def test_winnowing_hard_cases(spark, hard, empty):
    rows = winnowing.compare_edited(hard).collect()
    assert len(rows) == hard.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert winnowing.compare_edited(empty).count() == 0
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (10, 11)}) == 1


def test_winnowing_without_blanks(spark):
    """Texts of a script without blanks, long words among short ones, letters outside the basic plane, and texts of few words."""
    rng = random.Random(11)
    cjk = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    rows = [(1, cjk(4000)), (2, cjk(4000)), (3, "".join(chr(rng.randrange(0x20000, 0x2A6D6)) for _ in range(400))), (4, "one two " + cjk(33) + " three " * 20)]
    rows += [(5, "https://example.org/" + "path/to/" * 60), (6, "a few short words"), (7, "x"), (8, "y" * 32 + " " + "z" * 33), (9, " ".join(cjk(32) for _ in range(7)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    text = dict(rows)
    edited = {d: text[d][: len(text[d]) - len(text[d]) // 4] + text[d % 9 + 1][: len(text[d]) // 4] for d in text}
    units = sorted({x for t in [*text.values(), *edited.values()] for x in winnowing_units(t)})
    hashed = spark.createDataFrame([(x,) for x in units], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(winnowing._MOD))).collect()
    unit_hash = {r[0]: r[1] for r in hashed}
    own = {d: brute_winnow(t, unit_hash) for d, t in text.items()}
    for r in winnowing.fingerprints(docs).collect():
        assert sorted((x["position"], x["hash"]) for x in r["fingerprint"]) == own[r["doc_id"]]
    found = {r["doc_id"]: r for r in winnowing.compare_edited(docs).collect()}
    for d, r in found.items():
        assert r["near_edited"] == pytest.approx(likeness(own[d], brute_winnow(edited[d], unit_hash)))
    assert all(found[d]["near_edited"] > 0.5 for d in (1, 2, 3)) and found[1]["near_next"] == 0


# -- SimHash ------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= 3 and (p := find(a)) != (q := find(b)):
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in prints}


def test_simhash_against_brute_force(spark, given):
    got = queries.op5_simhash(spark, DATA).collect()
    prints = [(d, brute_fingerprint(x)) for d, x in given.items()]
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == dict(prints)
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_groups(prints)


@pytest.mark.parametrize("block", [1024, 4])
def test_links_connect_what_brute_force_connects(spark, block):
    random.seed(5)
    prints = []
    for _ in range(12):
        x = random.getrandbits(64)
        for _ in range(40):
            prints.append(x)
            for _ in range(random.choice([1, 2, 3, 4, 5])):
                x ^= 1 << random.choice([random.randrange(64), random.randrange(6)])
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    roots = {r["node"]: r["root"] for r in components(simhash.fingerprint_links(rows, block=block)).collect()}
    expected = brute_groups(list(zip(signed, prints, strict=True)))
    assert {p: roots.get(p, p) for p in signed} == expected


def test_simhash_hard_cases(spark, hard, empty):
    rows = simhash.near_duplicates(hard).collect()
    assert len(rows) == hard.count()
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    assert got[1, 0] == 0 and got[2, 0] == 0  # no words: fingerprint 0, one group
    assert simhash.near_duplicates(empty).count() == 0
    kept = similar.drop_near_duplicates(hard)
    assert kept.columns == hard.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 11 not in ids and 13 not in ids and ids.count(12) == 1 and ids.count(None) == 1


def groups_at(least, docs):
    """Components of texts by the exact similarity of their five-word shingles."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))} for d, x in docs.items() for w in [words(x)]}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * max(len(sets[a] | sets[b]), 1)]
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {d: find(d) for d in sets}


def assert_between(found, docs, sure=0.85, least=0.7):
    """All pairs of similarity ``sure`` are in one group, and no group has a link below ``least``."""
    inner, outer = groups_at(sure, docs), groups_at(least, docs)
    assert all(found[d] == found[r] for d, r in inner.items())
    assert all(outer[d] == outer[r] for d, r in found.items())


@pytest.mark.parametrize(("block", "crowd"), [(256, 1000), (256, 3), (4, 4)])
def test_similar_groups_against_brute_force(spark, block, crowd):
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    docs = {}
    for _ in range(12):
        base = [word() for _ in range(random.choice([60, 150, 400, 900]))]
        for _ in range(9):
            new = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3, 12, 40])):
                new[random.randrange(len(new))] = word()
            docs[len(docs)] = " ".join(new[: random.choice([len(new), len(new), len(new) - 3, len(new) // 2])])
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(rows, block=block, crowd=crowd).collect()}
    assert_between(got, docs)
    assert len(set(got.values())) < len(docs) - 20


@pytest.mark.parametrize("crowd", [16, 1])
def test_similar_groups_are_exact_at_the_limit(spark, crowd):
    rng, docs = random.Random(6), {}
    make = lambda n: [str(rng.randrange(10**9)) for _ in range(n)]
    # words, and how many of the last are replaced or dropped: similarities 4/5, 8/10, 80/100, 800/1000, then 7/11, 79/101, 790/1010, 6/7
    for n, new, drop in [(9, 0, 1), (13, 1, 0), (94, 10, 0), (904, 100, 0), (13, 2, 0), (94, 11, 0), (904, 110, 0), (11, 0, 1)] * 6:
        base = make(n)
        docs[len(docs)] = " ".join(base)
        docs[len(docs)] = " ".join([*base[: n - new - drop], *make(new)])
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(rows, crowd=crowd).collect()}
    assert got == groups_at(0.8, docs)
    assert sum(d != r for d, r in got.items()) == 30


def test_near_dedup_tells_rows_with_one_id_apart(spark):
    rng = random.Random(11)
    a, b, c, d, e = (" ".join(str(rng.randrange(10**6)) for _ in range(80)) for _ in range(5))
    rows = [(3, a), (5, a), (5, b), (9, b), (7, c), (7, d), (8, e), (8, e), (None, e + " x"), (None, "alone"), (None, "alone")]
    kept = similar.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(3, a), (5, b), (7, c), (7, d), (8, e), (0, "alone")])


def test_near_dedup_of_a_crowd(spark):
    """One base, copies with few and with many edits, and texts that share a passage: groups as by all pairs, and few links."""
    rng, docs = random.Random(12), {}
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    for _ in range(300):
        new = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
            new[rng.randrange(len(new))] = word()
        docs[len(docs)] = " ".join(new)
    for _ in range(100):
        docs[len(docs)] = " ".join([*passage, *(word() for _ in range(rng.choice([5, 12, 40])))])
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    for block in (256, 32):
        got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(rows, block=block, crowd=4).collect()}
        assert got == groups_at(0.8, docs)


def test_a_crowd_meets_only_what_may_be_near(spark, monkeypatch):
    """Members of a large group are brought together in crowded keys only beside texts that may be near: not beside any that shares a key."""
    rng, docs = random.Random(31), {}
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [word() for _ in range(200)]
    for _ in range(300):
        new = list(base)
        new[rng.randrange(len(new))] = word()
        docs[len(docs)] = " ".join(new)
    for _ in range(3000):
        docs[len(docs)] = " ".join(word() for _ in range(90))
    met, blocks = [], similar._blocks

    def counted(members, block, name, seed, *keys):
        met.append((name, members.count()))
        return blocks(members, block, name, seed, *keys)

    monkeypatch.setattr(similar, "_blocks", counted)
    # few bits a key, so that texts of no likeness meet in the group's keys as they do in a large corpus
    monkeypatch.setattr(similar, "table_shape", lambda n, similarity, recall: (10, 20))
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(rows, crowd=250).collect()}
    assert len({got[i] for i in range(300)}) == 1 and len(set(got.values())) == 3001
    all_pairs = [n for name, n in met if name == "rows"][-1]
    probes = [n for name, n in met if name == "probes"][-1]
    assert probes > 300 and all_pairs == probes, met


def test_short_limits_hold_at_the_limit():
    rng, limits = np.random.default_rng(2), similar.short_limits(0.8)
    for shared, a, b in [(4, 1, 0), (8, 1, 1), (40, 5, 5), (48, 12, 0), (51, 6, 6), (1, 0, 0)]:
        both, x, y = (rng.integers(0, 1 << 63, k).astype(np.uint64) * np.uint64(2) for k in (shared, a, b))
        p, q = np.concatenate([both, x]), np.concatenate([both, y])
        lanes = similar.lanes_of(np.concatenate([p, q]), np.array([len(p), len(q)]))
        assert np.bitwise_count(lanes[0] ^ lanes[1]).sum() <= limits[len(p), len(q)] < 450
    assert limits[5, 10] == -1


def test_forest_joins_labels():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 1 << 63, (30, similar.LANES)).astype(np.uint64)
    bits[10:20], bits[20:] = bits[:10] ^ np.uint64(1), bits[:10] ^ np.uint64(3)
    near = similar.Nearness(0.8, 0.8)
    links = similar.forest(similar.Block(np.arange(30), np.full(30, 100), np.arange(30), bits), near)
    assert len(links) == 20 and {(b - a) % 10 for a, b in links} == {0}
    labels = np.arange(30) % 10
    assert similar.forest(similar.Block(np.arange(30), np.full(30, 100), labels, bits), near) == []


def test_table_shape_keeps_recall():
    for n in (0, 1, 1000, 10**7, 10**12):
        width, segments = similar.table_shape(n, 0.8)
        assert 20 <= width <= 28 and width * segments <= 64 * (similar.LANES - 1)


def test_near_dedup_recall_at_the_limit(spark):
    """1000 pairs just above 0.8 (and as many just below, which must not link), by edits at the end or all over the text."""
    rng, docs, wanted = random.Random(21), {}, {}
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    shingles = lambda words: {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    alike = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    for k in range(1000):
        base = [word() for _ in range(rng.randrange(69, 400))]  # over ``SHORT`` shingles: shorter pairs meet by their own hashes
        places = list(range(len(base) - 1, -1, -1)) if k % 2 else rng.sample(range(len(base)), len(base))
        least, above, new = rng.uniform(0.8, 0.85), list(base), list(base)
        for at in places:
            new[at] = word()
            if (s := alike(base, new)) < 0.8:
                break
            if s >= least:
                above = list(new)
        docs[3 * k], docs[3 * k + 1], docs[3 * k + 2] = base, above, new
        wanted[k] = alike(base, above)
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in docs.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(rows).collect()}
    assert all(s >= 0.8 for s in wanted.values()) and sum(s < 0.84 for s in wanted.values()) > 300
    found = sum(got[3 * k + 1] == got[3 * k] for k in wanted)
    assert found >= 0.98 * len(wanted), found
    # what is below 0.8 of its base is in its group only by way of the text between them
    assert all(got[3 * k + 2] != got[3 * k] or alike(docs[3 * k + 1], docs[3 * k + 2]) >= 0.8 for k in wanted)


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr("pluvia.llm.components.LEAST_HUB", 5)
    links = [(0, i) for i in range(1, 40)] + [(50, i) for i in range(51, 80)] + [(79, 39), (90, 91), (91, 92)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(40)}, **{i: 0 for i in range(50, 80)}, 90: 90, 91: 90, 92: 90}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(-5, 200), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, -5: -5, 200: -5}


# -- language ID --------------------------------------------------------------------------------------------


def test_language_id_held_out_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op6_language_id(spark, DATA).collect()
    assert len(rows) == len(langs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)


def brute_grams(text):
    """Each letter with the one before it in its word and the two after it, words being runs of letters in lower case."""
    out = []
    for word in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower())):
        padded = f" {word}  "
        out += [padded[i : i + 4].rstrip() if padded[i + 2] == " " else padded[i : i + 4] for i in range(len(word))]
    return out


def test_language_id_against_exact_sets(spark, given):
    """Exact sets in place of the filter: the same language wherever the two best are not within the filter's error."""
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    learn = [d for d in given if zlib.crc32(str(d).encode()) % 3 != 1 and langs[d] is not None]
    counts = defaultdict(Counter)
    for d in learn:
        counts[langs[d]].update(brute_grams(given[d]))
    total = {g: sum(c.values()) for g, c in counts.items()}
    most = Counter()
    for g, c in counts.items():
        for x, n in c.items():
            most[x] = max(most[x], n / total[g])
    sets = {g: {x for x, n in c.items() if n / total[g] >= max(1e-6, 0.3 * most[x])} for g, c in counts.items()}
    clear = 0
    for r in queries.op6_language_id(spark, DATA).collect():
        own = brute_grams(given[r["doc_id"]])
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        shares = sorted(((sum(x in sets[g] for x in own) / len(own), g) for g in sets), reverse=True)
        assert r["score"] == pytest.approx(shares[0][0], abs=0.01)
        if shares[0][0] - shares[1][0] > 0.02:
            clear += 1
            assert r["lang_pred"] == shares[0][1]
    assert clear > 0.9 * len(given)


def test_language_ties_go_to_the_first(spark):
    docs = spark.createDataFrame([("bb", "hello there"), ("aa", "hello there"), ("cc", "bonjour monde")], "lang string, text string")
    assert language_id.learn_languages(docs).predict([b"hello there"])[0] == ["aa"]


def test_language_filter_contains_what_it_learned(spark):
    docs = spark.createDataFrame([("aa", "hello there world"), ("bb", "bonjour le monde"), (None, "zzz")], "lang string, text string")
    model = language_id.learn_languages(docs)
    assert model.languages == ["aa", "bb"]
    assert model.predict([b"Hello WORLD", b"le monde!", b"123 ?!", b""]) == (["aa", "bb", "und", "und"], pytest.approx([1, 1, 0, 0], abs=1e-3))


def test_language_hard_cases(spark, hard, empty):
    model = language_id.learn_languages(hard)
    out, name = language_id.predict_languages(hard, model)
    rows = {r["doc_id"]: r[name] for r in out.collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == rows[6]["lang_pred"] == "und" and rows[7]["lang_pred"] in ("en", "fr")
    nothing = language_id.learn_languages(empty)
    assert {r[0] for r in language_id.predict_languages(hard, nothing)[0].select(f"{language_id.predict_languages(hard, nothing)[1]}.lang_pred").collect()} == {"und"}
    assert b"".join(language_id.cut_long(LONG.encode(), 1000)) == LONG.encode()


# -- decontamination ----------------------------------------------------------------------------------------


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit, found = set(), set()
    for item, x in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(x))
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for p in range(len(w) - n + 1 if v else 0):
            if tuple(w[p : p + n]) in windows:
                hit |= set(range(p, p + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [2_000_000, 300])
def test_decontamination_against_brute_force(spark, given, block_words):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    items += [(900, "the of"), (901, None), (902, " ?"), (903, " ".join(words(items[0][1])[:12])), (904, items[0][1])]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("match", F.lit(1))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out, name = decontaminate.find_contamination(docs, bench, block_words=block_words)
    rows = out.collect()
    assert {r["doc_id"]: (r[name]["n_words"], r[name]["n_hit"], r[name]["item_ids"]) for r in rows} == {d: brute_hits(x, items) for d, x in given.items()}
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r["text"]))
        texts = {str(k): re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(x)) for k, x in items}
        for m in r[name]["matches"]:
            v = texts[m["item_id"]]
            assert w[m["doc_pos"] : m["doc_pos"] + m["length"]] == v[m["item_pos"] : m["item_pos"] + m["length"]]


def test_decontamination_of_repeating_words_is_linear(spark):
    """An item and a text of equal words: one match, not one per pair of places; and places stay verbatim."""
    items = [(1, "same " * 1000), (2, "a b " * 20), (3, " ".join(f"w{i}" for i in range(30))), (4, "same " * 1000)]
    docs = [(1, "same " * 20_000), (2, "x " + "a b " * 500 + "a c"), (3, " ".join(f"w{i}" for i in [*range(5, 25), *range(8, 30)])), (4, "same " * 9)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("matches", F.lit(0))
    for block_words in (10_000, 30):
        out, name = decontaminate.find_contamination(rows, spark.createDataFrame(items, "item_id bigint, text string"), block_words=block_words)
        found = {r["doc_id"]: r[name] for r in out.collect()}
        assert [found[d]["n_hit"] for d in (1, 2, 3, 4)] == [20_000, 1001, 42, 0]
        assert [found[d]["item_ids"] for d in (1, 2, 3, 4)] == [["1", "4"], ["2"], ["3"], []]
        assert sum(len(x["matches"]) for x in found.values()) < 200
        for d, x in docs:
            for m in found[d]["matches"]:
                own = dict(items)[int(m["item_id"])].split()
                assert x.split()[m["doc_pos"] : m["doc_pos"] + m["length"]] == own[m["item_pos"] : m["item_pos"] + m["length"]]


def test_decontamination_hard_cases(spark, hard, empty):
    bench = spark.createDataFrame([(1, "A B"), (2, None)], "item_id bigint, text string")
    kept = decontaminate.remove_contaminated(hard, bench)
    assert kept.columns == hard.columns
    assert sorted({r["doc_id"] for r in hard.collect() if r["doc_id"] is not None} - {r["doc_id"] for r in kept.collect()}) == [4, 5]
    assert decontaminate.remove_contaminated(empty, bench).count() == 0
    assert decontaminate.remove_contaminated(hard, bench.limit(0)).count() == hard.count()


# -- importance resampling ----------------------------------------------------------------------------------


def test_resampling_against_brute_force(spark, given):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}
    rows = queries.op8_importance_resampling(spark, DATA).collect()
    b = importance.BUCKETS
    bags = {d: np.zeros(b) for d in given}
    for d, x in given.items():
        own = [zlib.crc32(w.encode()) for w in words(x)]
        pairs = [(p * 0x9E3779B97F4A7C15 + q * 0xC2B2AE3D27D4EB4F) % (1 << 64) >> 32 for p, q in itertools.pairwise(own)]
        for k in [*own, *pairs]:
            bags[d][k % b] += 1
    raw, target = sum(bags.values()), sum(bags[d] for d in good if d in bags)
    ratio = np.log((target + 1) / (target.sum() + b)) - np.log((raw + 1) / (raw.sum() + b))
    for r in rows:
        assert r["log_weight"] == pytest.approx(float(bags[r["doc_id"]] @ ratio), abs=1e-6)
        draw = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), xxhash.xxh64_intdigest(r["doc_id"].to_bytes(8, "little"), 42))  # as Spark chains hashes of a bigint and an int
        u = ((draw - (1 << 64) if draw >> 63 else draw) % (1 << 53) + 0.5) / (1 << 53)
        assert r["gumbel_key"] == pytest.approx(r["log_weight"] - math.log(-math.log(u)), abs=1e-6)
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (-r["gumbel_key"], r["doc_id"]))]
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"])] == order
    assert sum(r["selected"] for r in rows) == len(given) // 2


def test_resampling_hard_cases(spark, hard, empty):
    rows = importance.resample(hard, hard.filter("doc_id = 9")).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, hard.count() + 1))
    assert {r["log_weight"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0.0}
    assert {r["log_weight"] for r in importance.resample(hard, empty).collect()} == {0.0}
    assert importance.resample(empty, empty).count() == 0


# -- sharding -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1 << 30, 40_000, 3000, 10])
def test_shards_against_brute_force(spark, given, limit):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out, name = sharding.extendible_shards(docs, limit)
    rows = out.select("doc_id", f"{name}.*").collect()
    bits = {d: format(int(hashlib.md5(f"{d}\n{x}".encode()).hexdigest()[:15], 16), "060b") for d, x in given.items()}
    size = {d: len(x.encode()) for d, x in given.items()}

    def split(ids, depth):
        if sum(size[d] for d in ids) <= limit or len(ids) == 1:
            return {d: bits[d][:depth] for d in ids}
        return {k: v for b in "01" if (own := [d for d in ids if bits[d][depth] == b]) for k, v in split(own, depth + 1).items()}

    assert {r["doc_id"]: r["shard"] for r in rows} == split(list(given), 0)
    assert all(r["n_bytes"] == size[r["doc_id"]] for r in rows)


def test_small_shards_equal_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    rows = queries.small_shards(spark, DATA).select("doc_id", "shard", "depth", "n_bytes", "shard_bytes", "shard_docs").collect()
    assert sorted(map(tuple, rows)) == sorted(db.sql(queries.ORACLES["small_shards"]).fetchall())
    assert len({r["shard"] for r in rows}) > 2


def test_written_shards_keep_the_limit(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "shards"), 200_000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    folder = [c for c in back.columns if c not in docs.columns]
    assert len(folder) == 1 and back.count() == docs.count()
    assert max(r["n"] for r in back.groupBy(folder).agg(F.sum(F.octet_length("text")).alias("n")).collect()) <= 200_000
    assert sorted(map(tuple, back.select(docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_shards_hard_cases(spark, hard, empty):
    copies = hard.unionByName(spark.createDataFrame([(77, "copy " * 40, "en", "", "", "")] * 50, SCHEMA))
    out, name = sharding.extendible_shards(copies, 1000)
    rows = out.select("doc_id", f"{name}.*").collect()
    assert len(rows) == copies.count() and out.columns == [*copies.columns, name]
    pages = Counter()
    for r in rows:
        pages[r["shard"]] += r["n_bytes"]
    assert all(n <= 1000 or n > 4000 for n in pages.values())
    sizes = Counter(r["shard"] for r in rows)
    assert all(n <= 1000 or sizes[shard] == 1 for shard, n in pages.items())  # only a row that is too long by itself passes the limit
    assert sharding.extendible_shards(empty, 10)[0].count() == 0


# -- packing ------------------------------------------------------------------------------------------------


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_against_the_tokenizer(spark, given):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = queries.op10_best_fit_packing(spark, DATA).collect()
    want = {}
    for d, x in given.items():
        ids = [*tokenizer.encode(x or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[d, k] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    n = check_packing(rows, 2048)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_chunks_encode_like_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), merges.MergeEncoder(TOKENIZER)
    texts = ["", " ", "Don't  STOP now été", "a\x1cb\x1d c", "x <|endoftext|> y<|startoftext|>", "ΟΔΟΣ ΣΑΣ 12345 !!?", "\x85a\x0bb​c", "ﬁ Ǆ ́x", "İ I ı", LONG, "y" * 3000]
    rng = random.Random(8)
    kinds = ["a", "É", "İ", "ß", "ǆ", "'s", "'ll", "'", "3", "½", "…", "日本", "\u0301", "e", "\x1c", "\x85", "\xa0", " ", "\u2003", "\n", "\v", "<|", "<|endoftext|>", "|>", "Σ", "ΑΣ", "!!", "\x00", "👍🏽", "한국"]
    texts += ["".join(rng.choices(kinds, k=rng.randrange(25))) for _ in range(3000)]
    flat, ends = encoder.encode(pa.array(texts))
    assert [list(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_run_matching_is_best_fit():
    random.seed(9)
    for _ in range(30):
        capacity = random.choice([8, 20, 64])
        lengths = [random.randint(1, capacity) for _ in range(random.randrange(0, 200))]
        counts = Counter(lengths)
        placed, n = packing.match_runs(dict(counts), capacity)
        free, used = [], 0  # best fit, longest first, one by one
        for x in sorted(lengths, reverse=True):
            fit = [g for g in free if g >= x]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - x)
            else:
                free.append(capacity - x)
                used += 1
        assert n == used
        assert sum(1 for _ in placed) == len({tuple(r[:2]) for r in placed.tolist()})


def test_packing_hard_cases(spark, hard, empty):
    rows = packing.best_fit_pack(hard, TOKENIZER, capacity=64).collect()
    check_packing(rows, 64)
    assert {(r["doc_id"], r["length"]) for r in rows if r["doc_id"] in (0, 1, 2)} == {(0, 1), (1, 1), (2, 1)}
    assert packing.best_fit_pack(empty, TOKENIZER).count() == 0


def test_gathered_batches_keep_rows_in_order():
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(k, k + 7)), "text": ["x" * (9 * i % 40) if i % 5 else None for i in range(k, k + 7)]}) for k in range(0, 70, 7)]
    out = list(packing.gathered(iter(batches), 60))
    assert [i for b in out for i in b["doc_id"].to_pylist()] == list(range(70))
    assert all(sum(len(x or "") for x in b["text"].to_pylist()[:-1]) < 60 for b in out)


# -- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, given):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    kept = [dict(given)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == spark.read.parquet(f"{DATA}/documents.parquet").columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    groups = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(spark.createDataFrame(list(kept[1].items()), "doc_id bigint, text string")).collect()}
    assert set(kept[2]) == {d for d in kept[1] if groups[d] == d}
    assert_between(groups, kept[1])
    gone = brute_spans(kept[2].items())
    total = {d: len(brute_pieces(x.encode())) for d, x in kept[2].items()}
    assert set(kept[3]) == {d for d in kept[2] if not gone[d] or gone[d] < total[d]}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert set(kept[4]) == {d for d, x in kept[3].items() if not brute_hits(x, items)[1]}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(kept[4])
    assert all(len(x) == r["n_chars"] for r in docs.collect() for x in [r["text"]])


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_hard_cases(spark, hard, empty, stage):
    run = corpus_pipeline.STAGES[stage][1]
    out = run(spark, hard, DATA)
    if stage < 4:
        assert out.columns == hard.columns and out.count() <= hard.count()
    else:
        rows = out.collect()
        check_packing(rows, 2048)
        assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in hard.collect())
    assert run(spark, empty, DATA).count() == 0


def test_language_stage_rejects_what_is_no_language(spark, given):
    rng = random.Random(13)
    noise = {-k: " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxyz", k=rng.randrange(3, 9))) for _ in range(40)) for k in range(1, 20)}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([*noise.items(), (-100, None), (-101, ""), (-102, "123 !!")], "doc_id bigint, text string").withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(more), DATA).collect()}
    assert kept == {d for d, x in given.items() if any(c.isalpha() for c in x or "")}
