"""Words below the language model's share limit get classes of their own choice, and both ways of scoring use them."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from pluvia.llm import lm_score

DATA = "/root/testdata/sf0.001"


def words(x):
    return [w.decode() for w in (x or "").encode().translate(lm_score.LOWER).split()]


def test_best_class_of_rare_words_equals_the_dense_formula():
    rng = np.random.default_rng(3)
    total = rng.integers(5, 90, (7, 7)).astype(float)
    index = np.repeat(np.arange(40), rng.integers(1, 5, 40))
    before, after = rng.integers(0, 7, len(index)), rng.integers(0, 7, len(index))
    got = lm_score.placed_classes(index, before, after, total)
    for w in range(40):
        a, b = (np.bincount(x[index == w], minlength=7) for x in (after, before))
        x = lm_score._xlogx
        gain = [(x(total[c] + a) - x(total[c])).sum() + (x(total[:, c] + b) - x(total[:, c])).sum() for c in range(7)]
        gain = np.array(gain) - (x(total.sum(1) + a.sum()) - x(total.sum(1)) + x(total.sum(0) + b.sum()) - x(total.sum(0)))
        left = lambda p, q: (x(p) - x(np.maximum(p - q, 0))).sum()  # noqa: B023, E731
        gain[6] = left(total[6], a) + left(total[:, 6], b) - left(total.sum(1)[6], a.sum()) - left(total.sum(0)[6], b.sum())
        assert got[w] == 1 + gain[1:].argmax()


def test_rare_words_have_classes_and_scores_follow_the_formula(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(80).collect()] + [(None, None), (-1, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model, vocabulary = lm_score.learn(docs.filter("doc_id IS NULL OR doc_id % 2 <> 0"), n_classes=12, min_share=1e-3, rounds=4, place_rare=True)
    found = vocabulary.collect()
    rare = {r["word"]: r["class"] for r in found if r["word"].encode() not in model.core.number}
    assert len(rare) > 100 and None not in rare.values() and 0 not in rare.values() and len(set(rare.values())) > 3
    of = lambda t: int(model.classes[model.core.number[t.encode()]]) if t.encode() in model.core.number else rare.get(t, int(model.classes[-1]))
    learned = [x for d, x in rows if d is None or d % 2]
    pairs = Counter((of(p), of(t)) for x in learned for p, t in itertools.pairwise(["\n", *words(x), "\n"]))
    count = Counter(t for x in learned for t in [*words(x), "\n"])
    n, v, k, weight = sum(count.values()), len(count), 12, 0.9
    into, out_of = Counter(), Counter()
    for (a, b), m in pairs.items():
        out_of[a] += m
        into[b] += m
    assert model.class_sizes.tolist() == [into[c] for c in range(k)]
    unknown = 0.1 / (n + 0.1 * (v + 1))

    def log_p(history, t):
        unigram = (count[t] + 0.1) / (n + 0.1 * (v + 1))
        if not count[t]:
            return math.log10(unigram)
        a, b = of(history), of(t)
        move = (pairs[a, b] + k * into[b] / n) / (out_of[a] + k)
        return math.log10((1 - weight) * unigram + weight * (1 - unknown) * move * count[t] / into[b])

    for limit in (10**9, 0):  # by sorted hashes, and by joins
        out, name = lm_score.score(docs, model, vocabulary, broadcast_words=limit)
        got = out.collect()
        assert len(got) == len(rows)
        for r in got:
            ts = ["\n", *words(r["text"]), "\n"]
            assert r[name]["score"] == pytest.approx(sum(log_p(h, t) for h, t in itertools.pairwise(ts)), rel=1e-9)
            assert r[name]["n_known"] == sum(count[t] > 0 for t in ts[1:])
            assert r[name]["base_score"] == pytest.approx(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts[1:]), rel=1e-9)
