import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_jobs.llm.common import saved
from evidence_jobs.llm.neural_lm import END, LogBilinear, Sizes, learn_vocabulary, pair_counts, score_texts, token_counts, tokens, train, unit_sequence, word_class


#: Few units and frequent tokens, so that classes and the join are met.
FEW = Sizes(words=20, classes=8, frequent=40)


def texts():
    rng, out = random.Random(5), []
    for i in range(120):
        word = lambda: f"{'ab'[i % 2]}{min(int(rng.expovariate(0.12)), 80)}"
        out.append(" ".join(f"{w} then{w}" for w in (word() for _ in range(30))))
    return [*out, None, "", "NEW Then", "é ünseen\tx", out[3]]


def frame(spark):
    return spark.createDataFrame([(i, t, i % 10 != 0, "own") for i, t in enumerate(texts())], "id long, text string, learn boolean, rid string")


def test_base_scores_against_brute_force(spark):
    got = {r["id"]: r for r in score_texts(frame(spark), F.col("learn"), sizes=FEW).collect()}
    counts = Counter(w for i, t in enumerate(texts()) if i % 10 for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(texts())
    for i, text in enumerate(texts()):
        words = tokens(text)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert got[i]["base_score"] == pytest.approx(base)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert got[i]["rid"] == "own" and got[i]["score"] < 0
    held = [got[i] for i in range(0, 120, 10)]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_against_token_by_token_sums_and_probabilities_sum_to_one(spark):
    docs = frame(spark)
    learnt = docs.where("learn").select("text")
    saved_counts = saved(token_counts(learnt))
    vocabulary = learn_vocabulary(saved_counts, FEW)
    table = train(pair_counts(learnt, vocabulary)).table().astype(float)
    assert np.allclose((10**table).sum(axis=1), 1, atol=1e-4)
    counts = {bytes(r["token"]): r["n"] for r in saved_counts.collect()}

    def share(word, unit):
        return 0.0 if unit <= 20 else math.log10((counts.get(word, 0) + 0.1) / vocabulary.masses[unit - 21])

    for unit in range(21, 29):  # all words of a class, and one that it never saw
        own = [w for w in counts if unit_sequence([w], vocabulary)[1][0] == unit]
        assert sum(10 ** share(w, unit) for w in own) + 0.1 / vocabulary.masses[unit - 21] == pytest.approx(1)
    got = {r["id"]: r["score"] for r in score_texts(docs, F.col("learn"), sizes=FEW).collect()}
    for i, text in enumerate(texts()):
        words, before, total = tokens(text), 0, 0.0
        for word, unit in zip(words, unit_sequence(words, vocabulary)[1], strict=True):
            total, before = total + table[before, unit] + share(word, unit), unit
        assert got[i] == pytest.approx(total, rel=1e-5)


def test_pair_counts_against_a_loop(spark):
    learnt = frame(spark).select("text")
    vocabulary = learn_vocabulary(saved(token_counts(learnt)), FEW)
    want = np.zeros((29, 29))
    for text in texts():
        before = 0
        for unit in unit_sequence(tokens(text), vocabulary)[1]:
            want[before, unit] += 1
            before = unit
    assert (pair_counts(learnt, vocabulary) == want).all()


def test_training_finds_pairs():
    pairs = np.full((29, 29), 1.0)
    pairs[np.arange(29), (np.arange(29) + 1) % 29] = 500
    table = train(pairs).table()
    assert (table.argmax(axis=1) == (np.arange(29) + 1) % 29).all()
    assert (train(pairs).table() == table).all()


def test_nothing_to_learn_from(spark):
    rows = score_texts(frame(spark), F.lit(False), sizes=FEW).collect()
    assert all(r["base_score"] == pytest.approx(0) and r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
    assert score_texts(frame(spark).limit(0), F.lit(True), sizes=FEW).count() == 0


def test_words():
    assert tokens("A b\x0bÉ\x00 c") == [b"a", b"b", "É\x00".encode(), b"c", END]
    assert word_class("größe".encode(), 8) == word_class("öße".encode(), 8)
    assert isinstance(train(np.zeros((29, 29))), LogBilinear)
