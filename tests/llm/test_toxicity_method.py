"""The ordinal model's likelihood, gradient and scores against plain sums, and the bound of what it learns from."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import docs

from brindle.llm import toxicity


def plain_loss(has, grade, w, cuts):
    """Text by text: the probability of a grade is the difference of two sigmoids."""
    total = 0.0
    for own, y in zip(has, grade, strict=True):
        exceed = [1.0, *(1 / (1 + math.exp(c - sum(w[j] for j in own))) for c in cuts), 0.0]
        total -= math.log(exceed[y] - exceed[y + 1])
    return total / len(grade)


def test_likelihood_and_gradient():
    rng = random.Random(4)
    has = [sorted(rng.sample(range(6), rng.randint(0, 4))) for _ in range(40)]
    grade = np.array([rng.randint(0, 3) for _ in has])
    rows = np.array([i for i, own in enumerate(has) for _ in own])
    cols = np.array([j for own in has for j in own])
    params = [np.array([rng.gauss(0, 0.7) for _ in range(6)]), np.array([0.3]), np.array([-0.4, 0.2])]
    loss, grads = toxicity.likelihood(rows, cols, grade, *params)
    cuts = 0.3 + np.concatenate(([0], np.cumsum(np.exp(params[2]))))
    assert loss == pytest.approx(plain_loss(has, grade, params[0], cuts), abs=1e-12)
    for ridge in (0.0, 0.3):
        _, grads = toxicity.likelihood(rows, cols, grade, *params, ridge)
        for p, g in zip(params, grads, strict=True):
            for i in range(len(p)):
                sides = []
                for step in (1e-5, -1e-5):
                    p[i] += step
                    sides.append(toxicity.likelihood(rows, cols, grade, *params, ridge)[0])
                    p[i] -= step
                assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(g[i], abs=1e-7)


def test_grades_equal_a_plain_sum(spark):
    model = toxicity.Ordinal({"idiot$": 2.5, "scum$": 1.25, "hate": 1.5, "rose$": -0.5}, [1.0, 2.0, 3.5])
    texts = ["idiot", "Idiot idiot SCUM", "hateful rose", "hate", "", None, "idiots", "rose " * 5000 + "scum", "hateful hater idiot"]
    words = [set((t or "").lower().split()) for t in texts]
    found = [{f for w in own for f in (w + "$", w[:4], w[:5], w[:6]) if (f.endswith("$") or len(w) > len(f))} for own in words]
    want = [[1 / (1 + math.exp(c - sum(model.weights.get(f, 0) for f in own))) for c in model.cuts] for own in found]
    got = toxicity.grade(docs(spark, texts), model).orderBy("doc_id").collect()
    for row, p in zip(got, want, strict=True):
        assert row["severity"] == pytest.approx(sum(p)) and row["p_toxic"] == pytest.approx(p[0])
        assert (row["grade"], row["toxic"]) == (sum(x >= 0.5 for x in p), p[0] >= 0.5)


def test_what_is_learned_of_a_text_is_bounded():
    text = " ".join(f"{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(3000)) + " " + "x" * 101
    kept = toxicity.sample_text(text, 500).split()
    assert len(kept) == 500 and kept == sorted(set(kept)) and set(kept) <= set(text.split()[:-1])
    assert toxicity.sample_text("B a b") == "a b" and toxicity.sample_text("") == "" and toxicity.sample_text(None) is None
    assert toxicity.sample_text(text).split() == text.split()[:-1]


def test_learned_words_equal_whole_texts(spark):
    toxic, clean = [f"you idiot scum number {'abcdefghij'[i % 10]}" for i in range(30)], [f"a calm river {'abcdefghij'[i % 10]} Straße" for i in range(40)]
    d = docs(spark, [*toxic, *clean, None, "no label"])
    labels = d.filter("doc_id < 71").select("doc_id", F.when(F.col("doc_id") < 30, 1).otherwise(0).alias("toxic"))
    model, plain = toxicity.fit(d, labels), toxicity.train(toxic, [*clean, None])
    assert model.weights == pytest.approx(plain.weights) and model.cuts == pytest.approx(plain.cuts)
    assert toxicity.fit(d.limit(0), labels).weights == {} and toxicity.fit(d, labels.limit(0)).weights == {}
