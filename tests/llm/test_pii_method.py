"""The trees' CASE expression against numpy, what they catch and leave, and texts of very many candidates."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F
from test_text_operators import docs

from brindle.llm import language, pii


def test_expression_equals_trees(spark):
    model = pii.trained(spark)
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.integers(0, 2, (200, len(pii.FEATURES))), rng.integers(0, 30, (200, len(pii.FEATURES))))).astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, f array<double>")
    got = [r["p"] for r in df.select("i", model.probability(F.col("f")).alias("p")).orderBy("i").collect()]
    assert np.allclose(got, model.predict(x), atol=1e-9)


def test_precision_and_recall_on_new_examples(spark):
    """Examples of another seed, so other words, numbers and contexts than the trees have learned from."""
    rows = pii.examples(seed=99, each=25)
    found = pii.find(docs(spark, [t for t, *_ in rows]), pii.trained(spark)).select("doc_id", "pii_spans").collect()
    spans = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["pii_spans"]} for r in found}
    hits = [(kind, start, end) in spans[i] for i, (_, kind, start, end, label) in enumerate(rows) if label]
    false = sum(bool(spans[i] & {(kind, start, end)}) for i, (_, kind, start, end, label) in enumerate(rows) if not label)
    assert np.mean(hits) >= 0.9
    assert sum(hits) / (sum(hits) + false) >= 0.9


def test_shapes_that_base_rules_miss(spark):
    texts = ["write to joe.doe at site dot com today", "from host 2001:db8::1 it came", "visa 4111–1111–1111–1111 was billed", "call (030) 555-0199 now", "std::vector and a::b at 3 dot 5"]
    got = {r["doc_id"]: [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["pii_spans"]] for r in pii.find(docs(spark, texts), pii.trained(spark)).collect()}
    assert got[0] == [("email", 9, 32)]
    assert got[1] == [("ip", 10, 21)]
    assert got[2] == [("card", 5, 24)]
    assert [k for k, *_ in got[3]] == ["phone"]
    assert got[4] == []


def test_very_many_candidates_and_clashing_names(spark):
    df = docs(spark, ["call (030) 555-0199 now " * 5000, "x"]).withColumns({"pii": F.lit(1), "__pii": F.lit(2), "letters": F.lit(3), "__letters": F.lit(4)})
    began = time.time()
    out = {r["doc_id"]: r for r in pii.find(df, pii.trained(spark)).collect()}
    assert len(out[0]["pii_spans"]) == 5000 and (out[1]["pii"], out[1]["__pii"]) == (1, 2)
    assert time.time() - began < 120
    kept = language.identify(df, language.Network([], [], np.zeros(0), np.zeros(0), np.zeros(0))).collect()
    assert {(r["letters"], r["__letters"]) for r in kept} == {(3, 4)}
