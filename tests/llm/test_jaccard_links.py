"""Links of the Jaccard join between rows that have no doc_id, and how many each document has."""

from __future__ import annotations

from itertools import combinations

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import near_copies, words_of
from test_text_operators import docs

from brindle.llm import jaccard

BASE = [f"w{i}" for i in range(60)]


def changed(*at):
    """The base text with the words at some places changed."""
    return " ".join(f"new{i}" if i in at else w for i, w in enumerate(BASE))


def test_a_near_copy_without_doc_id(spark):
    rows = [(1, changed()), (None, changed(0, 1, 2, 3)), (2, changed(0, 1, 2, 3, 56, 57, 58, 59)), (None, "quite another text of some words"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    linked = jaccard.link(df, 5, 80, 100)
    assert "n_links" not in linked.columns  # links are counted only where asked
    labels = {r["text_hash"]: (r["component"], r["label"]) for r in linked.collect()}
    near = [labels[r[0]] for r in df.filter("text like '%w30%'").select(F.xxhash64("text")).collect()]
    assert len(near) == 3 and len(set(near)) == 1 and near[0][0] == 1
    kept = {(r["doc_id"], r["text"]) for r in jaccard.keep_one(df).collect()}
    assert kept == {rows[0], rows[3], rows[4]}


@pytest.mark.parametrize(("k", "num", "den", "seed"), [(4, 85, 100, 1), (2, 60, 100, 3)])
def test_links_of_each_document(spark, k, num, den, seed):
    texts = near_copies(seed) + [f"{changed()} end{i}" for i in range(6)] * 2  # one prefix, and each text twice
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := words_of(t)) else set() for t in texts]
    want = dict.fromkeys(range(len(texts)), 0)
    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            want[a] += 1
            want[b] += 1
    assert want[len(texts) - 1] == 11
    assert {r["doc_id"]: r["n_links"] for r in jaccard.link(docs(spark, texts), k, num, den, counts=True).collect()} == want
