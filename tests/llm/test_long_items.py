"""Very long benchmark items and documents."""

from __future__ import annotations

import random

from test_corpus_operators import brute_hits
from test_text_operators import docs

from brindle.llm import decontam


def test_an_item_of_very_many_words(spark):
    rng = random.Random(3)
    item = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    texts = [" ".join(item[500:9000]), " ".join([*item[:12], "else", *item[199_980:]]), "nothing of it " * 20_000, None, ""]
    items = [("long", " ".join(item)), ("short", "of it nothing"), (None, " ".join(item[:40])), ("empty", None)]
    found = decontam.decontaminate(docs(spark, texts), spark.createDataFrame(items, "item_id string, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found.collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
