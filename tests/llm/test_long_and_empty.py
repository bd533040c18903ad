"""Very long texts through the joins, packing and the whole pipeline, and empty tables through every registered query of documents."""

from __future__ import annotations

import random

import pytest
from test_text_operators import FOLDER, docs

import corpus_pipeline
from brindle.llm import jaccard, licences, packing, registry


def long_text(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(50_000)}" for _ in range(n)]


def test_long_near_copies_are_linked(spark):
    own = long_text(1, 200_000)
    near = list(own)
    for i in range(0, len(near), 200):  # five shingles a changed word: Jaccard about 0.95
        near[i] = "changed"
    texts = [" ".join(own), "short text of a few words", " ".join(near), " ".join(long_text(2, 200_000)), None, ""]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_digest(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5}
    assert [r["doc_id"] for r in jaccard.keep_one(docs(spark, texts)).orderBy("doc_id").collect()] == [0, 1, 3, 4, 5]


def test_a_long_text_packs_as_pieces(spark):
    n = 10 * packing.CAPACITY + 7
    rows = packing.pack(docs(spark, [" ".join(["w"] * n), "a b", None])).collect()
    own = sorted((r["piece"], r["first_word"], r["n_words"]) for r in rows if r["doc_id"] == 0)
    assert own == [(i, i * packing.CAPACITY, packing.CAPACITY) for i in range(10)] + [(10, 10 * packing.CAPACITY, 7)]
    assert sorted(r["n_words"] for r in rows if r["doc_id"] > 0) == [0, 2]


def test_a_licence_at_the_end_of_a_long_text(spark):
    notice = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
    long = " ".join(long_text(3, 200_000))
    rows = licences.by_source(docs(spark, [long, f"{long}.\n{notice}\n", None, ""]))
    found = {r["doc_id"]: r["licence"] for r in rows.collect()}
    assert found == {0: "", 1: "Apache-2.0", 2: "", 3: ""}  # a header of document 1, no licence file that others inherit from


def pipeline_folder(spark, tmp_path, d):
    d.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark", "embeddings"):
        table = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        (table if d.limit(1).count() else table.limit(0)).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_pipeline_of_long_texts(spark, tmp_path):
    lines = [" ".join(long_text(seed, 12)) for seed in range(10, 3010)]
    fresh = [" ".join(long_text(seed, 12)) for seed in range(5000, 5200)]
    texts = ["\n".join(lines), "\n".join([*lines, *fresh]), "\n".join(lines), None, "", " ".join(long_text(7, 30_000))]
    folder = pipeline_folder(spark, tmp_path, docs(spark, texts))
    rows = corpus_pipeline.run(spark, folder).collect()
    words: dict[int, int] = {}
    for r in rows:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    assert words == {0: 36_000, 1: 2400, 3: 0, 4: 0, 5: 30_000}  # 2 has no line of its own left


OWN = sorted(n for n in registry.queries() if n != "pipeline")


def test_pipeline_of_empty_tables(spark, tmp_path):
    folder = pipeline_folder(spark, tmp_path, docs(spark, []))
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.parametrize("name", OWN)
def test_queries_of_empty_tables(spark, tmp_path, name):
    d = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    assert registry.queries()[name](spark, pipeline_folder(spark, tmp_path, d)).count() == 0
