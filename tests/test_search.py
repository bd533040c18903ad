"""Keyword search against ``in``."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from brindle.functions.tokens import text_bytes
from brindle.operators import relational, search


def plain(texts, words):
    return {(i, k) for i, t in enumerate(texts) if t is not None for k, w in enumerate(words) if w in t}


@pytest.mark.parametrize("stretch", [3, 2048])
def test_automaton_finds_what_in_finds(monkeypatch, stretch):
    monkeypatch.setattr(search, "STRETCH", stretch)
    rng = random.Random(1)
    for _ in range(40):
        words = ["".join(rng.choice("abé中") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 30))]
        texts = ["".join(rng.choice("abcé中") for _ in range(rng.randint(0, 60))) for _ in range(30)]
        row, word = search.Automaton([w.encode() for w in words]).found(*text_bytes(pa.array(texts)))
        assert set(zip(row.tolist(), word.tolist(), strict=True)) == plain(texts, words)
        assert (np.diff(row * 1000 + word) > 0).all()


def test_many_keywords_in_blocks_and_edges(spark, monkeypatch):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)})
    texts = [None, "", *("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300))) for _ in range(60)), "abc" * 200_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    keywords = spark.createDataFrame([(w,) for w in [*words, None, words[0], ""]], "k string")
    want = {(i, w) for i, t in enumerate(texts) if t is not None for w in [*words, ""] if w in t}
    for block_bytes, cells in ((1 << 20, 1 << 24), (4000, 1 << 24), (1 << 20, 20_000)):
        monkeypatch.setattr(search, "BLOCK_BYTES", block_bytes)
        monkeypatch.setattr(search, "CELLS", cells)
        got = [tuple(r) for r in search.mentions(frame, "t", keywords, ["i"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert search.mentions(frame, "t", keywords.limit(0), ["i"]).collect() == []
    assert search.mentions(frame.limit(0), "t", keywords, ["i"]).collect() == []


def test_no_nested_loop_for_ten_thousand_keywords(spark):
    releases = spark.createDataFrame([(i, f"tag{i}", f"release of key{i * 7 % 10_000:05d} and more") for i in range(200)], "published long, tag string, body string")
    advisories = spark.range(10_000).selectExpr("id", "array(format_string('KEY%05d', id), 'absent') as keywords")
    found = relational.newest_mention(advisories, releases)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
    got = {r["id"]: r["release"] for r in found.collect()}
    assert len(got) == 10_000 and sum(v is not None for v in got.values()) == 200
    assert got[7] == "tag1" and got[8] is None
