"""Importance resampling against a plain version, and crc32 against zlib."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets(text):
    w = words(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def plain(docs, target):
    s, t = (Counter(b for x in texts for b in buckets(x)) for texts in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    rows = []
    for i, text in docs:
        own = buckets(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[4], r[1]))
    ranks = {}
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        ranks.setdefault(r, []).append(k)
    return sorted(((*r[:4], ranks[r].pop() if ranks.get(r) else None) for r in rows), key=str)


def drawn(spark, docs, target, schema="doc_id long, text string"):
    got = resample.draw(spark.createDataFrame(docs, schema).repartition(3), spark.createDataFrame([(x,) for x in target], "text string"))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    vocabulary = ["the", "THE", "pin", "Größe", "été", "中文", "x1", "co-op", "wide" * 40, "naïve"]
    made = [(i, rng.choice(["\n", " ", ", "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(150)]
    copies = [(1000 + i, made[7][1] + " the" * 30) for i in range(60)]
    return [*made, *copies, (2000, None), (2001, ""), (2002, " \n..."), (None, "the pin " * 40), (None, "the pin " * 40), (2003, "the pin " * 20), (2003, "the pin " * 20)]


def test_equals_plain_version(spark, docs):
    target = ["the pin x1 the pin", None, "", "Größe été"]
    assert drawn(spark, docs, target) == plain(docs, target)


def test_empty_tables(spark, docs):
    assert drawn(spark, [], ["the"]) == []
    assert drawn(spark, docs[:30], []) == plain(docs[:30], [])
    assert drawn(spark, [(1, None), (2, "few words")], ["the"]) == plain([(1, None), (2, "few words")], ["the"])


def test_one_score_of_many_rows(spark):
    """Rows of one score, more than are drawn, are taken by id."""
    docs = [(None, "the pin " * 20)] * 40
    got = drawn(spark, docs, ["pin"])
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 11)) and len(got) == 40


def test_clashing_columns_and_very_long_text(spark):
    long = "alpha Beta " * 300_000 + "y" * 100_000
    df = spark.createDataFrame([(1, long, 5, 5, 5, 5), (2, "alpha", 5, 5, 5, 5)], "doc_id long, text string, score int, ahead int, bucket int, n int")
    got = {r["doc_id"]: r for r in resample.draw(df, df.select("text")).collect()}
    assert got[1]["n_features"] == 2 * 600_001 - 1 and got[2]["n_features"] == 1


def test_features_over_stretches(monkeypatch):
    monkeypatch.setattr(resample, "STEP", 7)
    texts = ["one Two three", None, "four", "", "five six " * 9, "z" * 100 + " a " + "q" * 70]
    doc, crc = (np.concatenate(x).tolist() for x in list(zip(*resample.features(pa.array(texts)), strict=True))[1:])
    got = sorted(zip(doc, crc, strict=True))
    want = sorted((i, zlib.crc32(f.encode())) for i, t in enumerate(texts) for w in [words(t)] for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    assert got == want
