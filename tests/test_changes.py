"""Line changes and similarity against a plain table of common subsequences."""

from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.functions import lcs, packages
from brindle.operators import changes, evaluation


def table_length(a, b):
    up = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(up[j] + 1 if x == y else max(row[-1], up[j + 1]))
        up = row
    return up[-1]


@pytest.mark.parametrize("kept", [1 << 29, 40])
def test_pairs_are_a_longest_common_subsequence(monkeypatch, kept):
    monkeypatch.setattr(lcs, "KEPT_BITS", kept)
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        found = lcs.pairs(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
        assert len(found) == table_length(a, b) == lcs.length(a, b)


def versions():
    rng = random.Random(6)
    texts = [None, "", "\n", "one", "one\n", "\none", "a\nb\nc", "c\nb\na", "x\n" * 3000]
    texts += ["\n".join(rng.choice(["a", "b", "", "long line"]) for _ in range(rng.randrange(12))) for _ in range(40)]
    return [(i, rng.choice(texts), rng.choice(texts)) for i in range(150)] + [(1000, "\n".join(map(str, range(20_000))), "\n".join(str(x) for x in range(20_000) if x % 9) + "\nend")]


def test_changes_restore_and_are_least(spark):
    rows = versions()
    frame = spark.createDataFrame(rows, "id long, before string, after string")
    found = changes.with_changes(frame, "before", "after", ["id", "before", "after"])
    c = F.col("changes")
    got = found.select("id", changes.applied(F.col("before"), c).alias("made"), changes.n_removed(c).alias("out"), changes.n_added(c).alias("in_"), changes.unified(F.col("before"), c).alias("diff"))
    got = got.select("*", packages.diff_side(F.col("diff"), "-").alias("minus"), packages.diff_side(F.col("diff"), "+").alias("plus"))
    by_id = {r["id"]: r for r in got.collect()}
    for i, before, after in rows:
        assert by_id[i]["made"] == (after or "")
        if i < 1000:
            a, b = (before or "").split("\n"), (after or "").split("\n")
            common = table_length(a, b)
            assert (by_id[i]["out"], by_id[i]["in_"]) == (len(a) - common, len(b) - common)
    assert (by_id[1000]["out"], by_id[1000]["in_"]) == (2223, 1)
    assert changes.with_changes(frame.limit(0), "before", "after", ["id"]).collect() == []


def test_unified_text(spark):
    frame = spark.createDataFrame([("a\nb\nc\nd", "a\nX\nY\nc\nd\ne")], "before string, after string")
    found = changes.with_changes(frame, "before", "after", ["before"])
    assert found.select(changes.unified(F.col("before"), F.col("changes")).alias("d")).first()["d"] == "@@ -2,1 +2,2 @@\n-b\n+X\n+Y\n@@ -4,0 +6,1 @@\n+e"


def test_similarity(spark):
    rng = random.Random(7)
    text = lambda: rng.choice([None, "", "x", " ".join(rng.choice(["if", "x", "==", "(y)", "é", "return"]) for _ in range(rng.randrange(25)))])
    rows = [(i, text(), text()) for i in range(120)] + [(500, "a b c d e", "a b c d e"), (501, "w " * 20_000, "w " * 19_000)]
    frame = spark.createDataFrame(rows, "id long, a string, b string")
    found = evaluation.token_overlap(frame, "a", "b", ["id"])
    got = {r["id"]: r for r in found.select("*", evaluation.common_ratio().alias("ratio"), evaluation.precision_score().alias("score")).collect()}
    cut = lambda t: __import__("re").findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", t or "")
    for i, x, y in rows[:-1]:
        a, b = cut(x), cut(y)
        grams = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        hits = [sum((grams(a, n) & grams(b, n)).values()) for n in range(1, 5)]
        assert (got[i]["common"], got[i]["matches"]) == (table_length(a, b), hits)
        if not a and not b:
            want = 1.0
        elif not hits[0]:
            want = 0.0
        else:
            p = [(h + (n > 0)) / (max(len(a) - n, 0) + (n > 0)) for n, h in enumerate(hits)]
            want = math.exp(sum(map(math.log, p)) / 4) * (math.exp(1 - len(b) / len(a)) if len(a) < len(b) else 1)
        assert abs(got[i]["score"] - want) < 1e-9
    assert got[500]["ratio"] == got[500]["score"] == 1.0 and got[501]["common"] == 19_000


def test_slices_hold_few_tokens(monkeypatch):
    monkeypatch.setattr(evaluation, "SLICE_TOKENS", 10)
    sizes = [0, 3, 4, 3, 11, 0, 1, 9, 0, 2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([["x"] * n for n in sizes]), pa.array([[] for _ in sizes], pa.list_(pa.string()))], ["i", "a", "b"])
    parts = [p.column("i").to_pylist() for p in evaluation.slices(batch, ("a", "b"))]
    assert parts == [[0, 1, 2, 3], [4], [5, 6, 7, 8], [9]]
    assert list(evaluation.slices(batch.slice(0, 0), ("a", "b"))) == []
