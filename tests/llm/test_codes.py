"""Vector codes against a plain version in Python's integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from brindle.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    own = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    own.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(own[0][1])
    edges = codes.cuts(width, parts)
    cut = lambda v, p: v[edges[p] : edges[p + 1]]
    books = [[cut(v, p) for _, v, _ in own[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = [near(cut(v, p), books[p])[1] for _, v, _ in own]
            for e in set(got):
                members = [cut(own[i][1], p) for i in range(len(own)) if got[i] == e]
                books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    done = [[near(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in own]
    error = [sum(d for d, _ in row) for row in done]
    by_label = {}
    for (_, _, lab), e in zip(own, error, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for _, e in row), e, by_label[lab], sha) for (i, _, lab), row, e in zip(own, done, error, strict=True))


def digest(spark, rows, schema=SCHEMA):
    return sorted(tuple(r) for r in codes.compress_digest(spark.createDataFrame(rows, schema).repartition(3)).collect())


@pytest.mark.parametrize("grid", [1 / 4096, 0.25, None])
def test_equals_plain_version_with_ties_and_copies(spark, grid):
    rng = random.Random(5)
    value = lambda: rng.gauss(0, 1) if grid is None else grid * rng.randrange(-3, 4)  # noqa: E731  on a grid nearly all distances tie
    rows = [(i, [value() for _ in range(16)], rng.choice([None, 1, 2])) for i in range(120)]
    rows += [(200 + i, rows[0][1], 1) for i in range(60)]
    rows += [(900, None, 1), (901, [None] * 16, 1), (902, [math.nan] * 16, 2), (903, [math.inf] + [0.0] * 15, None)]
    rng.shuffle(rows)
    assert digest(spark, rows) == plain(rows)


def test_few_rows_odd_lengths_and_repeated_rows(spark):
    rows = [(3, [0.1 * i for i in range(11)], None), (1, [0.2] * 11, 7), (1, [0.2] * 11, 7)]
    assert digest(spark, rows) == plain(rows)
    assert digest(spark, [(5, [0.5, -0.5], 1)]) == plain([(5, [0.5, -0.5], 1)])  # parts without components
    mixed = [*rows, (9, [1.0] * 8, 1)]
    assert [r[0] for r in digest(spark, mixed)] == [1, 1, 3]  # another length than most


def test_great_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-3e5, 3e5) for _ in range(16)], i % 2) for i in range(40)]
    assert digest(spark, rows) == plain(rows)
    far = [(i, [1e12 * (i % 25) ** 2] + [0.0] * 7, i % 2) for i in range(60)]
    fit = lambda e: e if e < 2**63 else None  # noqa: E731  an error beyond a long is null, and so is its label's sum
    want = plain(far)
    sums = {lab: None if any(fit(r[2]) is None for r in want if r[0] % 2 == lab) else sum(r[2] for r in want if r[0] % 2 == lab) for lab in (0, 1)}
    assert any(fit(r[2]) is None for r in want)
    assert digest(spark, far) == [(r[0], r[1], fit(r[2]), sums[r[0] % 2], r[4]) for r in want]


def test_empty_table_and_clashing_columns(spark):
    assert digest(spark, []) == []
    assert digest(spark, [(1, None, 1)]) == []
    wide = spark.createDataFrame([(i, [float(i)] * 8, 1, i, "x", i, i, 0) for i in range(5)], f"{SCHEMA}, vec int, code string, error int, n int, of int")
    assert sorted(r["vec_id"] for r in codes.compress_digest(wide).collect()) == list(range(5))


def test_tree_equals_full_scan():
    rng = np.random.default_rng(3)
    for spread in (2, 5, 10_000):
        for _ in range(30):
            book = rng.integers(-spread, spread + 1, (int(rng.integers(1, 17)), int(rng.integers(1, 5))))
            x = rng.integers(-spread - 2, spread + 3, (300, book.shape[1]))
            apart = ((x[:, None] - book) ** 2).sum(2)
            entry, best = codes.search(codes.grow(book), book, x)
            assert (entry == apart.argmin(1)).all() and (best == apart.min(1)).all()


def test_decode_is_near(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], 1) for i in range(64)]
    books, coded = codes.compress(spark.createDataFrame(rows, SCHEMA))
    for r in coded.select("vec_id", "error", books.decode(coded["code"]).alias("v")).collect():
        apart = sum((math.floor(4096 * a) - math.floor(4096 * b)) ** 2 for a, b in zip(rows[r["vec_id"]][1], r["v"], strict=True))
        assert apart == r["error"]
