"""Exact search with more queries than go to every task."""

from __future__ import annotations

import numpy as np
import pytest

from brindle.operators import similarity


@pytest.mark.parametrize("one_per", [None, "label"])
def test_more_queries_than_one_broadcast(spark, monkeypatch, one_per):
    monkeypatch.setattr(similarity, "MAX_QUERIES", 7)
    monkeypatch.setattr(similarity, "GROUP_QUERIES", 4, raising=False)
    monkeypatch.setattr(similarity, "GROUP_ROWS", 16, raising=False)
    x = np.random.default_rng(5).normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist(), f"l{i % 4}") for i, v in enumerate(x)], "id long, vec array<double>, label string")
    asked = df.filter("id % 3 = 0")
    got = sorted(map(tuple, similarity.cosine_top_k(df, asked, 5, one_per=one_per).collect()), key=lambda r: (r[0], r[2]))
    unit = similarity.unit(x)
    want = []
    for q in range(0, 60, 3):
        score = np.round(unit @ unit[q], 9)
        best = [i for i in sorted(range(60), key=lambda i: (-score[i], i)) if i != q][:10]
        if one_per:
            best = [i for n, i in enumerate(best) if i % 4 not in {j % 4 for j in best[:n]}]
        want += [(q, i, n + 1, pytest.approx(score[i], abs=1e-8)) for n, i in enumerate(best[:5])]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == w[3] for g, w in zip(got, want, strict=True))
