"""The forest search with more queries than one block holds."""

from __future__ import annotations

import numpy as np
import pandas as pd

from brindle.llm import ann


def test_queries_of_a_group_are_bounded(spark, monkeypatch, tmp_path):
    x = np.random.default_rng(3).normal(size=(400, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.nearest(df, "vec_id % 2 = 0", leaf_rows=64).collect()))
    rank, seen = ann._rank, str(tmp_path)

    def noted(k):
        run = rank(k)

        def noting(key, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            with open(f"{seen}/{'-'.join(map(str, key))}", "w") as f:
                f.write(str(len(asked)))
            return run(key, rows, asked)

        return noting

    monkeypatch.setattr(ann, "_rank", noted)
    blocked = sorted(map(tuple, ann.nearest(df, "vec_id % 2 = 0", leaf_rows=64, group_queries=10).collect()))
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert blocked == whole
    assert 0 < max(sizes) <= 30  # dealt by a hash: about 10 each


def test_recall_and_share_of_rows_scored():
    """Of vectors without any structure, and of clustered ones, what is found and what share of all rows is scored for a query."""
    rng = np.random.default_rng(5)
    loose = rng.normal(size=(12_000, 64))
    centres = rng.normal(size=(40, 64)) * 3
    tight = centres[rng.integers(0, 40, 12_000)] + rng.normal(size=(12_000, 64)) * 0.5
    for x, most in ((loose / np.linalg.norm(loose, axis=1, keepdims=True), 0.65), (tight, 0.25)):
        forest = ann.grow(x, 6)
        forest.fit(x, len(x), 20, ann.RECALL)
        asked = x[::100]
        score = asked @ x.T
        score[np.arange(len(asked)), np.arange(0, len(x), 100)] = -np.inf
        true, leaf, recall = np.argpartition(-score, 19, 1)[:, :20], forest.leaves(x), []
        for near, found in zip(true, forest.search(asked), strict=True):
            taken = set(found)
            recall.append(np.mean([any((t, leaf[i, t]) in taken for t in range(len(forest.normals))) for i in near]))
        assert np.mean(recall) >= 0.9
        assert ann.search_share(forest, x, asked) <= most


def test_blocks_are_bounded_and_local():
    rng = np.random.default_rng(6)
    counts = {int(i): int(n) for i, n in enumerate(rng.integers(0, 30, 64)) if n} | {7: 500}
    first, many = ann.deal(counts, 64, 40)
    held: dict[int, int] = {}
    for leaf in range(64):
        for b in range(int(many[leaf])):
            held[int(first[leaf]) + b] = held.get(int(first[leaf]) + b, 0) + counts.get(leaf, 0) // int(many[leaf])
    assert max(held.values()) <= 40 and many[7] == 13 and (np.diff(first) >= 0).all()
    assert set(range(int(first[7]), int(first[7] + 13))).isdisjoint({int(f) for i, f in enumerate(first) if i != 7 and counts.get(i)})
    assert ann.deal({}, 1, 10)[1].tolist() == [1]


def test_clustered_queries_ask_for_few_parts():
    """Of the subtrees times blocks, what share a block asks for: that many times a vector is sent, of at most the number of blocks a tree."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64)) * 3
    x = centres[rng.integers(0, 40, 12_000)] + rng.normal(size=(12_000, 64)) * 0.5
    forest = ann.grow(x, 7)
    forest.fit(x, len(x), 20, ann.RECALL)
    asked = x[::20]
    home = forest.leaves(asked)[:, 0]
    first, many = ann.deal({int(h): int(n) for h, n in zip(*np.unique(home, return_counts=True), strict=True)}, 128, 40)
    parts = {(t, leaf >> ann.SUBTREE, int(first[h])) for h, found in zip(home, forest.search(asked), strict=True) for t, leaf in found}
    assert (many == 1).all()
    assert len(parts) < 0.8 * 6 * (128 >> ann.SUBTREE) * (int(first.max()) + 1)
