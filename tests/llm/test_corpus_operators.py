"""Operators on whole corpora against brute force, with the cases that must not break them."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import FOLDER, SCHEMA, docs

import corpus_pipeline
from brindle.llm import ann, decontam, graph, jaccard, lines, packing, registry


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def near_copies(seed=1, groups=6, copies=7):
    """Texts of shared passages, and copies of them with words changed, put in and taken out."""
    rng = random.Random(seed)
    vocabulary = ["w" + str(i) for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(12)]
    out = [None, "", " \t\n", "one", "One", "two words", "two  WORDS", "É x y z q", "é x y z q"]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
        base[5:5] = passage
        for c in range(copies):
            w = list(base)
            for _ in range(c // 2):
                i = rng.randrange(len(w))
                w[i : i + rng.choice([0, 1])] = rng.choice([[], ["new" + str(rng.randrange(50))], ["w3"]])
            out.append(" ".join(w))
    return out + [out[-1], out[-1].upper()]


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize(("k", "num", "den", "seed"), [(4, 85, 100, 1), (5, 80, 100, 2), (2, 60, 100, 3)])
def test_jaccard_components(spark, k, num, den, seed):
    texts = near_copies(seed)
    got = {r["doc_id"]: (r["n"], r["component"]) for r in jaccard.link(docs(spark, texts), k, num, den).collect()}
    assert got == brute_components(texts, k, num, den)


def test_jaccard_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (2, long + " x"), (1, long), (3, "other words stand here and there now"), (4, None), (5, ""), (None, long), (3, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    out = sorted((r["doc_id"], r["text"]) for r in jaccard.keep_one(df).collect() if r["text"])
    assert out == sorted([(1, long), (3, "other words stand here and there now"), (3, "a b c d e f g")])
    assert jaccard.keep_one(df).count() == 5
    assert jaccard.link(df.filter("false")).count() == 0


def test_graph_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["label"] for r in graph.components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(edges.filter("false")).count() == 0


def brute_lines(rows, num=80, den=100, least=1):
    known, inverted, sizes, gone = set(), defaultdict(list), [], defaultdict(list)
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            s = frozenset(w for w in re.split(r"[ \t\r\x0b\x0c]", line.lower()) if w)
            if len(s) < least:
                continue
            counts = Counter(j for w in s for j in inverted[w])
            if s in known or any(den * c >= num * (len(s) + sizes[j] - c) for j, c in counts.items()):
                gone[doc].append(i)
            if s not in known:
                known.add(s)
                for w in s:
                    inverted[w].append(len(sizes))
                sizes.append(len(s))
    return dict(gone)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 25))] for _ in range(30)]

    def line():
        w = list(rng.choice(pool))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10)}"
        return rng.choice([" ", "  ", "\t"]).join(w)

    texts = [None, "", "\n\n", "a b", *("\n".join(line() for _ in range(rng.randint(1, 8))) for _ in range(60))]
    got = {r["doc_id"]: r["gone_lines"] for r in lines.dedup_lines(docs(spark, texts)).filter("size(gone_lines) > 0").collect()}
    assert got == brute_lines(enumerate(texts))


def test_lines_edges(spark):
    row = "the same line of words here"
    df = spark.createDataFrame([(1, f"{row}\nalone stands this line today"), (1, f"{row}\nalone stands this line today"), (1, f"{row} x\nanother text of this very id"), (2, f"Head of it all\n{row.upper()}\n\ntail"), (None, row)], "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("gone_lines", F.lit("z"))
    out = sorted((r["doc_id"] or 0, r["text"]) for r in lines.dedup_lines(df).collect())
    assert (0, row) in out
    assert out.count((1, "alone stands this line today")) == 2
    assert (1, "another text of this very id") in out
    assert (2, "Head of it all\n\ntail") in out
    assert lines.dedup_lines(df.filter("false")).count() == 0
    assert lines.dedup_digest(docs(spark, [None])).collect()[0]["n_gone"] == 0


ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, window=10):
    w = ALNUM.findall((text or "").encode().lower())
    hit, found = set(), set()
    for name, body in items:
        x = ALNUM.findall((body or "").encode().lower())
        n = min(window, len(x))
        runs = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in runs] if n else []
        for i in at:
            hit.update(range(i, i + n))
        if at and name is not None:
            found.add(str(name))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    rng = random.Random(4)
    v = ["a", "b", "c", "d", "é"]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([1, 3, 9, 10, 11, 30])))) for i in range(12)] + [(12, None), (13, ""), (13, "same id twice x y"), (None, "z1 z2 z3")]
    texts = [None, "", "z1, z2-Z3", *(" ".join(rng.choice(v) for _ in range(rng.randint(1, 200))) for _ in range(40)), *(f"x {b} y {b}." for _, b in items if b)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(0))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.decontaminate(docs(spark, texts), bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    none = decontam.decontaminate(docs(spark, texts), bench.filter("false")).filter("n_hit > 0")
    assert none.count() == 0
    assert decontam.decontaminate(docs(spark, []), bench).count() == 0
    kept = {r["doc_id"] for r in decontam.drop_contaminated(docs(spark, texts), bench).collect()}
    assert kept == {i for i, g in got.items() if not g[1]}


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 500).astype(np.uint64)
    doc = np.repeat([0, 1, 2], [200, 4, 296])
    kept = set(decontam.winnow(np.arange(500), doc, h, 5).tolist())
    for i in range(496):
        if doc[i] == doc[i + 4]:
            assert kept & set(range(i, i + 5))


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    x[50:150] = x[0]  # a hundred copies of one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (404, [1.0, 2.0]), (405, [float("inf")] + [1.0] * 7), (7, [float(v) for v in x[7]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1))
    got = defaultdict(list)
    for r in ann.nearest(df, "vec_id % 20 = 0", leaf_rows=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 20))
    recall = []
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(400), -score))[:20]
        recall.append(len(set(best) & {v for _, v, _ in found}) / 20)
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(s == pytest.approx(score[v], abs=1e-12) for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    assert np.mean(recall) >= 0.9
    grid = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(200)], "vec_id long, embedding array<float>")  # ties everywhere
    found = ann.nearest(grid, "vec_id = 10", k=30, leaf_rows=500).orderBy("rank").collect()
    want = sorted(((-(i % 5 * (10 % 5) + 1 + i % 3 * (10 % 3)), i) for i in range(200) if i != 10))[:30]
    assert [(-r["score"], r["vec_id"]) for r in found] == want
    few = ann.nearest(df.filter("vec_id < 3"), "vec_id = 0").collect()
    assert {r["vec_id"] for r in few} == {1, 2}
    assert ann.nearest(df.filter("false"), "true").count() == 0


def test_neighbours_recall_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], float)
    got = defaultdict(set)
    for r in registry.op10_nearest_neighbours(spark, folder).collect():
        got[r["query_id"]].add(r["vec_id"])
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        recall.append(len(got[ids[i]] & set(ids[np.lexsort((ids, -score))[:20]])) / 20)
    assert np.mean(recall) >= 0.9


def test_best_fit_finds_the_tightest_compatible_bin():
    rng = random.Random(1)
    pieces = sorted(((rng.randint(0, 90), rng.randrange(5), rng.choice([-1, -1, 0, 1])) for _ in range(200)), reverse=True)
    bins = packing.best_fit(*zip(*pieces, strict=True), 100)
    room, held, tags = {}, defaultdict(list), defaultdict(set)
    for (size, source, cluster), b in zip(pieces, bins, strict=True):
        own = {("s", source)} | ({("c", cluster)} if cluster >= 0 else set())
        fits = [(room[x], x) for x in room if room[x] >= size and not tags[x] & own]
        assert b == (min(fits)[1] if fits else len(room))
        room[b] = room.get(b, 100) - size
        tags[b] |= own
        held[b].append(size)
    assert all(sum(v) <= 100 for v in held.values())


def test_packing(spark):
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(10, "a"), (10, "a"), (25, "b"), (3, None), (3, None), (20, "c"), (0, "d"), (1, "e")])] + [(8, None, "f"), (9, "copy of it", "g"), (10, "Copy  of IT", "h"), (9, "copy of it", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bin", F.lit(1))
    out = packing.pack(df, capacity=20).collect()
    totals, sources = Counter(), defaultdict(list)
    for r in out:
        totals[r["bin_id"]] += r["n_words"]
        if r["shard"] >= 0 and rows[r["doc_id"]][2]:
            sources[r["bin_id"]].append(rows[r["doc_id"]][2])
    assert max(totals.values()) <= 20
    assert all(len(v) == len(set(v)) for v in sources.values())
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append((r["first_word"], r["n_words"]))
    assert sorted(by_doc[2]) == [(0, 20), (20, 5)]
    assert by_doc[5] == [(0, 20)]
    assert by_doc[6] == [(0, 0)] == by_doc[8]
    assert len(by_doc[9]) == 2
    copies = [r["bin_id"] for r in out if r["doc_id"] in (9, 10)]
    assert len(set(copies)) == 3
    assert packing.pack(df.filter("false")).count() == 0


def test_pipeline_stages(spark):
    """Each stage on its own input: columns, whole rows, and what it must catch."""
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").filter("size(split(text, ' ')) >= 15").first()
    base = d.orderBy("doc_id").first()["text"]
    extra = [(10_001, base, "en", "x", 1), (10_002, None, None, None, None), (10_003, "", "en", "x", 0), (10_004, "Begin. " + item["text"] + " End.", "en", "y", 1)]
    kept = d.unionByName(spark.createDataFrame(extra, SCHEMA))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, FOLDER).checkpoint()
        assert kept.columns == corpus_pipeline.COLUMNS
        assert ids(kept) <= ids(before), name
        assert {10_002, 10_003} <= ids(kept), name
        if name == "decontamination":
            assert 10_004 in ids(before) - ids(kept)
    assert 10_001 not in ids(kept)
    assert ids(corpus_pipeline.pack(spark, kept, FOLDER)) == ids(kept)
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    from compare import assert_same, connect

    assert_same(registry.queries()[name](spark, FOLDER), connect(FOLDER), registry.oracle_sql()[name])
