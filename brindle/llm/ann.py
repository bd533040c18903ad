"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Each tree splits a bounded sample of the vectors by hyperplanes between two random ones, at the
median. Every vector of the table is put into its leaf of each tree. A query walks all trees
through one priority queue, always going on at the node in which its neighbours most likely
stand, and takes leaves until they hold ``visit`` of the forest's leaves. What stands in these
leaves is ranked by the exact inner product, in double precision, on the original vectors.

How likely a neighbour stands on a node's far side follows from the query's own margin there, by
a logistic curve whose slope is measured on pairs of true neighbours in the sample; ``visit`` is
measured there too: the least share of leaves that holds ``recall`` of these neighbours. Both are
fitted anew for each table (``Forest.fit``), so structured vectors are searched in few leaves
and vectors without structure in many. ``search_share`` tells what share of all rows a search scores.

Vectors of equal content are one point of the index that stands for its 21 smallest ids (no more
can matter to a result of 20), so a vector that a third of the rows share neither fills a leaf
nor is searched for more than once. Leaves are handed out in subtrees, and a subtree that is
larger than ``GROUP_ROWS`` is dealt over several groups, each of which the queries visit.
Queries are dealt to blocks of about ``QUERY_NUMBERS`` components, neighbouring leaves of the first tree
together, so that a block's queries ask for much the same; a leaf of more queries is several blocks by a
hash. Each block has groups of its own, so neither side of a group grows with the table, and a subtree's
vectors are sent once to each block that asks for it, and to no other. In a group only the leaves that a
query asks for are multiplied with it.

Vectors that are null, zero, or hold null or non-finite components take no part; nor do vectors
of another length than most, which have no inner product with these. Equal rows count once; of
rows with one id and different vectors each can be found.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.store import shared_folder, small, stored
from brindle.llm.words import mix

TREES, LEAF_ROWS, SAMPLE = 6, 128, 20_000
#: The share of neighbours to be found, and sample rows whose neighbours are looked up for the fit.
RECALL, PROBES = 0.94, 256
#: The least rows of the sample in a leaf, the levels of a subtree, rows of a group, and components of all its queries.
LEAST, SUBTREE, GROUP_ROWS, QUERY_NUMBERS = 8, 4, 32_768, 1 << 21
#: Queries whose scores with a group's rows are held at a time.
TILE = 128


@dataclass
class Forest:
    """Complete binary trees: normals (trees, inner nodes, dimensions), cuts and spreads (trees, inner nodes); node i has children 2i + 1 and 2i + 2."""

    depth: int
    normals: np.ndarray
    cuts: np.ndarray
    spreads: np.ndarray
    slope: float = 1.0
    visit: float = 1.0

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): each vector's leaf in each tree."""
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), np.int64)
            if self.depth:
                side = x @ self.normals[t].T >= self.cuts[t]
                for _ in range(self.depth):
                    node = 2 * node + 1 + side[np.arange(len(x)), node]
            out[:, t] = node - (2**self.depth - 1)
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees, inner nodes): signed distances from the cuts, in spreads of the nodes."""
        flat = self.normals.reshape(-1, self.normals.shape[2])
        return ((x @ flat.T).reshape(len(x), *self.cuts.shape) - self.cuts) / self.spreads

    def costs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each inner node what going to its low and to its high child costs: minus the log probability that a neighbour is there."""
        z = self.slope * self.margins(x)
        return np.logaddexp(0, z), np.logaddexp(0, -z)

    def wanted(self) -> int:
        return max(1, int(np.ceil(self.visit * len(self.normals) * 2**self.depth)))

    def search(self, x: np.ndarray):
        """For each query the (tree, leaf) pairs in the queue's order until the share ``visit`` of all leaves is taken."""
        inner, trees, wanted = 2**self.depth - 1, len(self.normals), self.wanted()
        for q in x:
            low, high = (c[0].tolist() for c in self.costs(q[None])) if inner else (None, None)
            queue = [(0.0, t, 0) for t in range(trees)]
            found = []
            while queue and len(found) < wanted:
                cost, t, node = heapq.heappop(queue)
                while node < inner:
                    a, b = low[t][node], high[t][node]
                    near, far = (1, 2) if a <= b else (2, 1)
                    heapq.heappush(queue, (cost + max(a, b), t, 2 * node + far))
                    cost, node = cost + min(a, b), 2 * node + near
                    if queue[0] < (cost, t, node):  # another branch has become the likelier one
                        heapq.heappush(queue, (cost, t, node))
                        break
                else:
                    found.append((t, node - inner))
            yield found

    def fit(self, sample: np.ndarray, n: int, k: int, recall: float) -> None:
        """Set slope and visit by the neighbours of some sample rows in the sample: the nearest k, or as many as stand for these if the sample is a part of n rows."""
        if not self.depth or len(sample) < 2:
            return
        probes = np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(int)
        most = min(len(sample) - 1, max(1, round(k * len(sample) / n)))
        score = sample[probes] @ sample.T
        score[np.arange(len(probes)), probes] = -np.inf
        near = np.argpartition(-score, most - 1, 1)[:, :most]
        top = Forest(0, self.normals[:, :31], self.cuts[:, :31], self.spreads[:, :31])  # the first levels are enough for the slope
        own, at = np.unique(near, return_inverse=True)
        zq, zx = top.margins(sample[probes])[:, None], top.margins(sample[own])[at.reshape(near.shape)]
        slope = (zq * zx).sum() / max((zq * zq).sum(), 1e-12)
        rest = np.sqrt(((zx - slope * zq) ** 2).mean()) or 1.0
        self.slope = float(1.702 * max(slope, 0.0) / rest)  # the logistic curve that is closest to the normal one
        low, high = self.costs(sample[probes])
        cost = np.zeros((*low.shape[:2], 1))
        for level in range(self.depth):
            at = slice(2**level - 1, 2 ** (level + 1) - 1)
            cost = np.stack((cost + low[:, :, at], cost + high[:, :, at]), 3).reshape(*low.shape[:2], -1)
        cost = cost.reshape(len(probes), -1)
        place = np.empty(cost.shape, np.int64)
        np.put_along_axis(place, cost.argsort(1, kind="stable"), np.broadcast_to(np.arange(cost.shape[1]), cost.shape), 1)
        leaf = self.leaves(sample)[near] + np.arange(len(self.normals)) * 2**self.depth
        first = np.take_along_axis(place, leaf.reshape(len(probes), -1), 1).reshape(leaf.shape).min(2)
        self.visit = float(min(1.0, (np.quantile(first, recall, method="higher") + 1) / cost.shape[1]))


def grow(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 11) -> Forest:
    rng = np.random.default_rng(seed)
    inner = 2**depth - 1
    normals, cuts, spreads = np.zeros((trees, inner, sample.shape[1])), np.zeros((trees, inner)), np.ones((trees, inner))
    for t in range(trees):
        rows = {0: np.arange(len(sample))}
        for node in range(inner):
            own = rows.pop(node)
            w = np.subtract(*sample[rng.choice(own, 2, replace=False)]) if len(own) > 1 else rng.normal(size=sample.shape[1])
            w = w / (np.linalg.norm(w) or 1.0)
            p = sample[own] @ w
            if len(p):
                normals[t, node], cuts[t, node], spreads[t, node] = w, np.median(p), p.std() or 1.0
            high = p >= cuts[t, node]
            rows[2 * node + 1], rows[2 * node + 2] = own[~high], own[high]
    return Forest(depth, normals, cuts, spreads)


def search_share(forest: Forest, x: np.ndarray, queries: np.ndarray) -> float:
    """The mean share of the rows ``x`` that stand in leaves taken for a query."""
    leaf, share = forest.leaves(x), []
    for found in forest.search(queries):
        taken = np.zeros((len(forest.normals), 2**forest.depth), bool)
        taken[tuple(np.array(found).T)] = True
        share.append(np.mean(taken[np.arange(len(forest.normals)), leaf].any(1)))
    return float(np.mean(share))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def element(vectors: DataFrame) -> str:
    """The type that vectors keep on their way: float as it is, everything else as double."""
    return "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"


def comparable(column: str, kind: str) -> Column:
    """A vector whose negative zeros are zeros, so that equal ones are equal."""
    return F.transform(F.col(column).cast(f"array<{kind}>"), lambda x: x + F.lit(0).cast(kind))


def points(vectors: DataFrame, k: int) -> DataFrame:
    """rep (the smallest id), vec, ids (the k + 1 smallest, ascending) of each distinct vector that takes part."""
    kind = element(vectors)
    usable = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("vec")).filter(
        "vec_id is not null and vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)"
    )
    width = usable.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    usable = usable.join(F.broadcast(width), F.size("vec") == F.col("n"), "left_semi").withColumn("vec", comparable("vec", kind))
    first = usable.withColumn("at", F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("at") <= k + 1)
    return first.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "vec", "ids")


def _place(forest: Forest, chunks: int):
    def run(batches):
        for batch in batches:
            x, rep = matrix(batch.column("vec")), batch.column("rep").to_numpy()
            leaf = forest.leaves(x)
            for t in range(leaf.shape[1]):
                part = (leaf[:, t] >> SUBTREE) * chunks + rep % chunks
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rep), t, np.int32)), pa.array(part), pa.array(leaf[:, t]), batch.column("rep"), batch.column("vec")], ["tree", "part", "leaf", "rep", "vec"])

    return run


def _homes(forest: Forest):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.leaves(matrix(batch.column("vec")))[:, 0])], ["home"])

    return run


def deal(counts: dict[int, int], leaves: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each leaf's queries: leaves in order share blocks of up to ``size`` queries, a leaf of more has its own."""
    first, many = np.zeros(leaves, np.int64), np.ones(leaves, np.int64)
    block, held = 0, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if held and held + n > size:
            block, held = block + 1, 0
        first[leaf] = block
        if n > size:
            many[leaf] = -(-n // size)
            block, held = block + int(many[leaf]), 0
        else:
            held += n
    return first, many


def _route(forest: Forest, chunks: int, first: np.ndarray, many: np.ndarray):
    def run(batches):
        for batch in batches:
            x = matrix(batch.column("vec"))
            home = forest.leaves(x)[:, 0]
            block = pa.array(first[home] + (mix(batch.column("rep").to_numpy().astype(np.uint64)) % many[home].astype(np.uint64)).astype(np.int64))
            tree, part, query, leaves = [], [], [], []
            for i, found in enumerate(forest.search(x)):
                by: dict[tuple[int, int], list[int]] = {}
                for t, leaf in found:
                    by.setdefault((t, leaf >> SUBTREE), []).append(leaf)
                for (t, sub), own in by.items():
                    for c in range(chunks):
                        tree.append(t), part.append(sub * chunks + c), query.append(i), leaves.append(own)
            at = pa.array(query, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(part, pa.int64()), block.take(at), *[batch.column(c).take(at) for c in ("rep", "vec")], pa.array(leaves, pa.list_(pa.int64()))], ["tree", "part", "block", "query", "vec", "leaves"])

    return run


def _rank(k: int):
    def run(key, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        query, found = [], []
        if len(rows) and len(asked):
            x, q = (np.stack(v.to_numpy()).astype(np.float64) for v in (rows["vec"], asked["vec"]))
            by_rep = np.argsort(rows["rep"].to_numpy())
            x, rep, leaf = x[by_rep], rows["rep"].to_numpy()[by_rep], rows["leaf"].to_numpy()[by_rep]
            subtree = leaf.min() >> SUBTREE << SUBTREE
            wanted = np.zeros((len(asked), 2**SUBTREE), bool)
            for i, own in enumerate(asked["leaves"]):
                wanted[i, np.asarray(own, int) - subtree] = True
            columns = [np.flatnonzero(leaf - subtree == own) for own in range(2**SUBTREE)]
            for at in range(0, len(q), TILE):
                score = np.full((min(TILE, len(q) - at), len(x)), -np.inf)
                for own, column in enumerate(columns):  # a leaf is multiplied with the queries that ask for it, and no others
                    ask = np.flatnonzero(wanted[at : at + TILE, own])
                    if len(ask) and len(column):
                        score[np.ix_(ask, column)] = q[at + ask] @ x[column].T
                best = np.argpartition(-score, min(k, score.shape[1] - 1), 1)[:, : k + 1]
                tied = np.flatnonzero((score >= np.take_along_axis(score, best, 1).min(1, keepdims=True)).sum(1) > best.shape[1])
                if len(tied):  # of equal ones those with the smallest rep
                    best[tied] = np.argsort(-score[tied], 1, kind="stable")[:, : k + 1]
                there = np.take_along_axis(score, best, 1) > -np.inf
                # once more, so that a pair's product is the same bits whatever block it was found in
                exact = (q[at : at + TILE][:, None, :] * x[best]).sum(2)
                query += asked["query"].to_numpy()[at : at + TILE].tolist()
                found += [[{"score": float(s), "neg": -int(r)} for s, r in zip(v[t], rep[b][t], strict=True)] for v, b, t in zip(exact, best, there, strict=True)]
        return pd.DataFrame({"query": np.array(query, np.int64), "found": pd.Series(found, dtype=object)})

    return run


def nearest(vectors: DataFrame, queries: str, k: int = 20, recall: float = RECALL, trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, group_queries: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) that meets the SQL condition ``queries``, its k nearest others found.

    ``recall`` of the sample's neighbours are to be found; 1 searches everything.
    """
    spark, kind = vectors.sparkSession, element(vectors)
    shared_folder(spark)
    found = points(vectors, k).checkpoint()
    n = found.count()
    drawn = found.orderBy(F.xxhash64(F.lit("forest"), "rep"), "rep").limit(sample).select("vec").toArrow() if n else None
    rows = matrix(drawn.column("vec").combine_chunks()) if n else np.zeros((0, 1))
    depth = max(0, min(int(np.ceil(np.log2(max(n, 1) / leaf_rows))), int(np.log2(max(len(rows), 1) / LEAST)) if len(rows) else 0))
    forest = grow(rows, depth, trees)
    forest.fit(rows, n, k, recall)
    chunks = max(1, -(-n // (2 ** max(depth - SUBTREE, 0) * GROUP_ROWS)))
    own = vectors.filter(queries).select("vec_id", comparable("embedding", kind).alias("vec"))
    asked = own.join(found, "vec").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")).distinct()
    placed = found.select("rep", "vec").mapInArrow(_place(forest, chunks), f"tree int, part long, leaf long, rep long, vec array<{kind}>")
    reps = asked.select(F.col("query").alias("rep")).distinct()
    wanted = found.join(reps, "rep", "left_semi").select("rep", "vec")
    size = group_queries or max(1, QUERY_NUMBERS // max(1, rows.shape[1]))
    homes = wanted.select("vec").mapInArrow(_homes(forest), "home long").groupBy("home").count().collect()  # at most a row for each leaf
    first, many = deal({r["home"]: r["count"] for r in homes}, 2**depth, size)
    routed = stored(wanted.mapInArrow(_route(forest, chunks, first, many), f"tree int, part long, block long, query long, vec array<{kind}>, leaves array<long>"))
    key = ["tree", "part", "block"]
    placed = placed.join(small(stored(routed.select(*key).distinct())), ["tree", "part"]).select(*key, "leaf", "rep", "vec")
    scored = placed.groupBy(*key).cogroup(routed.groupBy(*key)).applyInPandas(_rank(k), "query long, found array<struct<score:double,neg:long>>")
    # a pair is found once in a tree at most, always with the same score, so the nearest k + 1 are among so many
    best = F.array_distinct(F.slice(F.sort_array(F.flatten(F.collect_list("found")), asc=False), 1, (k + 1) * trees))
    near = scored.groupBy("query").agg(F.slice(best, 1, k + 1).alias("found")).select("query", F.explode("found").alias("x")).select("query", (-F.col("x.neg")).alias("rep"), "x.score")
    near = near.join(found.select("rep", "ids"), "rep").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    flat = asked.join(near, "query").select("query_id", F.explode("near").alias("x")).select("query_id", "x.score", F.explode("x.ids").alias("vec_id")).filter("vec_id <> query_id")
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
