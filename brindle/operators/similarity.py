"""Exact cosine search of a set of queries over all vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Queries up to which all of them go to every task, and queries in a block of which the products are made.
MAX_QUERIES, BLOCK = 20_000, 256
#: Beyond that, queries and vectors meet in groups of about so many of each.
GROUP_QUERIES, GROUP_ROWS = 4096, 8192


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def nearest_of(ids: np.ndarray, matrix: np.ndarray, batch: pd.DataFrame, wide: int):
    """Frames of query, id, score, label: the ``wide`` nearest rows of a batch (id, vec, label) to each query."""
    x, own, label = unit(np.stack([np.asarray(v, float) for v in batch["vec"]])), batch["id"].to_numpy(), batch["label"].to_numpy()
    for at in range(0, len(ids), BLOCK):
        score = matrix[at : at + BLOCK] @ x.T
        score[ids[at : at + BLOCK][:, None] == own[None]] = -np.inf
        best = np.argpartition(-score, min(wide, len(own)) - 1, 1)[:, :wide]
        q, c = np.repeat(np.arange(len(score)), best.shape[1]), best.ravel()
        keep = score[q, c] > -np.inf
        yield pd.DataFrame({"query": ids[at : at + BLOCK][q[keep]], "id": own[c[keep]], "score": score[q[keep], c[keep]], "label": label[c[keep]]})


def _per_batch(ids: np.ndarray, matrix: np.ndarray, wide: int):
    def run(batches):
        for batch in batches:
            if len(batch) and len(ids):
                yield from nearest_of(ids, matrix, batch, wide)

    return run


def _per_group(wide: int):
    def run(key, asked: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0), "label": np.zeros(0, object)})
        if not len(asked) or not len(batch):
            return none
        return pd.concat(nearest_of(asked["q"].to_numpy(), unit(np.stack([np.asarray(v, float) for v in asked["v"]])), batch, wide))

    return run


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, oversample: int = 2, one_per: str | None = None, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """query, id, rank, score: each query's k nearest by cosine, from k * oversample candidates; with ``one_per``, at most one of each value of that column (Q10: possibly fewer than k).

    Up to MAX_QUERIES queries go to every task, which keeps candidates of its own rows only. More are dealt by a
    hash to blocks, and vectors to parts, of bounded size, and every block meets every part in a group of its own.
    Either way what is shuffled on is that many rows a task or part and query.
    """
    wide, result = k * oversample, "query long, id long, score double, label string"
    group = F.col(one_per).cast("string") if one_per else F.lit(None).cast("string")
    asked = queries.select(F.col(id_col).alias("q"), F.col(vec_col).alias("v"))
    usable = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), group.alias("label"))
    rows = asked.orderBy("q").limit(MAX_QUERIES + 1).toPandas()
    if len(rows) <= MAX_QUERIES:
        ids, matrix = rows["q"].to_numpy(), unit(np.stack([np.asarray(v, float) for v in rows["v"]])) if len(rows) else np.zeros((0, 1))
        near = usable.mapInPandas(_per_batch(ids, matrix, wide), result)
    else:
        blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((asked, GROUP_QUERIES), (usable, GROUP_ROWS)))
        deal = lambda name, col, n: F.pmod(F.xxhash64(F.lit(name), col), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = asked.withColumn("block", deal("query", "q", blocks)).withColumn("part", every(parts)).groupBy("block", "part")
        right = usable.withColumn("part", deal("vector", "id", parts)).withColumn("block", every(blocks)).groupBy("block", "part")
        near = left.cogroup(right).applyInPandas(_per_group(wide), result)
    near = near.withColumn("score", F.round("score", 9))
    order = [F.desc("score"), F.col("id")]
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= wide)
    if one_per:
        ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("query", "label").orderBy(*order))).filter("at = 1")
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query", "id", "rank", "score")


def _facts(index: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """One row on an index: rows, dimensions, and a sum of hashes of ids and vectors."""
    digest = F.sum(F.xxhash64(id_col, vec_col).cast("decimal(38,0)")).cast("string")
    return index.agg(F.count("*").alias("rows"), F.max(F.size(vec_col)).alias("dimensions"), digest.alias("digest"))


def save_index(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """K9: vectors with what they are about as Parquet, and facts on them beside."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    _facts(vectors.sparkSession.read.parquet(f"{path}/vectors"), id_col, vec_col).write.mode("overwrite").json(f"{path}/facts")


def load_index(spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """K9: the index saved at ``path``; a missing part, or vectors that don't agree with the facts, end the job."""
    index = spark.read.parquet(f"{path}/vectors")
    want, found = spark.read.schema("rows long, dimensions int, digest string").json(f"{path}/facts").first(), _facts(index, id_col, vec_col).first()
    if want != found:
        raise ValueError(f"the index at {path} is damaged: {found} where {want} was saved")
    return index
