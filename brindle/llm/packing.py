"""Conflict-constrained best-fit packing of documents into training sequences.

Documents become pieces of at most ``capacity`` words: full ones first, then the rest. A piece
goes into the fullest bin that still has room for it and holds neither a piece of the same
source nor one of the same duplicate cluster. Bins stand in order of their residual room and
carry a bitmap of their sources and one of their clusters; the search starts at the first bin
with room enough and goes on to its successors until one is compatible, else a bin is opened.

Pieces are dealt by a hash to shards of about ``shard_rows`` pieces, whose number follows from
the row count, so one source or cluster with a third of all rows is spread over all shards, and
shards are packed independently, longest piece first. Only ids, lengths and two hashes are
shuffled, never texts. Full pieces fill a bin each and take no part in the search.

A null or empty text has no words and is one piece of length 0. A null source is a source of its
own for each such document, so it conflicts with nothing; the cluster is that of equal texts up to case and white space
unless a column names it (``near_clusters`` makes one of near copies), and null and empty texts are in none. Repeated rows are packed each
(and conflict, being copies). Ties go by doc_id, then piece, then the keys of source and cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import jaccard
from brindle.llm.store import stored

CAPACITY, SHARD_ROWS = 2048, 4096


def best_fit(sizes, sources, clusters, capacity: int) -> list[int]:
    """The bin of each piece, pieces taken in the order given; sources and clusters are small numbers, -1 for none."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(order, (size, -1))
        while at < len(order) and (source_bits[order[at][1]] & s or cluster_bits[order[at][1]] & c):
            at += 1
        if at < len(order):
            room, own = order.pop(at)
        else:
            room, own = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[own] |= s
        cluster_bits[own] |= c
        insort(order, (room - size, own))
        out.append(own)
    return out


def _numbers(keys: pd.Series, shared_only: bool) -> list[int]:
    """Each key as a small number, null as -1; with shared_only also keys that stand once, since they conflict with nothing."""
    codes = pd.Series(pd.factorize(keys)[0])
    if shared_only:
        counts = codes[codes >= 0].value_counts()
        codes = codes.where(codes.map(counts).fillna(0) > 1, -1)
        codes = pd.Series(pd.factorize(codes.where(codes >= 0))[0])
    return codes.tolist()


def _pack_shard(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "piece", "source_key", "cluster_key"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        rows["bin"] = best_fit(rows["n_words"].tolist(), _numbers(rows["source_key"], True), _numbers(rows["cluster_key"], True), capacity)
        rows["place"] = rows.groupby("bin").cumcount()
        rows["shard"] = key[0]
        return rows[["doc_id", "piece", "first_word", "n_words", "shard", "bin", "place"]]

    return run


def text_cluster(text: str | Column) -> Column:
    """A 64-bit key of a text up to case and white space; null for null and blank texts."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(plain != "", F.xxhash64(plain))


def near_clusters(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, source_key, words and cluster_key of each row of ``docs``, for ``pack_sized``.

    The cluster is the label of the near copies' component (of lower-cased texts, so that equal texts in any case are in one), null without words.
    """
    keyed = docs.select("doc_id", F.lower("text").alias("text"), source_key().alias("source_key"))
    linked = jaccard.link(keyed, k, num, den, carry="source_key")
    return stored(linked.select("doc_id", F.col("carried").alias("source_key"), F.col("n_words").cast("int").alias("words"), F.col("label").alias("cluster_key")))


def source_key() -> Column:
    return F.when(F.col("source").isNotNull(), F.xxhash64("source"))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, cluster_col: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, first_word, n_words, shard, place (in the bin, from 0), bin_id.

    ``docs`` has doc_id, text and source. A full piece is alone in its bin, of shard -1. Words are runs of other than white space.
    """
    cluster = F.when(F.col(cluster_col).isNotNull(), F.xxhash64(cluster_col)) if cluster_col else text_cluster("text")
    words = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"), source_key().alias("source_key"), cluster.alias("cluster_key"))
    return pack_sized(sized, capacity, shard_rows)


def pack_sized(sized: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pack`` for documents known by doc_id, words, source_key and cluster_key (numbers, null for none)."""
    full = F.floor(F.greatest(F.col("words") - 1, F.lit(0)) / capacity).cast("int")
    pieces = sized.select("*", F.explode(F.sequence(F.lit(0), full)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * capacity).cast("long").alias("first_word"),
        F.least(F.col("words") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("n_words"), "source_key", "cluster_key",
    )
    schema = "doc_id long, piece int, first_word long, n_words int, shard int, bin int, place int"
    whole = pieces.filter(F.col("n_words") == capacity).select("doc_id", "piece", "first_word", "n_words", F.lit(-1).alias("shard"), F.lit(0).alias("bin"), F.lit(0).alias("place"))
    part = pieces.filter(F.col("n_words") < capacity)
    shards = max(1, -(-sized.count() // shard_rows))
    deal = F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "piece", "n_words", "source_key", "cluster_key"), F.lit(shards)).cast("int")
    packed = part.withColumn("shard", deal).groupBy("shard").applyInPandas(_pack_shard(capacity), schema)
    return packed.unionByName(whole).withColumn("bin_id", F.when(F.col("shard") >= 0, F.concat_ws("-", "shard", "bin")).otherwise(F.concat_ws("-", F.lit("full"), "doc_id", "piece"))).drop("bin")
