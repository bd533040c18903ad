"""Documents drawn towards a target's word pairs: importance weights of hashed features, and a weighted draw without replacement.

Features are the runs of one and two words, hashed into buckets. Counts of all buckets over the
corpus and over the target give an array of integer gains, by which a pass over the texts scores
each document. Weights and seeded noise make integer scores; an exact histogram of these, summed
from the top, gives the score at which the draw ends and the first rank of each score above it, so
only the documents of a surviving score are numbered among each other, and no table is sorted whole.
To the driver go the counts of the buckets and of the distinct scores, both bounded by the gains' range.

Null or wordless texts have no features, weight 0, and take no part in the draw. A null doc_id is
hashed as an empty one and comes after all others. Rows of one id and score are ranked among each
other by words and features. Empty tables give no rows; without target texts all gains follow the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.store import shared_folder, stored
from brindle.llm.words import ALNUM, LOWER, STEP, Words, parts, text_bytes

BUCKETS, LEAST_WORDS, SHARE, SEED = 10_000, 20, (25, 100), "7"
#: Bytes of a word after which it is hashed by itself.
LONG = 64
POLYNOMIAL = 0xEDB88320  # of the usual crc32, lowest bit first


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


TABLE = crc_table()
ONES = np.uint32(0xFFFFFFFF)


def crc_on(crc: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of what each ``crc`` stands for, followed by length[i] bytes of ``data`` from start[i]."""
    order = np.argsort(-length, kind="stable")
    long = int(np.searchsorted(-length[order], -LONG))
    out, order_short = crc.copy(), order[long:]
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes(), int(crc[i]))
    state, at, ends = crc[order_short] ^ ONES, start[order_short], -length[order_short]
    for j in range(int(-ends[0]) if len(ends) else 0):
        n = int(np.searchsorted(ends, -j))  # those of more than j bytes stand first
        state[:n] = TABLE[(state[:n] ^ data[at[:n] + j]) & 255] ^ (state[:n] >> 8)
    out[order_short] = state ^ ONES
    return out


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each word, text of each feature, crc32 of each feature), a stretch of some megabytes at a time."""
    data, offsets = text_bytes(column)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    last_doc, last_crc = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    at = 0
    while at < len(data):
        end = Words._cut(data, ALNUM, begins, at, min(at + STEP, len(data)))
        low = LOWER[data[at:end]]
        word = ALNUM[low]
        before = np.append(False, word[:-1]) & ~begins[at:end]
        after = np.append(word[1:], False) & ~begins[at + 1 : end + 1]
        start, stop = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        doc = np.searchsorted(offsets[1:], start + at, "right")
        one = crc_on(np.zeros(len(start), np.uint32), low, start, stop - start)
        first_doc, first = np.append(last_doc, doc[:-1]), np.append(last_crc, one[:-1])
        second = np.arange(len(doc))[len(doc) - len(first_doc) :] if len(doc) else np.zeros(0, np.int64)
        first_doc, first = first_doc[: len(second)], first[: len(second)]
        pair = first_doc == doc[second]
        spaced = first[pair] ^ ONES
        spaced = TABLE[(spaced ^ 0x20) & 255] ^ (spaced >> 8) ^ ONES
        second = second[pair]
        two = crc_on(spaced, low, start[second], (stop - start)[second])
        if len(doc):
            last_doc, last_crc = doc[-1:], one[-1:]
        yield doc, np.append(doc, doc[second]), np.append(one, two)
        at = end


def _count(column: str, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for part in parts(batches, column=column):
            for _, _, crc in features(part.column(column)):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds."""
    counted = texts.select(F.col(column).cast("string").alias(column)).mapInArrow(_count(column, buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most so many rows as buckets
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 ln(p / q)), p and q its share of the target's and the source's features, each with one more."""
    s, t, b = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def _weigh(shared, kept: list[str]):
    def run(batches):
        gain = shared.value
        for part in parts(batches):
            n_words, n, total = (np.zeros(part.num_rows, np.int64) for _ in range(3))
            for word_doc, doc, crc in features(part.column("text")):
                n_words += np.bincount(word_doc, minlength=part.num_rows)
                n += np.bincount(doc, minlength=part.num_rows)
                # sums of integers below 2^53, so exact in doubles
                total += np.bincount(doc, gain[crc % np.uint32(len(gain))], part.num_rows).astype(np.int64)
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(n_words), pa.array(n), pa.array(weight)], [*kept, "n_words", "n_features", "weight"])

    return run


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean gain of its features) of each document."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = own.select("doc_id").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    return own.mapInArrow(_weigh(docs.sparkSession.sparkContext.broadcast(gain), ["doc_id"]), schema)


def noise(doc_id: str, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, the same for an id whenever it is asked for."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _offsets(spark: SparkSession, scores: DataFrame, share: tuple[int, int]) -> tuple[DataFrame, int, int]:
    """(score, ahead) of each surviving score with the number of rows of greater scores, the score at which the draw ends, and its size."""
    counts = scores.groupBy("score").agg(F.count("*").alias("n")).toArrow()
    score, n = counts.column("score").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(-score)
    score, upto = score[order], np.cumsum(n[order])
    drawn = int(share[0] * int(upto[-1]) // share[1]) if len(upto) else 0
    last = int(np.searchsorted(upto, drawn)) if drawn else -1
    ahead = np.append(0, upto[:-1])[: last + 1] if last >= 0 else np.zeros(0, np.int64)
    table = pa.table({"score": pa.array(score[: last + 1], pa.int64()), "ahead": pa.array(ahead, pa.int64())})
    return spark.createDataFrame(table), int(score[last]) if drawn else 2**62, drawn


def draw(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document of ``docs`` (doc_id, text).

    Of those with ``least_words`` words or more the ``share`` of greatest score is drawn towards the texts
    of ``target`` (text) and ranked 1, 2, 3 ... by score, then doc_id; rank is null for all others.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    scored = stored(weighted(docs, gain).withColumn("score", F.col("weight") + noise("doc_id", seed)))
    ahead, last, drawn = _offsets(spark, scored.filter(F.col("n_words") >= least_words), share)
    survives = (F.col("n_words") >= least_words) & (F.col("score") >= last)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_words", "n_features"))
    # as many rows as distinct scores, which lie between the least and the greatest gain and noise
    alive = scored.filter(survives).join(F.broadcast(ahead), "score").withColumn("rank", F.col("ahead") + place)
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return alive.select(*columns, rank).unionByName(scored.filter(~survives).select(*columns, F.lit(None).cast("long").alias("rank")))
