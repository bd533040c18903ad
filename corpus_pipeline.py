"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns
a DataFrame; all but the last return the columns of ``documents``. ``run`` applies them to
``documents`` and writes each stage's rows to the folder in spark.checkpoint.dir before the next reads them.

Null and empty texts pass every filter and pack as pieces without words. Of equal or tied rows the smallest doc_id
stays, a null one after all others in packing and before them in line dedup. Texts of any length are taken whole, and
columns besides those of ``documents`` are left out. Empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontam, jaccard, lines, packing, toxicity
from brindle.llm.store import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on labelled documents, doesn't call toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs.select(COLUMNS), model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines, of one word or more, that match an earlier one. Those that lost some and keep nothing but white space go."""
    done = lines.dedup_lines(docs.select(COLUMNS), min_words=1)
    some = (F.size("gone_lines") == 0) | F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    length = F.when(F.size("gone_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.filter(some).withColumn("n_chars", length).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8, the smallest doc_id stays."""
    return jaccard.keep_one(docs.select(COLUMNS), k=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words, or whole shorter item, with the benchmark."""
    return decontam.drop_contaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, first_word, n_words, shard, place, bin_id."""
    return packing.pack(docs.select(COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Fitted weights and greedy packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
