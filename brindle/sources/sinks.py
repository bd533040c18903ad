"""Sinks: findings, examples, typed Parquet, shards, rejected rows, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.operators.relational import conform


def write_json(df: DataFrame, path: str) -> None:
    """K1, K2: JSON lines, nulls left out, in as many files as partitions."""
    df.write.mode("overwrite").json(path)


def write_typed(df: DataFrame, path: str, schema: str | StructType) -> None:
    """K3: Parquet of exactly a schema; what can't be cast is null."""
    conform(df, schema).write.mode("overwrite").parquet(path)


def write_shards(df: DataFrame, path: str, order: list[str], rows_per_shard: int) -> None:
    """K4: Parquet shards of contiguous ranges of an order and at most so many rows each."""
    n = max(1, -(-df.count() // rows_per_shard))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").option("maxRecordsPerFile", rows_per_shard).parquet(path)


def write_by_source(df: DataFrame, path: str, url: str) -> None:
    """K5: a folder for each source address, named by the beginning of its hash."""
    df.withColumn("chunk", F.left(F.sha2(F.col(url), 256), F.lit(16))).write.mode("overwrite").partitionBy("chunk").json(path)


def write_with_rejects(df: DataFrame, path: str, rejects: str, reason: str = "reject_reason") -> None:
    """K7, K8: rows without a reason as Parquet, those with one as JSON lines beside them."""
    df.filter(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(path)
    df.filter(F.col(reason).isNotNull()).write.mode("overwrite").json(rejects)


def card(counts: DataFrame, title: str) -> str:
    """A table in Markdown of a small aggregate (as many rows as the report has lines)."""
    rows = counts.collect()
    cell = lambda v: str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(counts.columns) + " |", "|" + " --- |" * len(counts.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def without_local_paths(df: DataFrame, columns: list[str]) -> DataFrame:
    """What may be published: columns that hold local paths are dropped."""
    return df.drop(*columns)
