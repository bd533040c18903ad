"""Intermediate tables in the shared folder that the cluster names, and broadcasts of a proven size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.storage import shared_folder

__all__ = ["checkpointed", "is_small", "shared_folder", "small", "stored"]

#: Spark's own setting that removes the shuffle files of a query once it has ended, instead of whenever the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows and bytes up to which a table may be broadcast. A table beyond either is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files; the session's own setting is put back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: smaller there than a checkpoint, and with no lineage either."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with a checkpoint in the shared folder in place of its lineage, and without the shuffle files that led to it."""
    shared_folder(df.sparkSession)
    with _cleaned(df.sparkSession):
        return df.select("*").checkpoint()  # a query of its own, made under the setting


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows, and at most so many bytes when written as JSON text.

    Only ``rows`` + 1 rows are looked at. Give a stored table: the answer runs a query of its own.
    """
    some = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).cast("long").alias("bytes"))
    found = some.agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= rows and found["bytes"] <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is proven small, else as it is."""
    return F.broadcast(df) if is_small(df, rows, size) else df
