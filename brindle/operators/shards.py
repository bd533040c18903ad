"""K4: contiguous shards of an order, none of more bytes than a target but those of a single row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from brindle.storage import cut, small

#: A shard is made of cells of at most this part of the target, so it is filled to all but this part at least.
CELLS_A_SHARD = 16


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row as JSON text."""
    return F.octet_length(F.to_json(F.struct(*[df[c] for c in df.columns]))).cast("long")


def _filled(cells: list[tuple[int, int]], target: int) -> list[tuple[int, int]]:
    """(cell, shard): cells in order, as many in a shard as the target allows."""
    out, shard, held = [], 0, 0
    for cell, size in cells:
        if held and held + size > target:
            shard, held = shard + 1, 0
        out.append((cell, shard))
        held += size
    return out


def by_bytes(df: DataFrame, order: list[str], size: Column, target: int) -> DataFrame:
    """``df`` with shard (from 0, in the order of columns) and n_shards.

    Rows are range-partitioned and sorted once. Sums of their sizes within the partitions, plus what stands in
    partitions before, give each row's place in bytes; a cell holds what lies within a sixteenth of the target, and a row
    over such a border is a cell of its own. Cells, some 32 a shard however many rows, are filled into shards in order.
    A size of null or less than nothing counts as 0; rows equal in all columns of the order are in any order. No window runs over the whole table.
    """
    spark: SparkSession = df.sparkSession
    part, step = F.col("__part"), max(1, target // CELLS_A_SHARD)
    sized = df.withColumn("__size", F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)))
    placed = cut(sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    totals = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.sum("__size").alias("n")).collect())  # a row a partition
    ahead, before = [], 0
    for p, n in totals:
        ahead.append((p, before))
        before += n
    starts = spark.createDataFrame(ahead, StructType([StructField("__part", LongType()), StructField("__ahead", LongType())]))
    upto = F.sum("__size").over(Window.partitionBy("__part").orderBy("__id")) + F.col("__ahead")
    placed = placed.join(F.broadcast(starts), "__part").withColumn("__end", upto)
    first, last = F.floor((F.col("__end") - F.col("__size")) / step), F.floor((F.col("__end") - 1) / step)
    placed = cut(placed.withColumn("__cell", F.when(F.col("__size") == 0, 2 * first).when(first == last, 2 * first).otherwise(2 * first + 1)))
    cells = sorted((r["__cell"], r["n"]) for r in placed.groupBy("__cell").agg(F.sum("__size").alias("n")).collect())
    filled = _filled(cells, target)
    shards = spark.createDataFrame(filled, StructType([StructField("__cell", LongType()), StructField("shard", LongType())]))
    n = F.lit(filled[-1][1] + 1 if filled else 0).cast("long").alias("n_shards")
    return placed.join(small(shards), "__cell").select(*df.columns, "shard", n)


def shard_name(shard: Column, n_shards: Column, split: str = "train") -> Column:
    """``train-00000-of-00012``."""
    return F.format_string(f"{split}-%05d-of-%05d", shard, n_shards)


def write(df: DataFrame, path: str, order: list[str], size: Column, target: int, split: str = "train") -> DataFrame:
    """Write each shard as Parquet to a folder of its name; name, rows and bytes of each, as planned."""
    named = cut(by_bytes(df.withColumn("__bytes", size), order, F.col("__bytes"), target).withColumn("name", shard_name(F.col("shard"), F.col("n_shards"), split)))
    named.drop("shard", "n_shards", "__bytes").repartition("name").sortWithinPartitions("name", *order).write.mode("overwrite").partitionBy("name").parquet(path)
    return named.groupBy("name").agg(F.count("*").alias("n_rows"), F.sum("__bytes").alias("bytes"))
