"""Where intermediate tables go: the shared folder that the cluster names; and which tables are small enough to be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes up to which a table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES, needed: bool = False) -> DataFrame:
    """``df`` with a broadcast hint if it has at most so many rows and, as JSON text, bytes; else as it is, or an error where the broadcast is ``needed``."""
    some = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).cast("long").alias("bytes"))
    found = some.agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    if found["rows"] <= rows and found["bytes"] <= size:
        return F.broadcast(df)
    if needed:
        raise ValueError(f"a join without a key takes a small side of {rows} rows and {size} bytes at most, not {found['rows']} rows and {found['bytes']} bytes")
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: that in spark.checkpoint.dir; only where a local session names none, a new temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="brindle-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` worked out once and kept in the shared folder, so that whatever reads it reads the same rows in the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
