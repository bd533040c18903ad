"""Streams: new files, read-once values with a time to live, key states."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 100, kind: str = "parquet") -> DataFrame:
    """Rows of files that appear below a folder, each file once; the checkpoint remembers which."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).format(kind).load(folder)


class ReadOnce(StatefulProcessor):
    """Puts and gets of a key in the order of their times; a get takes the value unless its time is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._value = handle.getValueState("value", "value string, expires_at double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # state is read and written once for all rows of a key, as each access asks the JVM
        before = held = self._value.get()
        # rows without a time come last, and neither live nor find anything
        for at, _, row in sorted(((math.inf if r["at"] is None else r["at"], r["seq"], r) for r in rows), key=lambda x: x[:2]):
            if row["op"] == "put":
                held = (row["value"], -math.inf if row["at"] is None else at + row["ttl"])
                continue
            live = held is not None and held[1] > at
            yield Row(key=key[0], seq=row["seq"], value=held[0] if live else None)
            held = None
        if held is not None:
            self._value.update(tuple(held))
        elif before is not None:
            self._value.clear()

    def close(self) -> None:
        pass


def read_once(operations: DataFrame) -> DataFrame:
    """Key, seq and value of each get; ``operations`` has key, seq, op (put or get), value, at and ttl (seconds). Per key all is serial, so a value is read once at most. The time to live is kept with the value, because the built-in one never lets a run over available data end."""
    return operations.groupBy("key").transformWithState(statefulProcessor=ReadOnce(), outputStructType="key string, seq long, value string", outputMode="Append", timeMode="None")


def run_available(df: DataFrame, path: str, checkpoint: str, seconds: int | None = None, mode: str = "append") -> None:
    """Take what is there, write it as Parquet, end; a next call with the same checkpoint goes on from there. There is no limit of time unless ``seconds`` sets one."""
    stream = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    if seconds is None:
        stream.awaitTermination()
    elif not stream.awaitTermination(seconds):
        stream.stop()
        raise TimeoutError(f"the stream to {path} took more than {seconds} s")


def key_state_stream(events: DataFrame) -> DataFrame:
    """T4: each key's latest status as events come in; a maximum of (time, status), so state is one row a key."""
    status = F.when(F.col("event") == "activated", "ACTIVE").when(F.col("event") == "retired", "RETIRED").when(F.col("event") == "deleted", "DELETED").otherwise("PENDING")
    return events.groupBy("key_id").agg(F.max(F.struct("at", status.alias("status"))).alias("m")).select("key_id", "m.at", "m.status")
