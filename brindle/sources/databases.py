"""Tables in SQLite files as a data source of Spark, and tables written to such files.

``read_tables`` takes files in a folder that the driver and all executors see. A file is a partition, a large one
several, by ranges of row numbers; comparisons with constants go to the files' own WHERE, so rows that they
leave out don't reach Spark. Rows are read some thousands at a time into Arrow batches.

``write_tables`` writes a file for each task, under a name of its own for each attempt; only files that a
finished task has reported are read, so one that a lost executor began is never seen.
"""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing, contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

#: Bytes of a file in a partition, and rows of a batch.
PART_BYTES, BATCH_ROWS = 64 << 20, 10_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
KINDS = {LongType(): "INTEGER", IntegerType(): "INTEGER", DoubleType(): "REAL", StringType(): "TEXT"}
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{_local(path)}?mode=ro&immutable=1", uri=True)


@dataclass
class RowRange(InputPartition):
    path: str
    first: int
    last: int


class TableReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.paths, self.table, self.schema = json.loads(options["paths"]), options["table"], schema
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.conditions: list[str] = []
        self.values: list = []

    def partitions(self) -> list[RowRange]:
        out = []
        for path in self.paths:
            pieces = -(-os.path.getsize(_local(path)) // self.part_bytes)
            if pieces <= 1:
                out.append(RowRange(path, -(2**63), 2**63 - 1))
                continue
            with closing(_opened(path)) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            if low is None:
                continue
            step = -(-(high - low + 1) // pieces)
            out += [RowRange(path, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        return out or [RowRange("", 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        kind = to_arrow_schema(self.schema)
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.conditions])
        columns = ", ".join(_quoted(c) for c in self.schema.names)
        with closing(_opened(partition.path)) as db:
            rows = db.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE {where}", [partition.first, partition.last, *self.values])
            while some := rows.fetchmany(BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kind, strict=True)], schema=kind)


class FilteringReader(TableReader):
    """A reader for sessions that push conditions down; Spark refuses it in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes comparisons of a column of a plain type with constants of one, and tests for null; gives back what Spark has to do."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            known = column is not None and self.schema[column].dataType in KINDS
            if known and type(f) in COMPARED and isinstance(value, (int, float, str)) and value == value:
                self.conditions.append(f"{_quoted(column)} {COMPARED[type(f)]} ?")
                self.values.append(value)
            elif known and isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in value) and len(value) <= 500:
                self.conditions.append(f"{_quoted(column)} IN ({', '.join('?' * len(value))})")
                self.values += value
            elif known and isinstance(f, (IsNull, IsNotNull)):
                self.conditions.append(f"{_quoted(column)} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            else:
                yield f


class SqliteTable(DataSource):
    """Options: paths (a JSON list of files), table; partbytes, pushdown. The schema is given; columns are found by name."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema: StructType) -> TableReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else TableReader)(dict(self.options), schema)


def read_tables(spark: SparkSession, paths: list[str], table: str, schema: StructType, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of a table that all files have; of schemas of long, int, double and string. Conditions are pushed down if this and what uses it runs ``pushing_down``."""
    spark.dataSource.register(SqliteTable)
    pushdown = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format("sqlite_table").schema(schema).options(paths=json.dumps(paths), table=table, partbytes=part_bytes, pushdown=pushdown).load()


@contextmanager
def pushing_down(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave conditions to data sources; the session's own setting is put back."""
    before = spark.conf.get(PUSHDOWN, "false")
    spark.conf.set(PUSHDOWN, "true")
    try:
        yield
    finally:
        spark.conf.set(PUSHDOWN, before)


def write_tables(df: DataFrame, folder: str, table: str) -> list[str]:
    """Write ``df`` to SQLite files below ``folder``, one for each partition that has rows; their paths. Columns of other types are to be cast before."""
    kinds = [KINDS[f.dataType] for f in df.schema]
    os.makedirs(_local(folder), exist_ok=True)
    made = f"CREATE TABLE {_quoted(table)} ({', '.join(f'{_quoted(c)} {k}' for c, k in zip(df.columns, kinds, strict=True))})"
    insert = f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(kinds))})"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, db = f"{_local(folder)}/{table}-{uuid.uuid4().hex}.db", None
        for batch in batches:
            if batch.num_rows:
                if db is None:
                    db = sqlite3.connect(path)
                    db.execute("PRAGMA journal_mode = OFF")
                    db.execute(made)
                db.executemany(insert, zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if db is not None:
            db.commit()
            db.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return sorted(r["path"] for r in df.mapInArrow(write, "path string").collect())  # a row for each task
