"""In how many sets each token stands, told to every set, without a row for each token.

Sets come with their tokens packed into one binary value and a ``chunk`` number, given in the task
that made them after each ``CHUNK`` tokens. A task deals the distinct tokens of a chunk, with
counts, to buckets by hash; a bucket adds them up and sends every chunk the tokens of it that stand
in more than one set; there the sets meet these counts. Shuffles carry packed runs of tokens. As
tokens are counted before the shuffle, one that a third of all sets share is a value for each
batch of sets and not for each set. Chunks and buckets have a bounded number of tokens (but for
that of one set); the number of buckets follows from the number of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.words import U, mix

CHUNK, BUCKET = 1 << 20, 1 << 20


class Chunks:
    """Chunk numbers of a task's sets, in the order they come."""

    def __init__(self) -> None:
        self.task, self.tokens = TaskContext.get().partitionId() << 32, 0

    def of(self, sizes: np.ndarray) -> pa.Array:
        end = self.tokens + np.cumsum(sizes)
        self.tokens = int(end[-1]) if len(end) else self.tokens
        return pa.array(self.task + (end - sizes) // CHUNK, pa.int64())


def packed(first: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column: value i is the bytes of values[first[i]:first[i + 1]]."""
    offsets = (np.asarray(first, np.int64) * values.itemsize).astype(np.int64)
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column without nulls, and where each row's begin."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.zeros(0, kind), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _deal(buckets: int):
    def run(batches):
        for batch in batches:
            tokens, first = unpacked(batch.column("tokens"), U)
            chunk = np.asarray(batch.column("chunk"))
            owner = np.repeat(chunk, np.diff(first))
            for c in np.unique(chunk):
                own, count = np.unique(mix(tokens[owner == c]), return_counts=True)
                bucket = ((own >> U(32)) * U(buckets)) >> U(32)  # ascends with the tokens
                names, start = np.unique(bucket, return_index=True)
                start = np.append(start, len(own))
                columns = [pa.array(names.astype(np.int64)), pa.array(np.full(len(names), c)), packed(start, own), packed(start, count.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "tokens", "counts"])

    return run


def _add_up(table: pa.Table) -> pa.Table:
    tokens, first = unpacked(table.column("tokens"), U)
    counts, _ = unpacked(table.column("counts"), np.int64)
    order = np.argsort(tokens, kind="stable")
    ascending = tokens[order]
    new = np.ones(len(order), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    total = np.add.reduceat(counts[order], np.flatnonzero(new)) if len(order) else counts
    df = np.empty(len(order), np.int64)
    df[order] = total[np.cumsum(new) - 1]
    several = df > 1
    start = np.concatenate(([0], np.cumsum(several)))[first]
    return pa.Table.from_arrays([table.column("chunk"), packed(start, tokens[several]), packed(start, df[several])], ["chunk", "tokens", "df"])


def _tell(finish: Callable):
    def run(sets: pa.Table, counted: pa.Table) -> pa.Table:
        tokens, first = unpacked(sets.column("tokens"), U)
        known, _ = unpacked(counted.column("tokens"), U)
        df, _ = unpacked(counted.column("df"), np.int64)
        out = np.ones(len(tokens), np.int64)
        if len(known):
            order = np.argsort(known)
            known, df, own = known[order], df[order], mix(tokens)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            out = np.where(known[at] == own, df[at], 1)
        return finish(sets, tokens, first, out)

    return run


def with_counts(sets: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish(rows, tokens, first, df)`` of each chunk of ``sets`` (chunk, tokens and others; a stored table).

    ``rows`` is a chunk's Arrow table, ``tokens`` all of its tokens, ``first`` where each row's
    begin, ``df`` the number of rows of all ``sets`` that hold the token (which a row holds once).
    """
    bytes_ = sets.agg(F.coalesce(F.sum(F.octet_length("tokens").cast("long")), F.lit(0))).first()[0]
    buckets = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), bytes_ // 8 // BUCKET)
    dealt = sets.select("chunk", "tokens").mapInArrow(_deal(buckets), "bucket long, chunk long, tokens binary, counts binary")
    counted = dealt.groupBy("bucket").applyInArrow(_add_up, "chunk long, tokens binary, df binary")
    return sets.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_tell(finish), schema)
