"""Counts of tokens over sets, packed, against a plain count."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import counting
from brindle.llm.words import U, lists


@pytest.mark.parametrize("rows", [0, 1, 700])
def test_counts_equal_a_plain_count(spark, rows):
    def tokens_of(i):
        return [] if i % 50 == 7 else sorted({1, 2**63 + i % 3, *((i * 2654435761 + j * j * 97) % 1009 for j in range(i % 40))})  # 1 stands in nearly all

    def make(batches):
        chunks = counting.Chunks()
        for batch in batches:
            sets = [np.asarray(tokens_of(i), U) for i in batch.column("id").to_pylist()]
            first = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), chunks.of(np.diff(first)), counting.packed(first, np.concatenate(sets).astype(U))], ["id", "chunk", "tokens"])

    def finish(rows, tokens, first, df):
        return pa.Table.from_arrays([rows.column("id"), lists(first, tokens.view(np.int64), pa.int64()), lists(first, df, pa.int64())], ["id", "tokens", "df"])

    made = spark.range(0, rows, 1, 5).mapInArrow(make, "id long, chunk long, tokens binary")
    got = {r["id"]: (r["tokens"], r["df"]) for r in counting.with_counts(made, finish, "id long, tokens array<long>, df array<long>").collect()}
    df = Counter(t for i in range(rows) for t in tokens_of(i))
    assert got == {i: ([int(np.asarray(t, U).view(np.int64)) for t in tokens_of(i)], [df[t] for t in tokens_of(i)]) for i in range(rows)}


def test_a_packed_column_is_read_again():
    first, values = np.array([0, 2, 2, 5]), np.arange(5, dtype=U)
    column = counting.packed(first, values)
    again, start = counting.unpacked(column.slice(1, 2), U)
    assert again.tolist() == [2, 3, 4] and start.tolist() == [0, 0, 3]
    assert counting.unpacked(pa.array([], pa.binary()), U)[1].tolist() == [0]
