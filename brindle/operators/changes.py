"""The changes between two versions of a text, line by line, and their application.

A change replaces ``n_removed`` lines from line ``start`` (from 0) of the earlier text by ``added``.
Changes are the least possible: as few lines removed and added as any, by a longest common
subsequence of lines. Lines end at a line feed; a null text is an empty one, and an empty text is
one empty line. Finding changes is a small helper in Arrow batches, a pair at a time; counting,
applying and printing them are native expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import lcs

CHANGE = "array<struct<start:int,n_removed:int,added:array<string>>>"
_KIND = pa.list_(pa.struct([("start", pa.int32()), ("n_removed", pa.int32()), ("added", pa.list_(pa.string()))]))


def line_changes(before: str, after: str) -> list[dict]:
    """The changes that make ``after`` of ``before``, in order, none next to another."""
    a, b = before.split("\n"), after.split("\n")
    out, i, j = [], 0, 0
    for x, y in [*lcs.pairs(a, b), (len(a), len(b))]:
        if i < x or j < y:
            out.append({"start": i, "n_removed": x - i, "added": b[j:y]})
        i, j = x + 1, y + 1
    return out


def with_changes(versions: DataFrame, before: str, after: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and changes, for each row's two texts."""
    own = versions.select(*dict.fromkeys([*keep, before, after]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (batch.column(c).to_pylist() for c in (before, after))
            found = [line_changes(a or "", b or "") for a, b in zip(*texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, _KIND)], [*keep, "changes"])

    schema = own.select(*keep).selectExpr("*", f"cast(null as {CHANGE}) changes").schema
    return own.mapInArrow(run, schema)


def n_removed(changes: Column) -> Column:
    """Lines taken out by all changes."""
    return F.aggregate(changes, F.lit(0), lambda n, c: n + c.n_removed)


def n_added(changes: Column) -> Column:
    """Lines put in by all changes."""
    return F.aggregate(changes, F.lit(0), lambda n, c: n + F.size(c.added))


def applied(before: Column, changes: Column) -> Column:
    """The later text: unchanged stretches of the earlier one and what the changes add, in turn."""
    lines = F.split(F.coalesce(before, F.lit("")), "\n", -1)
    end = F.struct(F.size(lines).alias("start"), F.lit(0).alias("n_removed"), F.array().cast("array<string>").alias("added"))
    all_ = F.concat(changes, F.array(end))
    until = lambda i: F.when(i > 0, F.get(all_, i - 1).start + F.get(all_, i - 1).n_removed).otherwise(F.lit(0))
    return F.array_join(F.flatten(F.transform(all_, lambda c, i: F.concat(F.slice(lines, until(i) + 1, c.start - until(i)), c.added))), "\n")


def unified(before: Column, changes: Column) -> Column:
    """The changes as diff text without context: a head with places and counts, then lines with ``-`` and lines with ``+``."""
    lines = F.split(F.coalesce(before, F.lit("")), "\n", -1)
    shift = lambda i: F.aggregate(F.slice(changes, 1, i), F.lit(0), lambda n, c: n + F.size(c.added) - c.n_removed)
    place = lambda start, n: F.concat_ws(",", F.when(n > 0, start + 1).otherwise(start), n)
    head = lambda c, i: F.concat(F.lit("@@ -"), place(c.start, c.n_removed), F.lit(" +"), place(c.start + shift(i), F.size(c.added)), F.lit(" @@"))
    signed = lambda sign, of: F.transform(of, lambda x: F.concat(F.lit(sign), x))
    return F.array_join(F.flatten(F.transform(changes, lambda c, i: F.concat(F.array(head(c, i)), signed("-", F.slice(lines, c.start + 1, c.n_removed)), signed("+", c.added)))), "\n")
