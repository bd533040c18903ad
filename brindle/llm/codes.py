"""Vector codes: each vector is cut into parts, and each part becomes the number of its codebook's nearest entry.

Components are integers, ``floor(scale * x)``, so distances, sums and ties are exact. In each round
every codebook is made into a kd-tree and all trees are broadcast (entries x dimensions integers,
whatever the rows). A task searches its parts by branch and bound: a node is entered unless its bound
is greater than the best distance so far, so nodes of an equal bound are entered too and of equally
near entries the lower index is found. Tasks add up the parts of each entry, Spark adds up the tasks'
sums, and the driver gets one number for each component of each entry.

What takes no part: null vectors, those that hold null or non-finite components, components of 2^50
or more, or another number of components than most (the greater number of equally frequent ones).
Repeated rows count as often as they are there; a null vec_id comes after all others. With fewer rows
than entries a codebook has as many entries as rows. Where the length is no multiple of the parts,
the first parts are one longer. An error that doesn't fit in a long is null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.ann import element, matrix
from brindle.llm.store import shared_folder, small, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a leaf, and rows that are searched at a time.
LEAF, TILE = 2, 4096
#: Above any distance in 64 bits, and the greatest sum of squares that is worked out in them.
FAR, SAFE = 2**63 - 1, 2**61


@dataclass
class Node:
    """A leaf with ``entries``, or a cut of dimension ``dim``: low entries reach up to ``low_end``, high ones begin at ``high_start``."""

    entries: np.ndarray
    dim: int = 0
    low_end: int = 0
    high_start: int = 0
    low: Node | None = None
    high: Node | None = None


def grow(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """A kd-tree of a codebook: the widest dimension is cut where two neighbouring values nearest to the middle differ."""
    entries = np.arange(len(book)) if entries is None else entries
    own = book[entries]
    spread = own.max(0) - own.min(0) if own.size else np.zeros(1, int)
    if len(entries) <= LEAF or not max(spread):
        return Node(entries)
    dim = int(np.argmax(spread))
    order = entries[np.argsort(own[:, dim], kind="stable")]
    values = book[order, dim]
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    cut = int(cuts[np.argmin(np.abs(cuts - len(order) // 2))])
    return Node(entries, dim, values[cut - 1], values[cut], grow(book, order[:cut]), grow(book, order[cut:]))


def search(tree: Node, book: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of ``x`` (of equally near ones the lower index) and its squared distance."""
    best, entry = np.full(len(x), FAR if x.dtype != object else 2**4000, x.dtype), np.full(len(x), len(book))
    # a node's rows, their bounds, and in each dimension how far the node is from them
    stack = [(tree, np.arange(len(x)), np.zeros(len(x), x.dtype), np.zeros_like(x))]
    while stack:
        node, rows, bound, gap = stack.pop()
        near = bound <= best[rows]
        rows, bound, gap = rows[near], bound[near], gap[near]
        if not len(rows):
            continue
        if node.low is None:
            for e in node.entries:
                apart = ((x[rows] - book[e]) ** 2).sum(1)
                better = (apart < best[rows]) | ((apart == best[rows]) & (e < entry[rows]))
                best[rows[better]], entry[rows[better]] = apart[better], e
            continue
        at = x[rows, node.dim]
        high = at >= node.high_start
        for own, far, away in ((high, node.low, at - node.low_end), (~high, node.high, node.high_start - at)):
            other = gap[own].copy()
            more = np.maximum(other[:, node.dim], away[own])
            further = bound[own] - other[:, node.dim] ** 2 + more**2
            other[:, node.dim] = more
            stack.append((far, rows[own], further, other))
        for own, near_side in ((high, node.high), (~high, node.low)):  # taken from the stack before the far sides
            stack.append((near_side, rows[own], bound[own], gap[own]))
    return entry, best


def cuts(width: int, parts: int) -> list[int]:
    """Where each part begins, and the end."""
    return [0, *np.cumsum([width // parts + (p < width % parts) for p in range(parts)]).tolist()]


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """(rows, width): floor(scale * x) of a column of lists of one length, below 2^62 as components are below 2^50."""
    return np.floor((matrix(column) if width else np.zeros((len(column), 0))) * scale).astype(np.int64).reshape(len(column), width)


def assign(books: list[np.ndarray], trees: list[Node], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts): entries and squared distances. Python's integers are used where 64 bits are too few."""
    edges = np.cumsum([0, *[b.shape[1] for b in books]])
    most = max([int(np.abs(x).max(initial=0)), *[int(np.abs(b).max(initial=0)) for b in books]])
    kind = np.int64 if 4 * most * most * max(1, x.shape[1]) < SAFE else object
    x = x.astype(kind)
    found = [search(t, b.astype(kind), x[:, a:z]) for t, b, a, z in zip(trees, books, edges[:-1], edges[1:], strict=True)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _tiles(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            yield part, integers(part.column("vec"), width, scale)


def _sums(shared, width: int, scale: int):
    """Of a task's rows: (part, entry, place, total) with each component's sum at its place, and the count at place -1."""

    def run(batches):
        books, trees = shared.value
        totals = [np.zeros((len(b), b.shape[1]), object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        edges = np.cumsum([0, *[b.shape[1] for b in books]])
        for _, x in _tiles(batches, width, scale):
            entry = assign(books, trees, x)[0]
            wide = int(np.abs(x).max(initial=0)) * TILE >= SAFE
            for p, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                counts[p] += np.bincount(entry[:, p], minlength=len(counts[p]))
                own = x[:, a:z].astype(object) if wide else x[:, a:z]
                for e in np.unique(entry[:, p]):
                    totals[p][e] += own[entry[:, p] == e].sum(0).astype(object)
        rows = [(p, e, k, t) for p, c in enumerate(counts) for e in np.flatnonzero(c) for k, t in [(-1, c[e]), *enumerate(totals[p][e])]]
        part, at, place, total = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(at, pa.int32()), pa.array(place, pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["part", "entry", "place", "total"])

    return run


def _codes(shared, width: int, scale: int, kept: list[str]):
    def run(batches):
        books, trees = shared.value
        for batch, x in _tiles(batches, width, scale):
            entry, apart = assign(books, trees, x)
            code = ["".join(f"{e:02x}" for e in row) for row in entry.tolist()]
            error = [e if e <= FAR else None for e in apart.sum(1).tolist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(code, pa.string()), pa.array(error, pa.int64())], [*kept, "code", "error"])

    return run


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label, vec of the vectors that take part, and their length."""
    kind = element(vectors)
    own = vectors.select("vec_id", "label", F.col("embedding").cast(f"array<{kind}>").alias("vec"))
    own = own.filter("vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < 1125899906842624)")
    most = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = most["n"] if most else 0
    return own.filter(F.size("vec") == width), width


@dataclass
class Codebooks:
    """One array (entries, components) of integers for each part."""

    books: list[np.ndarray]
    scale: int = SCALE

    def trees(self) -> list[Node]:
        return [grow(b) for b in self.books]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for v in b.ravel()).encode()).hexdigest()

    def decode(self, code: Column) -> Column:
        """The vector that a code stands for: the entries' components over the scale, native."""
        table = F.array(*[F.array(*[F.array(*[F.lit((int(v) + 0.5) / self.scale) for v in e]).cast("array<double>") for e in b]) for b in self.books])
        at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
        return F.concat(*[F.get(F.get(table, F.lit(p)), at(p)) for p in range(len(self.books))])


def _fitted(own: DataFrame, width: int, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").toArrow().column("vec").combine_chunks()
    edges, start = cuts(width, parts), integers(first, width, scale)
    found = Codebooks([start[:, a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)], scale)
    for _ in range(rounds if width else 0):
        shared = own.sparkSession.sparkContext.broadcast((found.books, found.trees()))
        summed = own.select("vec").mapInArrow(_sums(shared, width, scale), "part int, entry int, place int, total decimal(38,0)")
        totals = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in summed.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()}
        shared.destroy()
        books = [b.copy() for b in found.books]
        for (p, e, k), total in totals.items():
            if k >= 0:
                books[p][e, k] = total // totals[p, e, -1]
        same = all((a == b).all() for a, b in zip(books, found.books, strict=True))
        found.books = books
        if same:  # and so would be every later round's
            break
    return found


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Codebooks, DataFrame]:
    """The fitted codebooks, and (vec_id, label, code, error) of each vector that takes part."""
    shared_folder(vectors.sparkSession)
    own, width = usable(vectors)
    found = _fitted(own, width, parts, entries, rounds, scale)
    shared = own.sparkSession.sparkContext.broadcast((found.books, found.trees()))
    schema = own.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    return found, own.mapInArrow(_codes(shared, width, scale, ["vec_id", "label"]), schema)


def compress_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors of equal labels, null labels together; null if they don't fit in a long), codebooks_sha256."""
    found, coded = compress(vectors)
    coded = stored(coded)
    whole = F.when(F.count_if(F.col("error").isNull()) == 0, F.try_sum("error"))
    totals = stored(coded.groupBy(F.col("label").alias("of")).agg(whole.alias("label_error")))
    joined = coded.join(small(totals), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))
