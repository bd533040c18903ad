"""Benchmark decontamination by winnowing.

Every item and every document keeps, of each ``window - k + 1`` consecutive k-word hashes, the
smallest (the last of equal ones); so any shared run of ``window`` words or more shares a kept
hash. Kept hashes of documents and items are joined, and each document that hits is extended to
the exact places at which items' windows stand in it, by a join of its windows with the items'.
Items of fewer words than a window are one window: for these the documents' runs of that many
words are looked up whole.

Bitmaps of fixed size over the items' hashes, filled by an aggregation, keep documents' hashes
that no item has out of the shuffle; they never drop one that an item has. Tables made of the
items grow with their words, never with their square, carry hashes only, no texts, and are
broadcast only if their rows and bytes are proven small.

Null and empty texts have no words and hit nothing. A repeated item counts by its item_id, a
null item_id as an item without a name: its words hit, but it isn't listed. Rows that repeat a
document each give their own row. Texts are taken whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.store import small, stored
from brindle.llm.words import ALNUM, U, Words, lists, parts

WINDOW, GRAM = 10, 6
BITS = 24


def winnow(place: np.ndarray, doc: np.ndarray, h: np.ndarray, span: int) -> np.ndarray:
    """Indices of the hashes that are the smallest of some ``span`` consecutive ones of their text, the last of equal ones."""
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, least = np.arange(n), h[:n].copy()
    for i in range(1, span):
        closer = h[i : i + n] <= least
        least[closer], best[closer] = h[i : i + n][closer], np.flatnonzero(closer) + i
    return np.unique(best[doc[:n] == doc[span - 1 :]])


def fingerprints(words: Words, shorts: list[int], window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash): the winnowed hashes, and all hashes of runs of the lengths in ``shorts``."""
    place, h = words.grams(k)
    doc = words.doc[place]
    kept = winnow(place, doc, h, window - k + 1)
    docs, hashes = [doc[kept]], [h[kept]]
    for n in shorts:
        place, h = words.grams(n)
        docs.append(words.doc[place])
        hashes.append(h ^ U(n))
    return np.concatenate(docs), np.concatenate(hashes)


def per_doc(n_docs: int, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's distinct hashes begin, and these."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return np.searchsorted(doc[new], np.arange(n_docs + 1)), h[new]


def _item_prints(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in parts(batches):
            words = Words(batch.column("text"), ALNUM)
            doc, h = fingerprints(words, [], window, k)
            docs, hashes = [doc], [h]
            for n in range(1, window):
                if (words.count == n).any():
                    place, g = words.grams(n)
                    own = words.count[words.doc[place]] == n
                    docs.append(words.doc[place[own]])
                    hashes.append(g[own] ^ U(n))
            first, h = per_doc(words.n_docs, np.concatenate(docs), np.concatenate(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("item_key"), pa.array(words.count, pa.int64()), lists(first, h.view(np.int64), pa.int64())], ["item_key", "n_words", "hs"])

    return run


def _doc_prints(window: int, k: int, shorts: list[int], bitmap):
    def run(batches: Iterator[pa.RecordBatch]):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in parts(batches):
            words = Words(batch.column("text"), ALNUM)
            doc, h = fingerprints(words, shorts, window, k)
            may = in_bitmap(bits, h)
            first, h = per_doc(words.n_docs, doc[may], h[may])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(words.count, pa.int64()), lists(first, h.view(np.int64), pa.int64())], ["doc_id", "text_hash", "n_words", "hs"])

    return run


def _item_windows(window: int):
    """Of each item the distinct windows: their length and hash."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in parts(batches):
            words = Words(batch.column("text"), ALNUM)
            for n in sorted({min(window, int(c)) for c in np.unique(words.count)} - {0}):
                place, h = words.grams(n)
                own = np.minimum(words.count, window)[words.doc[place]] == n
                first, h = per_doc(words.n_docs, words.doc[place[own]], h[own])
                at = pa.array(np.repeat(np.arange(words.n_docs), np.diff(first)))
                yield from slices([batch.column("item_key").take(at), pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64))], ["item_key", "n", "h"])

    return run


def _doc_windows(lengths: list[int], bitmap):
    """Where in each text the runs of these lengths stand whose hash the items' bitmap may have."""

    def run(batches: Iterator[pa.RecordBatch]):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in parts(batches):
            words = Words(batch.column("text"), ALNUM)
            for n in lengths:
                place, h = words.grams(n)
                may = in_bitmap(bits, h)
                place, h = place[may], h[may]
                doc = words.doc[place]
                at = pa.array(doc)
                columns = [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), pa.array(place - words.first[doc], pa.int64())]
                yield from slices(columns, ["doc_id", "text_hash", "n", "h", "place"])

    return run


def slices(columns: list[pa.Array], names: list[str], most: int = 1 << 16):
    """One table's columns as Arrow batches of at most so many rows."""
    whole = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, whole.num_rows, most):
        yield whole.slice(at, most)


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & U(2**BITS - 1)
    return (bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(hashes: DataFrame):
    """A broadcast bitmap of 2**BITS bits in which the low bits of each ``h`` are set."""
    bits = hashes.select(F.expr(f"(h & {2**BITS - 1}) >> 6").alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    bitmap = np.zeros(2**BITS // 64, np.int64)
    if bits:
        bitmap[[r[0] for r in bits]] = [r[1] for r in bits]
    return hashes.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def _merged(batches: Iterator[pa.RecordBatch]):
    """Of each text's hits (place, n) the hit words and the runs they make."""
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        n_hit, runs = [], []
        for hits in batch.column("hits"):
            flat = hits.values
            begin = flat.field("place").to_numpy()
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate((begin + flat.field("n").to_numpy())[order])
            cut = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
            first, last = begin[cut], end[np.append(cut[1:], len(end)) - 1]
            n_hit.append(int((last - first).sum()))
            runs.append([{"first": int(a), "end": int(b)} for a, b in zip(first, last, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n_hit, pa.int64()), pa.array(runs, span)], ["doc_id", "text_hash", "n_hit", "places"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, n_words, n_hit, items (sorted item_ids as strings), places (hit runs of words, end exclusive).

    ``items`` has item_id and text. text_hash is Spark's xxhash64 of the text; with doc_id it stands for the row.
    """
    row = ["doc_id", "text_hash"]
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("item_key", F.xxhash64("item_id", "text"))
    prints = stored(items.mapInArrow(_item_prints(window, k), "item_key long, n_words long, hs array<long>"))
    shorts = sorted(r[0] for r in prints.filter(f"n_words between 1 and {window - 1}").select("n_words").distinct().collect())
    item_prints = stored(prints.select(F.explode("hs").alias("h")).distinct())
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    marked = stored(docs.mapInArrow(_doc_prints(window, k, shorts, bitmap_of(item_prints)), "doc_id long, text_hash long, n_words long, hs array<long>"))

    # Documents that share a fingerprint with an item
    met = marked.filter(F.size("hs") > 0).select(*row, F.explode("hs").alias("h")).join(small(item_prints), "h", "left_semi")
    wanted = small(stored(met.select(*row).distinct()))
    texts = docs.join(wanted, same(docs, wanted), "left_semi")

    # Their hits extended: all places of the items' windows, and the items of the windows that occur
    windows = stored(items.mapInArrow(_item_windows(window), "item_key long, n int, h long"))
    known = stored(windows.select("n", "h").distinct())
    lengths = [*shorts, *([window] if prints.filter(f"n_words >= {window}").limit(1).count() else [])]
    runs = texts.mapInArrow(_doc_windows(lengths, bitmap_of(known)), "doc_id long, text_hash long, n int, h long, place long")
    hits = stored(runs.join(small(known), ["n", "h"], "left_semi").distinct())
    spans = hits.groupBy(*row).agg(F.collect_list(F.struct("place", "n")).alias("hits")).mapInArrow(_merged, "doc_id long, text_hash long, n_hit long, places array<struct<first:long,end:long>>")
    named = hits.select(*row, "n", "h").distinct().join(small(windows), ["n", "h"]).select(*row, "item_key").distinct()
    names = named.join(small(stored(items.select("item_key", "item_id"))), "item_key").groupBy(*row).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = spans.join(names, same(spans, names)).select(*(spans[c] for c in row), "n_hit", "items", "places")
    found = small(stored(found))
    return marked.join(found, same(marked, found), "left").select(
        marked["doc_id"], marked["text_hash"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("places", F.array().cast("array<struct<first:long,end:long>>")).alias("places"),
    )


def decontaminate_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = decontaminate(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that share a whole window with an item."""
    found = decontaminate(docs, items).filter("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["hit_id"]) & (F.xxhash64(docs["text"]) == found["hit_hash"]), "left_anti")
