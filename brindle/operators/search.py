"""Which of many keywords a text holds, in one pass over the text.

The keywords make one Aho-Corasick automaton over UTF-8 bytes, built once and broadcast. Its table
has a row a state and a column for each class of bytes that keywords tell apart. A batch's texts are
cut into stretches of ``STRETCH`` bytes, each beginning as many bytes early as the longest keyword may
reach back, and all stretches walk the table side by side in numpy, a byte a step. An automaton holds
at most ``CELLS`` cells; a longer list of keywords is dealt over several, each with a pass of its own,
so no list is too long.

A keyword is found wherever its bytes stand, inside words too. The empty keyword is in every text,
null texts hold nothing, null keywords are left out, and a keyword given twice is found twice. Case
is the caller's matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from brindle.functions.tokens import text_bytes

STRETCH, CELLS, SLICE_BYTES = 2048, 1 << 24, 4 << 20
#: Bytes of keywords that are brought to the driver for one automaton.
BLOCK_BYTES = 1 << 20


class Automaton:
    """``next`` (states x classes) and, of the states from ``first_end`` on, the keywords that end there."""

    def __init__(self, words: list[bytes]):
        self.empty = [i for i, w in enumerate(words) if not w]
        used = np.unique(np.frombuffer(b"".join(words), np.uint8))
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.longest = max(map(len, words), default=0)
        children: list[dict[int, int]] = [{}]
        own: list[list[int]] = [[]]
        for i, word in enumerate(words):
            node = 0
            for c in self.classes[np.frombuffer(word, np.uint8)].tolist():
                node = children[node].setdefault(c, len(children))
                if node == len(children):
                    children.append({})
                    own.append([])
            if node:
                own[node].append(i)
        table = np.zeros((len(children), len(used) + 1), np.int32)
        fail = np.zeros(len(children), np.int64)
        ends: list[list[int]] = [[]] * len(children)
        queue = [0]
        for node in queue:  # breadth first, so that a node's fallback is complete before the node
            ends[node] = own[node] + (ends[fail[node]] if node else [])
            table[node] = table[fail[node]] if node else 0
            for c, child in children[node].items():
                fail[child] = table[fail[node], c] if node else 0
                table[node, c] = child
                queue.append(child)
        order = np.argsort([bool(e) for e in ends], kind="stable")  # states at which a keyword ends come last
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        self.start = int(number[0])
        self.next = number[table[order]]
        self.first_end = int(sum(not e for e in ends))
        size = [len(ends[s]) for s in order[self.first_end :]]
        self.first = np.append(0, np.cumsum(size)).astype(np.int64)
        self.ends = np.array([w for s in order[self.first_end :] for w in ends[s]], np.int64)

    def found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, keyword) of each keyword in each text, by text, then keyword."""
        stretch = max(STRETCH, 8 * self.longest)
        size = np.diff(offsets)
        count = -(-size // stretch)
        text = np.repeat(np.arange(len(size)), count)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * stretch
        begin = offsets[:-1][text] + np.maximum(at - max(self.longest - 1, 0), 0)
        length = np.minimum(offsets[:-1][text] + at + stretch, offsets[1:][text]) - begin
        order = np.argsort(-length, kind="stable")
        text, begin, ends = text[order], begin[order], -length[order]
        classes, wide = self.classes[data], self.next.shape[1]
        flat, state = self.next.ravel(), np.full(len(order), self.start, np.int64)
        hits = [np.zeros(0, np.int64)]
        for j in range(int(-ends[0]) if len(ends) and self.longest else 0):
            n = int(np.searchsorted(ends, -j))  # the longer stretches stand first
            state = flat[state[:n] * wide + classes[begin[:n] + j]].astype(np.int64)
            there = np.flatnonzero(state >= self.first_end)
            if len(there):
                hits.append(text[there] * len(self.next) + state[there])
        at, which = np.divmod(np.unique(np.concatenate(hits)), len(self.next))
        n = np.diff(self.first)[which - self.first_end]
        stop = np.cumsum(n)
        place = np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.first[which - self.first_end] - (stop - n), n)
        pairs = np.repeat(at, n) * max(1, int(self.ends.max(initial=0)) + 1) + self.ends[place]
        pairs = np.unique(pairs)
        return np.divmod(pairs, max(1, int(self.ends.max(initial=0)) + 1))


def _blocks(words: list[str]) -> Iterator[list[int]]:
    """Numbers of the words, dealt over automata of at most CELLS cells."""
    wide = len(set(b"".join(w.encode() for w in words))) + 1
    block, cells = [], 0
    for i, w in enumerate(words):
        own = wide * (len(w.encode()) + 1)
        if block and cells + own > CELLS:
            yield block
            block, cells = [], 0
        block.append(i)
        cells += own
    if block:
        yield block


def _search(shared, text: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = shared.value
        for batch in batches:
            size = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(text)).fill_null(0)), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
                part = batch.slice(at, end - at)
                rows, words = [], []
                valid = np.flatnonzero(np.asarray(part.column(text).is_valid()))
                for numbers, automaton in automata:
                    row, word = automaton.found(*text_bytes(part.column(text)))
                    rows += [row, *[valid for _ in automaton.empty]]
                    words += [numbers[word], *[np.full(len(valid), numbers[e]) for e in automaton.empty]]
                row, word = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, words))
                order = np.lexsort((word, row))
                first = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows)))
                found = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(word[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], found], [*kept, "found"])
                at = end

    return run


def keywords_found(texts: DataFrame, text: str, words: list[str], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and found: the numbers (from 0) of the ``words`` that the text holds, ascending."""
    automata = [(np.array(block), Automaton([words[i].encode() for i in block])) for block in _blocks(words)]
    shared = texts.sparkSession.sparkContext.broadcast(automata)
    own = texts.select(*dict.fromkeys([*keep, text]))
    return own.mapInArrow(_search(shared, text, keep), own.select(*keep).schema.add("found", ArrayType(IntegerType())))


def mentions(texts: DataFrame, text: str, keywords: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and k for each distinct keyword of ``keywords`` (k) and each text that holds it; however many keywords there are."""
    words = keywords.select(F.col("k").cast("string").alias("k")).filter("k is not null").distinct()
    size = words.agg(F.sum(F.octet_length("k").cast("long") + 1)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    parts = []
    for b in range(blocks):
        own = words if blocks == 1 else words.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)
        listed = sorted(r["k"] for r in own.collect())  # about BLOCK_BYTES of them
        names = texts.sparkSession.createDataFrame(list(enumerate(listed)), "number int, k string")
        found = keywords_found(texts, text, listed, keep).select(*keep, F.explode("found").alias("number"))
        parts.append(found.join(F.broadcast(names), "number").select(*keep, "k"))
    if not parts:
        return texts.select(*keep, F.lit(None).cast("string").alias("k")).filter("false")
    return reduce(DataFrame.unionByName, parts)
