"""Ids and counts of a published tokenizer's tokens, over Arrow batches.

A byte-level tokenizer never merges over certain places of a text, such as the blank before a
word. Texts are cut at such places without a loop, each distinct piece of a batch is encoded once,
and what it gave is laid out for all of its places. Ids are those of whole texts. Tokenizers of
another kind are given whole texts. Null is an empty text.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of a batch's texts that are encoded at a time; pieces, and ids of theirs, after which a worker forgets what it remembers.
SLICE_BYTES, PIECES, IDS = 4 << 20, 500_000, 4 << 20
#: Pieces given to the tokenizer at a time, as its answers take some hundred bytes a piece; bytes and pieces where only counts are asked for.
CHUNK, COUNT_BYTES, COUNT_PIECES = 8192, 1 << 20, 150_000

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: First bytes of characters that are never white space: printed ASCII, and beyond it all but those of U+0080 to U+00BF and U+1000 to U+3FFF.
PRINTED = np.zeros(256, bool)
PRINTED[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0x100)]] = True
#: What ends a run of letters. "<", "|" and ">" are left out, as they stand in the names of special tokens.
STOP = np.zeros(256, bool)
STOP[list(b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~")] = True


def default_path() -> str:
    """The published byte-level vocabulary of some 50,000 tokens, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_tokenizer(path: str | None = None) -> str:
    """A tokenizer's JSON text, to be handed to the tasks; of a fixed size, whatever the tables."""
    with open(path or default_path(), encoding="utf-8") as file:
        return file.read()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins, with one offset more than texts."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at texts, at a blank before a character that is no white space, around a line feed between two printed ones, at a stop after a letter."""
    starts = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        after, before = PRINTED[data[1:]], PRINTED[data[:-1]] & (data[:-1] < 0x80)
        starts[:-2] |= (data[:-1] == 0x20) & after
        starts[1:-1] |= STOP[data[1:]] & LETTER[data[:-1]]
        # the letters of U+00C0 to U+024F, without the two signs among them
        pair = (data[:-2] >= 0xC3) & (data[:-2] <= 0xC8) & ~((data[:-2] == 0xC3) & ((data[1:-1] == 0x97) | (data[1:-1] == 0xB7)))
        starts[2:-1] |= STOP[data[2:]] & pair
        feed = np.flatnonzero((data[1:-1] == 0x0A) & before[:-1] & after[1:]) + 1
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        feed = feed[~begins[feed] & ~begins[feed + 1]]
        starts[feed] = starts[feed + 1] = True
        blank = np.flatnonzero(starts[:-2] & (data[:-1] == 0x20))
        starts[blank[begins[blank + 1]]] = False  # that blank ends its text
    starts[offsets] = True
    return np.flatnonzero(starts)


def spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of each i in turn, length[i] of them."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(first - (end - length), length)


class Encoder:
    """``encode`` gives the ids of a column of texts; it remembers short pieces between batches."""

    def __init__(self, tokenizer_json: str, slice_bytes: int = SLICE_BYTES, most_pieces: int = PIECES):
        self.slice_bytes, self.most_pieces = slice_bytes, most_pieces
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        said = json.loads(tokenizer_json)
        before = said.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer") and said["model"]["type"] == "BPE"
        apart = all(not any(t.get(k) for k in ("lstrip", "rstrip", "single_word")) and not STOP[list(t["content"].encode())].any() and not set(" \n") & set(t["content"]) for t in said.get("added_tokens") or [])
        self.cuts = bool(plain and apart and not said["model"].get("dropout") and not said.get("truncation") and not said.get("padding"))
        #: The least unsigned integer that holds every id.
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.first = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece: ``ids[first[n] : first[n + 1]]`` are its ids."""
        if len(self.number) > self.most_pieces or len(self.ids) > IDS:
            self._forget()
        new = [p for p in pieces if p not in self.number]
        if new:
            ids, sizes = [self.ids], []
            for at in range(0, len(new), CHUNK):
                encoded = [e.ids for e in self.tokenizer.encode_batch_fast(new[at : at + CHUNK], add_special_tokens=False)]
                sizes += map(len, encoded)
                ids.append(np.fromiter(itertools.chain.from_iterable(encoded), self.kind))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.first = np.append(self.first, self.first[-1] + np.cumsum(sizes))
            self.ids = np.concatenate(ids)
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin), with one place more than texts."""
        data, offsets = text_bytes(column)
        starts = piece_starts(data, offsets) if self.cuts else np.unique(offsets)
        if len(starts) < 2:
            return np.zeros(0, self.kind), np.zeros(len(column) + 1, np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        number = self._numbers(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        first, size = self.first[number], np.diff(self.first)[number]
        ends = np.append(0, np.cumsum(size))
        return self.ids[spread(first, size)], ends[np.searchsorted(starts, offsets)]

    def slices(self, batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of a batch with about ``slice_bytes`` of texts each (a longer text is one of its own), their ids and where each text's begin."""
        size = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + self.slice_bytes, "right")))
            part = batch.slice(at, end - at)
            yield part, *self.encode(part.column(column))
            at = end


@functools.lru_cache(maxsize=2)
def encoder(tokenizer_json: str, slice_bytes: int = SLICE_BYTES, most_pieces: int = PIECES) -> Encoder:
    return Encoder(tokenizer_json, slice_bytes, most_pieces)


def with_token_counts(df: DataFrame, text: str, counts: str, tokenizer_json: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the number of tokens of each whole text in the long column ``counts``; 0 for null. A column of that name is replaced. With ``keep`` only these columns come back from the tasks."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json or read_tokenizer())
    kept = [c for c in (df.columns if keep is None else keep) if c != counts]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, COUNT_BYTES, COUNT_PIECES)
        for batch in batches:
            for part, _, first in own.slices(batch, text):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(np.diff(first))], [*kept, counts])

    return df.mapInArrow(count, StructType(df.select(*kept).schema.fields).add(counts, "long"))
