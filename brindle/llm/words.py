"""Words, k-word hashes and set hashes of a whole Arrow batch of texts, without a Python loop over texts.

Bytes A-Z are lowered first; a word is a longest run of word bytes. UTF-8 bytes of 0x80 and
above are word bytes in both alphabets, so working on bytes equals working on characters.
Hashes are 64 bits and depend on the words only, never on the batch or the process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: anything but ASCII white space / letters, digits and everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

STEP = 1 << 18
_R = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _at(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """64 bits for a byte at a place of its word, without arithmetic between the bytes' values.

    A word's hash is a sum of these. A polynomial in the bytes would not do: modulo 2^64 it is equal, in any
    odd base, for words of 1024 letters and more whose letters follow the Thue-Morse sequence and its complement.
    """
    return mix(((place.astype(U) << U(8)) | byte.astype(U)) + U(_R))


PLACES = 64
_FIRST = _at(*np.divmod(np.arange(PLACES * 256), 256))


def powers(n: int) -> np.ndarray:
    """Odd factors for the words of a short run, whose own hashes are mixed already."""
    return np.multiply.accumulate(np.append(np.ones(1, U), np.full(n - 1, _R, U)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one offset more than texts); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch: ``hash`` and ``doc`` of each, ``first`` word of each text (one more than texts)."""

    def __init__(self, column: pa.Array, alphabet: np.ndarray):
        data, offsets = text_bytes(column)
        self.n_docs = len(offsets) - 1
        hashes, starts = [], []
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        at = 0
        while at < len(data):
            end = self._cut(data, alphabet, begins, at, min(at + STEP, len(data)))
            h, s = self._chunk(LOWER[data[at:end]], alphabet, begins[at : end + 1])
            hashes.append(h)
            starts.append(s + at)
            at = end
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U)
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.doc = np.searchsorted(offsets[1:], start, "right")
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        self.count = np.diff(self.first)

    @staticmethod
    def _cut(data, alphabet, begins, at, end):
        """The last place up to end where no word is cut, or the first one after it."""
        step = 4096
        while end < len(data):
            lo = max(at + 1, end - step)
            free = np.flatnonzero(~alphabet[data[lo - 1 : end]] | begins[lo : end + 1][: end - lo + 1])
            if len(free):
                return int(lo + free[-1])
            if lo == at + 1:
                end, step = min(end + STEP, len(data)), 2 * STEP + step
            else:
                step *= 8
        return end

    @staticmethod
    def _chunk(low, alphabet, begins):
        word = alphabet[low]
        before = np.zeros(len(low), bool)
        before[1:] = word[:-1]
        before &= ~begins[:-1]
        start = np.flatnonzero(word & ~before)
        if not len(start):
            return np.zeros(0, U), start
        inside = np.flatnonzero(word)
        first = np.searchsorted(inside, start)
        length = np.diff(np.append(first, len(inside)))
        place = np.arange(len(inside)) - np.repeat(first, length)
        byte = low[inside]
        value = _FIRST[np.minimum(place, PLACES - 1) << 8 | byte]
        if len(far := np.flatnonzero(place >= PLACES)):
            value[far] = _at(place[far], byte[far])
        h = np.add.reduceat(value, first)
        return mix(h + length.astype(U) * U(0xD6E8FEB86659FD93)), start

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of each run of k words within one text; place is that of its first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        place = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        p = powers(k + 2)
        h = np.zeros(n, U)
        for i in range(k):
            h += self.hash[i : i + n] * p[i + 1]
        return place, mix(h[place] + U(k * 0xA0761D6478BD642F % 2**64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of each text's distinct k-word shingles by doc, then hash; a text of fewer words has its whole sequence as one."""
        size = np.where(self.count >= k, self.count - k + 1, self.count > 0)
        doc = np.repeat(np.arange(self.n_docs), size)
        h = np.empty(len(doc), U)
        h[self.count[doc] >= k] = self.grams(k)[1]
        for n in range(1, k):
            if (self.count == n).any():
                place, short = self.grams(n)
                h[self.count[doc] == n] = short[self.count[self.doc[place]] == n]
        end = np.cumsum(size)
        for i in np.flatnonzero(size > 1):
            h[end[i] - size[i] : end[i]].sort()
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        return doc[new], h[new]


def lists(first: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: list i is values[first[i]:first[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def parts(batches, most: int = 1 << 20, column: str = "text"):
    """The rows of Arrow batches in slices of about so many bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end
