"""Longest common subsequences by bits: a row of the table is one integer with a bit for each column.

After row i, bit j is 0 where the length grows from column j to j + 1. A row costs a few operations on
integers of as many bits as columns. Pairs whose rows don't fit in memory are halved (Hirschberg).
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np

#: Bits of all rows that are kept for the way back; beyond it the pair is halved.
KEPT_BITS = 1 << 29


def _masks(b: Sequence[Hashable]) -> dict[Hashable, int]:
    places: dict[Hashable, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    out = {}
    for x, at in places.items():
        bits = np.zeros(at[-1] + 1, np.uint8)
        bits[at] = 1
        out[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _rows(a: Sequence[Hashable], b: Sequence[Hashable]):
    mask, full = _masks(b), (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & mask.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def length(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """The length of a longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    v = (1 << len(b)) - 1
    for v in _rows(a, b):  # noqa: B007  the last one counts
        pass
    return len(b) - v.bit_count()


def _lengths(a: Sequence[Hashable], b: Sequence[Hashable]) -> np.ndarray:
    """Of each beginning of b the length with the whole of a."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def pairs(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Places (i, j) of one longest common subsequence, ascending. Equal beginnings and ends are matched first."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    n, m = len(a) - tail, len(b) - tail
    inner = [(i + head, j + head) for i, j in _inner(a[head:n], b[head:m])]
    return [(i, i) for i in range(head)] + inner + [(n + k, m + k) for k in range(tail)]


def _inner(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > KEPT_BITS and len(a) > 1:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _inner(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _inner(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:  # b[j - 1] adds nothing to the first i
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:  # nor does a[i - 1]
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]
