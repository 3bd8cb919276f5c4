"""Words and hashes of Arrow string columns, a stretch of rows at a time in numpy.

Texts stay UTF-8 bytes. All functions here run inside tasks on one Arrow batch; the
rows of a batch are taken in stretches of about ``STRETCH`` bytes, so that memory does
not grow with the batch. A text longer than that is a stretch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

STRETCH = 1 << 18
U = np.uint64
_STEP, _SPLIT1, _SPLIT2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


@cache
def spaced() -> np.ndarray:
    """Which bytes belong to words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[32, *range(9, 14)]] = False
    return table


@cache
def alphanumeric() -> np.ndarray:
    """Which bytes belong to words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased text."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


@cache
def lowered() -> np.ndarray:
    """A-Z to a-z, byte by byte."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class Stretch(NamedTuple):
    """Rows ``first`` to ``first + len(bounds) - 1`` of a batch with their words.

    ``begin`` and ``end`` are byte positions of the words in ``data``; row i holds words
    ``bounds[i]:bounds[i + 1]`` and bytes ``edges[i]:edges[i + 1]``.
    """

    first: int
    data: np.ndarray
    edges: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.edges) - 1


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row edges of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    _, places, content = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    edges = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    return data, edges.astype(np.int64)


def stretches(column: pa.Array, inside: np.ndarray, lower: bool = False) -> Iterator[Stretch]:
    """The rows of ``column`` in stretches, split into words of the bytes in ``inside``."""
    for first, part, own in portions(column):
        if lower:
            part = lowered()[part]
        yield Stretch(first, part, own, *_words(part, own, inside))


def portions(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of ``column`` in stretches: number of the first row, bytes, and edges of the rows."""
    if not len(column):
        return
    data, edges = raw(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(edges, edges[first] + STRETCH, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[edges[first] : edges[last]], edges[first : last + 1] - edges[first]
        first = last


def _words(data: np.ndarray, edges: np.ndarray, inside: np.ndarray):
    n = len(data)
    word = inside[data]
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    before[1:] = word[:-1]
    after[:-1] = word[1:]
    opens, closes = edges[:-1], edges[1:]
    before[opens[opens < n]] = False
    after[closes[closes > opens] - 1] = False
    begin = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return begin, end, np.searchsorted(begin, edges)


@cache
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20240117).integers(1, 2**63, 256, np.int64).astype(U) | U(1)


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd number and of its inverse modulo 2**64; the largest tables are kept."""
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << max(18, (n - 1).bit_length())
        base = 0x5851F42D4C957F2D
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.ones(1, U)
            step = b
            while len(table) < size:
                table = np.concatenate([table, table * U(step)])
                step = step * step % (1 << 64)
            both.append(table)
        _powers[:] = [tuple(both)]
    return _powers[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word."""
    h = h ^ (h >> U(30))
    h = h * _SPLIT1
    h ^= h >> U(27)
    h *= _SPLIT2
    h ^= h >> U(31)
    return h


def word_hashes(s: Stretch) -> np.ndarray:
    """A 64-bit hash of each word from sums over its bytes, with no loop over words."""
    out = np.empty(len(s.begin), U)
    at = 0
    while at < len(out):
        base = int(s.begin[at])
        to = max(at + 1, int(np.searchsorted(s.end, base + STRETCH, "right")))
        begin, end = s.begin[at:to] - base, s.end[at:to] - base
        n = int(end[-1])
        power, inverse = _power_tables(n)
        sums = np.zeros(n + 1, U)
        np.cumsum(_byte_codes()[s.data[base : base + n]] * power[:n], out=sums[1:])
        out[at:to] = (sums[end] - sums[begin]) * inverse[begin]
        at = to
    return mix(out + U(1))


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of every run of ``size`` successive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.full(n, U(salt * 2 + 1), U)
    for j in range(size):
        h *= _STEP
        h += words[j : j + n]
        h ^= h >> U(29)
    return mix(h)


def sequence_hash(words: np.ndarray, salt: int = 0) -> int:
    """A signed 64-bit hash of a whole sequence of word hashes."""
    n = len(words)
    power = _power_tables(max(n, 1))[0][:n]
    with np.errstate(over="ignore"):
        total = np.sum(mix(words + U(salt)) * power, dtype=U) + U(n)
    return int(mix(np.array([total], U)).view(np.int64)[0])


def short_keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First eight bytes, last eight bytes and length of words of up to 16 bytes, which tell them apart.

    The last is 0 for words of up to eight bytes. ``data`` has eight bytes more than the words.
    """
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    n = (end - begin).astype(np.uint8)
    return eight[begin] & _masks()[n], np.where(n > 8, eight[np.maximum(end - 8, 0)], U(0)), n


@cache
def _masks() -> np.ndarray:
    """Masks of the first n bytes of eight."""
    return np.array([(1 << 8 * min(n, 8)) - 1 for n in range(17)], U)


def covered(hit: np.ndarray, size: int) -> np.ndarray:
    """Words inside any of the windows of ``size`` words that are flagged by their first word."""
    steps = np.zeros(len(hit) + size, np.int32)
    steps[: len(hit)] += hit
    steps[size:] -= hit
    return np.cumsum(steps[:-1]) > 0
