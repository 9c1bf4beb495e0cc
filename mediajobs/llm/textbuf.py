"""Words of whole Arrow batches of texts as numpy arrays.

Texts stay in their UTF-8 buffer. Word boundaries and 64-bit word hashes are
computed for many texts at once; a slice of a batch holds about SLICE_BYTES of
text (or one longer text), which bounds the working memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Bytes of words: all but space and U+0009 to U+000D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters and digits: a-z, 0-9 and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words of texts lo .. lo+len(counts)-1 of a batch, in order."""

    lo: int
    buf: np.ndarray  # bytes, lower-cased
    start: np.ndarray  # of each word, in buf
    end: np.ndarray
    first: np.ndarray  # index of each text's first word; one more at the end
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (one-to-one)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = np.cumprod(step)
    return _powers[kind][:n]


def slices(texts: pa.Array, words: np.ndarray = SPACED) -> Iterator[Words]:
    """Words of lower-cased texts (A-Z only); null counts as empty. ``words``: which bytes are of words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        at = offsets[lo : hi + 1] - offsets[lo]
        buf = LOWER[whole[offsets[lo] : offsets[hi]]]
        inside = words[buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = at[:-1][at[:-1] < at[1:]]  # where a text begins
        first[edge] = inside[edge]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = at[1:][at[:-1] < at[1:]] - 1
        last[edge] = inside[edge]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[buf] * _power("up", len(buf)), out=sums[1:])
        hashes = (sums[end] - sums[start]) * _power("down", len(buf) + 1)[start]
        hashes = mix(hashes + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        yield Words(lo, buf, start, end, np.searchsorted(start, at), hashes)
        lo = hi
