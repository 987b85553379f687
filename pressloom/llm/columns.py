"""Whole text columns as one byte array: word spans and content hashes in numpy.

A word is a run of bytes other than space and 09-0D.  Hashes are 64-bit polynomial
hashes over a fixed random byte table, taken from prefix sums modulo 2^64 and then
mixed, so any span costs two look-ups.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
ORDER_CODES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    s = np.sort(values)
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    return s[keep]


def order_of(keys: np.ndarray) -> np.ndarray:
    """The stable order of mixed 64-bit keys: one sort of their high bits with the place below, checked on the whole keys."""
    low = np.uint64((1 << max(1, len(keys)).bit_length()) - 1)
    packed = np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64))
    order = (packed & low).view(np.int64)
    met = keys[order]
    return order if (met[1:] >= met[:-1]).all() else np.argsort(keys, kind="stable")


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct mixed keys in order, the place of the first of each, the group of every key, and the groups' sizes."""
    order = order_of(keys)
    met = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = met[1:] != met[:-1]
    start = np.flatnonzero(head)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(head) - 1
    return met[start], order[start], back, np.diff(np.r_[start, len(keys)])


@functools.lru_cache(maxsize=1)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        p = np.full(1 << log2, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Prefix:
    """Prefix sums that hash any span of data."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(max(20, int(len(data) + 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * up[: len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its values; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about limit bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more at the end)."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        first[heads] = inside[heads]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased), and the index of each text's first word."""
    starts, ends, of_text = word_spans(data, offsets)
    return Prefix(LOWER[data]).hash(starts, ends), of_text


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its width-word shingles.

    A text of fewer words gives its whole sequence as one shingle, a text without words none.
    """
    data, offsets = flat(texts)
    words, of_text = word_hashes(data, offsets)
    n = max(0, len(words) - width + 1)
    codes = np.zeros(n, np.uint64)
    for j in range(width):
        codes += words[j : j + n] * ORDER_CODES[j]
    codes = mix(codes)
    for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(codes[a : b - width + 1])
        elif b > a:
            short = (words[a:b] * ORDER_CODES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([short ^ np.uint64(0xA5A5A5A5A5A5A5A5)], np.uint64))
        else:
            yield np.empty(0, np.uint64)
