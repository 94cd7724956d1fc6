"""Vectorised text kernels over Arrow string columns, shared by the operators' tasks.

All work on UTF-8 bytes: the separators of both word rules are ASCII, so cutting bytes and
cutting characters agree. A chunk holds whole documents and a few MB at most (or one longer
document), which bounds the memory of a task whatever the Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@lru_cache
def lookup(rule: str) -> np.ndarray:
    """Byte to normalised byte, 0 for separators. ``space``: words are ``[^\\x20\\x09-\\x0D]+``;
    ``alnum``: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Both after lower-casing A-Z.

    NUL is a word byte of rule ``space``; it maps to 0xFF, which UTF-8 never holds.
    """
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    if rule == "space":
        table[0] = 0xFF
        table[[0x20, *range(0x09, 0x0E)]] = 0
    else:
        word = np.zeros(256, dtype=bool)
        word[48:58] = word[65:91] = word[97:123] = word[128:] = True
        table[~word] = 0
    return table


@lru_cache
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


@lru_cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    for s in steps:
        s[0] = 1
    return np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])


@dataclass
class Words:
    """The words of the documents ``first`` .. ``first + n - 1`` of a column."""

    first: int
    n: int
    hashes: np.ndarray  # uint64 by word
    doc: np.ndarray  # int64 by word: 0 .. n - 1
    bounds: np.ndarray  # int64, n + 1: the words of document d are bounds[d] .. bounds[d + 1]
    starts: np.ndarray  # int64 by word: byte offsets in the column's data
    ends: np.ndarray
    offsets: np.ndarray  # int64, n + 1: byte offsets of the documents
    data: np.ndarray  # the column's bytes


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1)
    return o.astype(np.int64), np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)


def spans_of_docs(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``most`` bytes, or of one longer document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _hash_words(norm: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes from prefix sums, some words at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES, side="right")))
        a, b = starts[lo], ends[hi - 1]
        power, inverse = _powers(CHUNK_BYTES if b - a < CHUNK_BYTES else 1 << int(b - a + 1).bit_length())
        sums = np.empty(b - a + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_byte_codes()[norm[a:b]] * power[: b - a], out=sums[1:])
        s = starts[lo:hi] - a
        out[lo:hi] = (sums[ends[lo:hi] - a] - sums[s]) * inverse[s]
        lo = hi
    return mix(out)


def words(column: pa.Array, rule: str) -> Iterator[Words]:
    """The words of a string column without nulls, chunk by chunk."""
    offsets, data = utf8(column)
    for lo, hi in spans_of_docs(offsets):
        base, top = offsets[lo], offsets[hi]
        norm = lookup(rule)[data[base:top]]
        inside = norm != 0
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        local = offsets[lo : hi + 1] - base
        cuts = local[1:-1][(local[1:-1] > 0) & (local[1:-1] < top - base)]
        begins[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        bounds = np.searchsorted(starts, local)
        yield Words(lo, hi - lo, _hash_words(norm, starts, ends), np.repeat(np.arange(hi - lo), np.diff(bounds)), bounds, starts + base, ends + base, offsets[lo : hi + 1], data)


@lru_cache
def _weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` consecutive words, document limits aside."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i, w in enumerate(_weights(k)):
        out += hashes[i : i + n] * w
    return mix(out)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and document numbers, in order of documents, of the ``k``-word shingles; a document
    of fewer words has its whole sequence as its one shingle, one without words has none."""
    h = windows(w.hashes, k)
    own = w.doc[: len(h)] == w.doc[k - 1 :] if len(h) else np.zeros(0, dtype=bool)
    h, doc = h[own], w.doc[: len(own)][own]
    count = np.diff(w.bounds)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.array([(w.hashes[w.bounds[d] : w.bounds[d + 1]] * _weights(k)[: count[d]]).sum(dtype=np.uint64) + _U(count[d]) for d in short], dtype=np.uint64)
        at = np.searchsorted(doc, short)
        h, doc = np.insert(h, at, mix(whole)), np.insert(doc, at, short)
    return h, doc


def code_points(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Characters of each document."""
    lead = np.concatenate(([0], np.cumsum((data[offsets[0] : offsets[-1]] & 0xC0) != 0x80)))
    return np.diff(lead[offsets - offsets[0]])
